"""Registered queries against their SQL, streaming in several batches, and plan checks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from pressmill.operators import alerts as al, metrics as m
from pressmill.plans import catalog  # noqa: F401
from pressmill.plans.registry import ORACLES, QUERIES
from pressmill.sources.bind import AS_OF, Tables
from pressmill.streaming import jobs as jb
from tests.oracle import DATA, compare, engine

SF = os.environ.get("ORACLE_SF", "0.001")
QUICK = [
    "coverage", "ingest_health", "overview_stats", "activity_24h", "daily_run_metrics", "job_canonicalize", "extract_links", "filter_link_prefix",
    "html_main_text", "job_clean_pages", "quality_merge", "summary_route", "job_tag", "select_incremental", "topic_merge", "topic_budget", "scan_sitemap",
    "social_items", "upsert_feed_items", "feed_page", "search_articles", "report_sections", "alert_enqueue", "delivery_result", "backlog_health",
    "extract_tenders", "procurement_digest", "market_refresh", "stream_daily", "stream_cooldown",
]
NAMES = list(QUERIES) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def sql():
    return engine(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sql, name):
    ok, note = compare(sql, entry.queries()[name](spark, f"{DATA}/sf{SF}"), entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    entry.queries()
    assert set(QUERIES) == set(ORACLES)


def _files(spark, df, order, path, n=4):
    """Several files in time order, plus one with the oldest rows last."""
    ranked = df.withColumn("_n", F.ntile(n).over(Window.orderBy(order)))
    for part in [*range(2, n + 1), 1]:
        ranked.where(F.col("_n") == part).drop("_n").coalesce(1).write.mode("append").parquet(path)


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    t = Tables(spark, f"{DATA}/sf0.001")
    _files(spark, t.runs, "id", str(tmp_path / "in"))
    stream = jb.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    result = jb.daily_stream(stream, delay="40 days")
    jb.run_available(jb.table_job(result, str(tmp_path / "out"), ["day", "source_key"]), str(tmp_path / "cp"))
    got = {(r.day, r.source_key): r.saved for r in jb.table_store(str(tmp_path / "out"), result, ["day", "source_key"]).read(spark).collect()}
    rows = m.exploded_runs(t.runs).where(~((m.attempted() > 0) & (m.zero("m.saved") > m.attempted())))
    want = {(r.day, r.source_key): r.saved for r in rows.groupBy(F.date_trunc("day", "started_at").cast("timestamp_ntz").alias("day"), "source_key").agg(F.sum(m.zero("m.saved")).alias("saved")).collect()}
    assert got == want


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_alert_plan_has_no_nested_loop_and_no_python(spark):
    t = Tables(spark, f"{DATA}/sf0.001")
    req = al.alert_requests(t.alerts, t.searches, AS_OF, t.cursors)
    text = plan(al.query_hits(req, t.articles)) + plan(al.source_patterns(req, t.articles, t.sources))
    for bad in ("NestedLoop", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_coverage_reads_only_what_it_needs(spark):
    t = Tables(spark, f"{DATA}/sf0.001")
    text = plan(m.article_stats(t.articles, t.sources, AS_OF))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "text" not in schema and "lang" not in schema
