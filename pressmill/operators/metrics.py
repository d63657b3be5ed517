"""Overview, activity, coverage, ingest health and daily metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressmill.functions import rules
from pressmill.functions.times import as_time, before, day_start, effective, effective_from
from pressmill.operators.ordered import first_per_key


def live(feed: DataFrame) -> DataFrame:
    return feed.where(~F.col("is_deleted"))


def since(df: DataFrame, as_of, col: Column | str, **length: int) -> DataFrame:
    return df.where((F.col(col) if isinstance(col, str) else col) >= before(as_of, **length))


# ---- overview and activity -------------------------------------------------------------------

def overview_stats(feed: DataFrame, sources: DataFrame, as_of, top: int = 5) -> DataFrame:
    """Long table (metric, key, name, n): totals, counts by language and type, top sources.

    One pass: the window is aggregated once by (language, type, source), the rest works on that.
    """
    recent = since(live(feed), as_of, "published_at", days=7)
    cube = recent.groupBy("language", "source_type", "source_id").agg(
        F.count(F.lit(1)).alias("n7"),
        F.count_if(F.col("published_at") >= before(as_of, hours=24)).alias("n24"),
    )
    named = F.lit(None).cast("string")

    def rows(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.alias("key"), named.alias("name"), value.alias("n"))

    totals = cube.agg(F.coalesce(F.sum("n7"), F.lit(0)).alias("n7"), F.coalesce(F.sum("n24"), F.lit(0)).alias("n24"))
    by_language = cube.groupBy(F.coalesce("language", F.lit("unknown")).alias("k")).agg(F.sum("n7").alias("n"))
    by_type = cube.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("k")).agg(F.sum("n7").alias("n"))
    best = (
        cube.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.sum("n7").alias("n"))
        .orderBy(F.desc("n"), "source_id").limit(top)
        .join(sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
    )
    return (
        rows(totals, "total_24h", F.lit(""), F.col("n24"))
        .unionByName(rows(totals, "total_7d", F.lit(""), F.col("n7")))
        .unionByName(rows(by_language, "by_language", F.col("k"), F.col("n")))
        .unionByName(rows(by_type, "by_source_type", F.col("k"), F.col("n")))
        .unionByName(best.select(F.lit("top_sources_7d").alias("metric"), F.col("source_id").alias("key"), "name", "n"))
    )


def activity(articles: DataFrame, as_of, hours: int = 24) -> DataFrame:
    recent = articles.where(effective_from(before(as_of, hours=hours)))
    flags = rules.keyword_flags(F.col("title"), F.col("summary"))
    return recent.agg(
        F.count(F.lit(1)).alias("total_24h"),
        *[F.count_if(flag).alias(f"{name}_24h") for name, flag in flags.items()],
    )


def source_counts(feed: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    recent = since(live(feed), as_of, "published_at", days=7).where("source_id IS NOT NULL")
    in_day = F.col("published_at") >= before(as_of, hours=24)
    counts = recent.groupBy("source_id").agg(
        F.count_if(in_day).alias("count_24h"),
        F.max(F.when(in_day, F.col("published_at"))).alias("last_24h"),
        F.count(F.lit(1)).alias("count_7d"),
        F.max("published_at").alias("last_7d"),
    )
    names = sources.select(F.col("id").alias("source_id"), F.coalesce("name", "key", "id").alias("name"))
    return counts.join(names, "source_id", "left").orderBy(F.desc("count_7d"), "source_id")


def run_errors_by_job(runs: DataFrame, latest: int = 200) -> DataFrame:
    return (
        runs.select("id", "job_name", "ok", "started_at")
        .orderBy(F.col("started_at").desc_nulls_last(), F.desc("id")).limit(latest)
        .where(~F.col("ok"))
        .groupBy(F.coalesce("job_name", F.lit("unknown")).alias("job_name"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )


# ---- run log ---------------------------------------------------------------------------------

def exploded_runs(runs: DataFrame) -> DataFrame:
    """One row per run and source; ``m`` holds the counters."""
    return runs.select(
        F.col("id").alias("run_id"), "job_name", "started_at",
        F.coalesce("finished_at", "started_at").alias("finished_at"), "ok",
        F.explode("stats.by_source").alias("source_key", "m"),
    )


def zero(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0))


def attempted() -> Column:
    """0 does not fall through, only NULL does."""
    return F.coalesce("m.attempted", "m.total", zero("m.saved") + zero("m.failed") + zero("m.blocked"))


def latest_of(value: Column, ts: str = "started_at") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(F.col(ts), F.col("run_id"))))


def ingest_stats(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    rows = exploded_runs(since(runs, as_of, "started_at", hours=hours))
    status = F.when(F.col("ok"), "ok").when(~F.col("ok"), "fail").otherwise("unknown")
    return rows.groupBy("source_key").agg(
        F.sum(attempted()).alias("attempted"),
        F.sum(zero("m.failed")).alias("failed"),
        F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ingest_ok_at"),
        latest_of(status).alias("last_ingest_status"),
        latest_of(F.col("run_id")).alias("last_ingest_run_id"),
    )


def ingest_health_stats(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    rows = exploded_runs(since(runs, as_of, "started_at", hours=hours))
    error = F.nullif(F.col("m.last_error"), F.lit(""))
    return rows.groupBy("source_key").agg(
        F.sum(F.coalesce("m.discovered_total", "m.new_candidates", "m.total", F.lit(0))).alias("discovered"),
        F.sum(F.coalesce("m.attempted", "m.total", F.lit(0))).alias("fetched"),
        *[F.sum(zero(f"m.{c}")).alias(c) for c in ("saved", "blocked", "failed")],
        latest_of(error).alias("last_error"),
        F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ok_at"),
    )


def source_health_status(feed: DataFrame, runs: DataFrame, sources: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    day, week = before(as_of, hours=24), before(as_of, days=7)
    live_items = live(feed).where("source_id IS NOT NULL")
    items = live_items.where((F.col(ts) >= week) | (F.col("published_at") >= week)).groupBy("source_id").agg(
        F.max(F.when(F.col(ts) >= week, F.col(ts))).alias("last_item_at"),
        F.count_if(F.col("published_at") >= day).alias("items_24h"),
        F.count_if(F.col("published_at") >= week).alias("items_7d"),
    )
    error = F.nullif(F.col("m.last_error"), F.lit(""))
    log = exploded_runs(since(runs, as_of, "started_at", days=7)).groupBy("source_key").agg(
        F.sum(F.when(F.col("started_at") >= day, zero("m.blocked")).otherwise(0)).alias("blocked_24h"),
        latest_of(error).alias("last_error"),
    )
    joined = (
        sources.select(F.col("id").alias("source_id"), F.col("key").alias("source_key"), "is_active",
                       F.coalesce("name", "key", "id").alias("name"))
        .join(items, "source_id", "left").join(log, "source_key", "left")
        .withColumns({c: zero(c) for c in ("items_24h", "items_7d", "blocked_24h")})
    )
    stale = F.col("last_item_at").isNull() | (F.col("last_item_at") < day)
    status = (
        F.when((F.col("blocked_24h") > 0) & (F.col("items_24h") == 0), "blocked")
        .when(F.coalesce("is_active", F.lit(False)) & stale, "stale").otherwise("ok")
    )
    return joined.select(
        "source_id", "name", "last_item_at", "items_24h", "items_7d", "blocked_24h", "last_error", status.alias("status")
    )


# ---- per-source article counts ---------------------------------------------------------------

def with_source_key(facts: DataFrame, sources: DataFrame, source_col: str = "source_id") -> DataFrame:
    """Left join on the dimension; a source without a row keeps its own id."""
    dim = sources.select(F.col("id").cast("string").alias("_sid"), F.col("key").cast("string").alias("_key"))
    return (
        facts.join(dim, F.col(source_col).cast("string") == F.col("_sid"), "left")
        .withColumn("source_key", F.coalesce("_key", F.col(source_col).cast("string"))).drop("_sid", "_key")
    )


def per_source(facts: DataFrame, sources: DataFrame, as_of, days: int, *aggs: Column) -> DataFrame:
    """Aggregate by the fact's own source id first, then join the dimension to the few results."""
    recent = facts.where(effective_from(before(as_of, days=days)))
    return with_source_key(recent.groupBy("source_id").agg(*aggs), sources).where("source_key IS NOT NULL AND source_key <> ''")


def article_stats(articles: DataFrame, sources: DataFrame, as_of, days: int = 7) -> DataFrame:
    small = per_source(articles, sources, as_of, days,
                       F.count(F.lit(1)).alias("n"), F.max(effective()).alias("last_at"))
    return small.groupBy("source_key").agg(F.sum("n").alias("articles_7d"), F.max("last_at").alias("last_article_at"))


def quality_counts(facts: DataFrame, sources: DataFrame, as_of, days: int = 7) -> DataFrame:
    kinds = {"full_count_7d": "full", "teaser_count_7d": "teaser", "blocked_count_7d": "title_only"}
    small = per_source(facts, sources, as_of, days,
                       *[F.count_if(F.col("content_kind") == kind).alias(out) for out, kind in kinds.items()])
    return small.groupBy("source_key").agg(*[F.sum(out).alias(out) for out in kinds])


# ---- coverage and health ---------------------------------------------------------------------

def coverage(config: DataFrame, articles: DataFrame, sources: DataFrame, runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    rows = (
        config.join(article_stats(articles, sources, as_of, days), "source_key", "left")
        .join(ingest_stats(runs, as_of), "source_key", "left")
        .withColumn("articles_7d", zero("articles_7d"))
        .withColumn("fail_rate_24h", F.when(F.col("attempted") > 0, F.col("failed") / F.col("attempted")))
    )
    stale = F.col("last_article_at").isNull() | (F.col("last_article_at") < before(as_of, hours=48))
    notes = (
        F.when(F.col("articles_7d") == 0, "no_articles_7d").when(stale, "stale_48h")
        .when(F.col("fail_rate_24h") > 0.5, "high_fail_rate_24h")
    )
    return rows.select(
        "source_key", "enabled", "type", "last_article_at", "articles_7d", "last_ingest_ok_at", "last_ingest_run_id",
        F.coalesce("last_ingest_status", F.lit("unknown")).alias("last_ingest_status"), "fail_rate_24h", notes.alias("notes"),
    ).orderBy(F.desc("articles_7d"), F.desc("source_key"))


def coverage_totals(cover: DataFrame) -> DataFrame:
    return cover.agg(
        F.count(F.lit(1)).alias("sources_configured"),
        F.count_if(F.col("articles_7d") > 0).alias("sources_with_articles_7d"),
        zero(F.sum("articles_7d")).alias("articles_7d"),
    )


def orphan_sources(sources: DataFrame, config: DataFrame) -> DataFrame:
    return sources.select(F.col("key").alias("source_key")).join(config.select("source_key"), "source_key", "left_anti").orderBy("source_key")


def ingest_health(config: DataFrame, articles: DataFrame, feed: DataFrame, sources: DataFrame, runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    stats = ingest_health_stats(runs, as_of, hours).withColumn("has_stats", F.lit(True))
    kept = quality_counts(articles, sources, as_of)
    fed = quality_counts(feed, sources, as_of)
    fed = fed.select("source_key", *[F.col(c).alias(f"feed_{c}") for c in fed.columns if c != "source_key"])
    rows = config.join(stats, "source_key", "left").join(kept, "source_key", "left").join(fed, "source_key", "left")
    counts = [c for c in rows.columns if c.endswith("_count_7d")]
    rows = rows.withColumns({c: zero(c) for c in counts})
    kind = F.when(F.col("has_stats"),
        F.when(F.col("full_count_7d") > 0, "ok")
        .when(F.col("teaser_count_7d") > 0, "degraded")
        .when((F.col("fetched") > 0) & (F.col("saved") == 0), "extract")
        .when((F.col("fetched") == 0) & (F.col("blocked") > 0), "blocked")
        .when(F.col("discovered") == 0, "config").otherwise("unknown"),
    ).otherwise("unknown")
    return rows.select(
        "source_key", "enabled", "type",
        *[F.col(c).alias(f"{c}_24h") for c in ("discovered", "fetched", "saved", "blocked", "failed")],
        F.when(F.col("fetched") > 0, F.col("failed") / F.col("fetched")).alias("fail_rate_24h"),
        "last_error", "last_ok_at", kind.alias("classification"), *counts,
    ).orderBy(F.desc(zero("saved_24h")), F.desc("source_key"))


# ---- daily -----------------------------------------------------------------------------------

ERROR_CLASSES = ["err_dns", "err_timeout", "err_connect", "err_tls", "err_http_403", "err_http_429", "err_http", "err_other"]


def daily_rows(runs: DataFrame, day, job: str = "page_ingest") -> DataFrame:
    """Run rows of one UTC day; a row that saved more than it attempted is inconsistent and left out."""
    start = day_start(day)
    rows = exploded_runs(runs.where((F.col("started_at") >= start) & (F.col("started_at") < start + F.make_dt_interval(F.lit(1)))
                                    & (F.col("job_name") == job)))
    bad = (attempted() > 0) & (zero("m.saved") > attempted())
    return rows.withColumn("attempted", attempted()).where(~bad)


def daily_run_metrics(runs: DataFrame, day, job: str = "page_ingest") -> DataFrame:
    sums = daily_rows(runs, day, job).groupBy("source_key").agg(
        F.sum(zero("m.saved")).alias("saved_new"),
        F.sum(zero("m.updated_existing")).alias("updated_existing"),
        F.sum(zero("m.failed")).alias("failed"),
        F.sum(zero("m.blocked")).alias("blocked"),
        F.sum("attempted").alias("attempted"),
        F.sum(zero("m.total")).alias("total"),
        F.sum(zero("m.junk_saved")).alias("junk_saved"),
        F.sum(F.coalesce("m.deduped_existing", "m.dedup_existing", F.lit(0))).alias("dedup_existing"),
        F.sum(zero("m.dedup_new")).alias("dedup_new"),
        F.bool_or(F.coalesce("m.discovery_degraded", F.lit(False))).alias("discovery_degraded"),
        F.bool_or(F.coalesce("m.fetch_degraded", F.lit(False))).alias("flagged"),
    )
    none = (F.col("attempted") == 0) & ((F.col("failed") > 0) | (F.col("blocked") > 0))
    return sums.select(
        *[c for c in sums.columns if c != "flagged"],
        F.try_divide("failed", "attempted").alias("fail_rate"),
        F.try_divide("blocked", "attempted").alias("block_rate"),
        F.try_divide("saved_new", "attempted").alias("kept_ratio"),
        (F.col("flagged") | none).alias("fetch_degraded"),
    )


def daily_error_rates(runs: DataFrame, day, job: str = "page_ingest") -> DataFrame:
    sums = daily_rows(runs, day, job).groupBy("source_key").agg(
        F.sum("attempted").alias("attempted"), *[F.sum(zero(f"m.{c}")).alias(c) for c in ERROR_CLASSES]
    )
    http = F.col("err_http_403") + F.col("err_http_429") + F.col("err_http")
    return sums.select(
        "*", F.try_divide("err_dns", "attempted").alias("dns_rate"),
        F.try_divide("err_timeout", "attempted").alias("timeout_rate"), F.try_divide(http, F.col("attempted")).alias("http_rate"),
    )


def summary_state(articles: DataFrame, sources: DataFrame, day) -> DataFrame:
    """Counts per source and state over the whole table and for one day."""
    state = F.coalesce("summary_status", F.lit("UNKNOWN"))
    state = F.when(state == "DONE_FASTPATH", "DONE").otherwise(state)
    start = day_start(day)
    today = (F.col("summary_updated_at") >= start) & (F.col("summary_updated_at") < start + F.make_dt_interval(F.lit(1)))
    states = {"done": "DONE", "pending": "PENDING", "timeout": "TIMEOUT", "error": "ERROR"}
    small = articles.groupBy("source_id").agg(
        *[F.count_if(state == v).alias(k) for k, v in states.items()],
        F.count_if((state == "DONE") & today).alias("done_today"),
    )
    keyed = small.join(sources.select(F.col("id").alias("source_id"), "key"), "source_id", "left")
    return keyed.groupBy(F.coalesce("key", F.lit("unknown")).alias("source_key")).agg(
        *[F.sum(c).alias(c) for c in [*states, "done_today"]]
    )


def article_counts(articles: DataFrame, sources: DataFrame, as_of, days: int = 7, top: int = 5) -> DataFrame:
    """Top sources of the window plus the number of sources active in 48 h."""
    recent = since(articles, as_of, "published_at", days=max(days, 2))
    small = recent.groupBy("source_id").agg(
        F.count_if(F.col("published_at") >= before(as_of, days=days)).alias("n"),
        F.count_if(F.col("published_at") >= before(as_of, hours=48)).alias("n48"),
    )
    dim = sources.select(F.col("id").alias("source_id"), F.col("key").alias("source_key"))
    keyed = small.join(dim, "source_id").groupBy("source_key").agg(F.sum("n").alias("n"), F.sum("n48").alias("n48"))
    best = keyed.orderBy(F.desc("n"), "source_key").limit(top).select(F.lit("top").alias("metric"), "source_key", "n")
    active = keyed.agg(F.count_if(F.col("n48") > 0).alias("n")).select(F.lit("active_48h").alias("metric"), F.lit("").alias("source_key"), "n")
    return best.unionByName(active)


def null_audit(df: DataFrame, cols: list[str], flags: list[str] = ()) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols],
        *[F.count_if(F.col(c)).alias(f"{c}_true") for c in flags],
    )


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.select("id", "job_name", "started_at", "finished_at", "ok").orderBy(F.col("started_at").desc_nulls_first(), F.desc("id")).limit(n)


def latest_per_source(runs: DataFrame) -> DataFrame:
    """Last run, last error and last success of every source."""
    rows = exploded_runs(runs)
    return rows.groupBy("source_key").agg(
        latest_of(F.col("run_id")).alias("last_run_id"), F.max("started_at").alias("last_run_at"),
        latest_of(F.nullif(F.col("m.last_error"), F.lit(""))).alias("last_error"),
        F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ok_at"),
    )
