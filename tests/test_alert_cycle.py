"""The alert cycle works on distinct wishes: no row for each alert and match, no Python, the rows of the alerts one by one."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.operators import alerts as al, search as se

NOW = datetime(2024, 1, 31)
PREFS = "user_id long, dedupe_window_sec int, immediate_priorities array<string>, digest_priorities array<string>, priority_categories array<string>, channels_enabled array<string>, digest_schedule string"
TEXT = "id long, title string, summary string, content string, translated_content string"


def test_asked_postings_equal_the_index(spark):
    """Long, empty, null and repeated articles; words that no text has."""
    texts = [(1, "Rare words, rare WORDS"), (2, "rare " * 5000 + "end"), (3, ""), (4, None), (5, "other"), (5, "rare other rare")]
    rows = spark.createDataFrame([(i, t, None, "", None) for i, t in texts], TEXT)
    asked = spark.createDataFrame([("rare",), ("other",), ("absent",)], "token string")
    want = se.build_token_index(rows).select("token", "id", "positions").join(asked, "token", "left_semi")
    got = se.asked_postings(rows, asked)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_alerts_queue_what_single_alerts_do(spark, seed):
    """Alerts with the same wish, of which the first ones, some or all have queued an article already."""
    rng = random.Random(seed)
    reqs = [(a, a % 2, rng.choice(["email", "sms"]), f"s{a % 3}", NOW - timedelta(days=rng.choice([1, 2])), f"q{a % 3}", None) for a in range(40)]
    reqs = spark.createDataFrame(reqs, "alert_id long, user_id long, channel string, scope string, start_ts timestamp_ntz, query string, category string")
    starts = sorted({(r.scope, r.start_ts) for r in reqs.collect()})
    best = spark.createDataFrame([(s, t, i) for s, t in starts for i in rng.sample(range(12), 6)], "scope string, start_ts timestamp_ntz, id long")
    keys = spark.createDataFrame([(i, "u", f"k{i % 7}") for i in range(12)], "id long, normalized_url string, dedupe_key string")
    old = {(a, i, rng.choice(["email", "sms"])) for a in range(40) for i in range(12) if rng.random() < (0.9 if a < 20 else 0.4)}
    log = [(a, a % 2, c, f"k{i % 7}" if rng.random() < 0.02 else "gone", NOW - timedelta(hours=rng.choice([1, 9])), i) for a, i, c in sorted(old)]
    log = spark.createDataFrame([*log, *log[:9]], "alert_id long, user_id long, channel string, dedupe_key string, created_at timestamp_ntz, article_id long")
    prefs = al.effective_prefs(reqs, spark.createDataFrame([(1, None, None, None, None, ["sms", "email"], None)], PREFS))
    keyed = reqs.join(best, ["scope", "start_ts"]).join(keys, "id").withColumnRenamed("id", "article_id")
    want = sorted(map(tuple, al.enqueue(keyed, log, prefs, NOW).collect()))
    assert sorted(map(tuple, al.enqueue_scopes(reqs, best, keys, log, prefs, NOW).collect())) == want and want


def test_a_cycle_stores_no_row_for_each_alert_and_match(spark, monkeypatch):
    stored = []

    def settle(df):
        kept = df.localCheckpoint()
        stored.append((kept.count(), df._jdf.queryExecution().toString()))
        return kept

    monkeypatch.setattr(al, "settle", settle)
    articles = spark.createDataFrame([(i, "pipeline restart", None, "", None) for i in range(20)], TEXT).selectExpr(
        "*", "'src1' AS source", "'src1' AS source_id", "'Desk' AS source_name", "CAST(NULL AS STRING) AS category", "concat('https://x.org/', id) AS url",
        "TIMESTAMP_NTZ '2024-01-30 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS published_at", "TIMESTAMP_NTZ '2024-01-30 00:00:00' AS created_at")
    ids = spark.range(200)
    searches = ids.selectExpr("id", "'s' AS name", "'pipeline' AS query", "7 AS days", "'' AS category", "'' AS source")
    alerts = ids.selectExpr("id", "id % 3 AS user_id", "id AS saved_search_id", "'email' AS channel", "'t' AS target", "true AS active")
    sources = spark.createDataFrame([("src1", "Source")], "id string, name string")
    log = spark.createDataFrame([], "alert_id long, user_id long, channel string, dedupe_key string, created_at timestamp_ntz, article_id long")
    cursors = spark.createDataFrame([], "alert_id long, last_ts timestamp_ntz")
    new, newest = al.run_cycle(alerts, searches, cursors, articles, sources, log, spark.createDataFrame([], PREFS), NOW)
    assert {(r.alert_id, r.user_id, r.n) for r in new.groupBy("alert_id", "user_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 0, 20), (1, 1, 20), (2, 2, 20)}
    assert newest.count() == 200 and {r.ts for r in newest.collect()} == {datetime(2024, 1, 30, 19)}
    assert max(n for n, _ in stored) <= 200 and not any("MapInArrow" in p for _, p in stored)
