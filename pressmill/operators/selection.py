"""Which URLs to fetch next, source state, and trailing-run measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressmill.functions import urls
from pressmill.functions.times import as_time, before, span
from pressmill.operators.jumps import spaced
from pressmill.operators.ordered import running, top_k, with_index


def stored_run_length(candidates: DataFrame, keys: Sequence[str], pos: str = "pos", stored: str = "stored") -> DataFrame:
    """Adds ``i`` (index in the group) and ``stale`` (stored rows since the last new one)."""
    indexed = with_index(candidates, keys, pos, "i")
    seen = running(indexed, keys, "i", maxes={"last_new": F.when(~F.col(stored), F.col("i"))})
    return seen.withColumn("stale", F.col("i") - F.coalesce("last_new", F.lit(0))).drop("last_new")


def _until_stop(candidates: DataFrame, keys: Sequence[str], stop: int, min_scan: int) -> DataFrame:
    """New rows up to the first place where ``stop`` stored rows in a row were scanned."""
    runs = stored_run_length(candidates, keys)
    ends = runs.where((F.col("i") >= min_scan) & (F.col("stale") >= stop)).groupBy(*keys).agg(F.min("i").alias("stop_i"))
    return (
        runs.where(~F.col("stored")).join(ends, list(keys), "left")
        .where(F.col("stop_i").isNull() | (F.col("i") <= F.col("stop_i")))
    )


def select_incremental(candidates: DataFrame, stop: int = 20, min_scan: int = 10, max_total: int = 30) -> DataFrame:
    """Candidates: source_key, pos, url, stored. ``stopped`` tells that scanning ended on stale rows."""
    fresh = _until_stop(candidates, ["source_key"], stop, min_scan)
    picked = top_k(fresh, ["source_key"], [F.col("i")], max_total, F.col("i"), "slot")
    return picked.select("source_key", "pos", "url", "slot")


def select_bucketed(candidates: DataFrame, stop: int = 20, max_per: int = 15, max_total: int = 30) -> DataFrame:
    """Per section first, then one from each section in turn; ``news`` and ``inbrief`` lead."""
    keys = ["source_key", "bucket"]
    fresh = _until_stop(candidates, keys, stop, 0)
    per = top_k(fresh, keys, [F.col("i")], max_per, F.col("i"), "rn")
    first_seen = candidates.groupBy(*keys).agg(F.min("pos").alias("first_pos"))
    lead = F.when(F.col("bucket") == "news", 0).when(F.col("bucket") == "inbrief", 1).otherwise(2)
    turn = Window.partitionBy("source_key").orderBy("rn", "lead", "first_pos")
    # At most max_per rows a section are left here.
    order = per.join(first_seen, keys).withColumn("lead", lead).withColumn("slot", F.row_number().over(turn).cast("long"))
    return order.where(F.col("slot") <= max_total).select("source_key", "bucket", "pos", "url", "slot")


def select_feed_mode(candidates: DataFrame, n: int) -> DataFrame:
    """Sitemap and feed seeds are trusted: the first ``n`` that are not stored."""
    return top_k(candidates.where(~F.col("stored")), ["source_key"], [F.col("pos")], n, F.col("pos"), "slot").select("source_key", "pos", "url", "slot")


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], n: int, spread: Column) -> DataFrame:
    """Interleave groups: the first of every group, then the second of every group, up to ``n`` rows."""
    ranked = top_k(rows, [group], order, n, spread, "turn")
    return ranked.orderBy("turn", group).limit(n)


def refresh_allowed(articles: DataFrame, as_of, hours: int = 72) -> DataFrame:
    """Stored pages not seen for a while may be fetched again."""
    return articles.where(F.col("last_seen_at") < before(as_of, hours=hours)).select(urls.canonical_page(F.col("url")).alias("page_key")).distinct()


def effective_existing(articles: DataFrame, as_of, hours: int = 72) -> DataFrame:
    """Stored keys that still block a candidate."""
    stored = articles.select(urls.canonical_page(F.col("url")).alias("page_key")).distinct()
    return stored.join(refresh_allowed(articles, as_of, hours), "page_key", "left_anti")


def touch_last_seen(articles: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    hit = seen.select("url").distinct().withColumn("_hit", F.lit(True))
    rows = articles.join(hit, "url", "left")
    return rows.withColumn("last_seen_at", F.when(F.col("_hit"), as_time(as_of)).otherwise(F.col("last_seen_at"))).drop("_hit")


def discovery_ratio(stats: DataFrame, threshold: float = 0.08) -> DataFrame:
    ratio = F.when(F.col("unique_links") > 0, F.col("kept") / F.col("unique_links"))
    return stats.withColumn("kept_ratio", ratio).withColumn("discovery_degraded", F.coalesce(ratio < threshold, F.lit(False)))


def fetch_degraded(stats: DataFrame, threshold: float = 0.3, min_attempts: int = 5) -> DataFrame:
    rate = F.try_divide("blocked", "attempted")
    reason = (
        F.when((F.col("new_candidates") > 0) & (F.col("attempted") == 0), "fetch_no_attempts")
        .when((F.coalesce(rate, F.lit(0.0)) >= threshold) & (F.col("attempted") >= min_attempts), "blocked_rate")
    )
    return stats.withColumn("degraded_reason", reason).withColumn("fetch_degraded", reason.isNotNull())


def cooldown_filter(sources: DataFrame, health: DataFrame, as_of) -> DataFrame:
    resting = health.where(F.col("cooldown_until") > as_time(as_of)).select("source_key")
    return sources.join(resting, "source_key", "left_anti")


def mark_blocked(health: DataFrame, blocked: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """New state of the health table after the given block events (one row per block)."""
    events = blocked.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    rows = health.join(events, "source_key", "full_outer")
    hit = F.col("n").isNotNull()
    return rows.select(
        "source_key",
        F.when(hit, as_time(as_of)).otherwise(F.col("last_blocked_at")).alias("last_blocked_at"),
        (F.coalesce("blocked_count_24h", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("blocked_count_24h"),
        F.when(hit, as_time(as_of) + span(hours=hours)).otherwise(F.col("cooldown_until")).alias("cooldown_until"),
    )


def errors_in_window(log: DataFrame, keys: Sequence[str], ts: str, is_error: str, seconds: int = 300, trip: int = 3) -> DataFrame:
    """Errors of the trailing window at each row. Time is cut into slices of the window's length; a slice starts with all errors of the slice
    before it and drops each when it leaves the window, so no task sees more than two slices and each row costs one step, however many a window
    holds. Rows without a time are a window of their own."""
    micros = F.unix_micros(F.to_timestamp(ts))
    width = seconds * 1_000_000
    bad = F.col(is_error)
    rows = log.withColumn("_t", micros).withColumn("_slice", F.floor(F.col("_t") / width)).withColumn("_step", F.when(bad, 1).otherwise(0))
    # The window holds its start, so an error leaves one microsecond later.
    left = rows.where(bad & F.col("_t").isNotNull()).select(*keys, (F.col("_slice") + 1).alias("_slice"), (F.col("_t") + width + 1).alias("_t"), F.lit(-1).alias("_step"), F.lit(True).alias("_left"))
    whole = Window.partitionBy(*keys, "_slice")
    upto = whole.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_left", F.lit(False)).unionByName(left, allowMissingColumns=True)
    counted = both.withColumn("errors", F.sum("_step").over(upto) + F.count_if("_left").over(whole)).where("NOT _left")
    return counted.select(*log.columns, "errors", (F.col("errors") >= trip).alias("tripped"))


def notify_cooldown(events: DataFrame, key: str, ts: str, cooldown_sec: int) -> DataFrame:
    """Emit an event only when the last emitted one of its key is at least the cooldown old.

    Equal times of a key collapse first. The rest are jump functions of time slices, so no key is one task (``jumps.spaced``).
    """
    times = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.to_timestamp(ts)).alias("t"))
    return spaced(times, cooldown_sec * 1_000_000).select("key", F.timestamp_micros("t").cast("timestamp_ntz").alias("emitted_at"))
