"""The polling loops as Structured Streaming jobs.

Every job reads with a file or table source, keeps its progress in a checkpoint in the shared folder, and writes to a folder or
to a ``store.Store``, whose deltas are named by the batch number: a batch that is repeated after a failure writes the same rows again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from pressmill.functions import rules
from pressmill.functions.times import effective
from pressmill.operators import alerts as al, metrics as m
from pressmill.operators.ordered import first_per_key
from pressmill.operators.writes import advance_cursors, keyed_items, upsert_feed_items, upsert_quotes
from pressmill.sources.feeds import social_items
from pressmill.streaming.store import Store


def read_stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table, one file or a folder of files, as a stream of one batch: its files are in no order of time, so whatever a first
    batch would move (watermarks, cursors) says nothing about the rest."""
    # A pattern stands for a file as well as for a folder; a plain path must be a folder in a stream.
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{{{name}}}.parquet")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; times without zone mean UTC, the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def wall(col) -> Column:
    return col.cast("timestamp_ntz")


def read_inbox_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSONL folder; lines are parsed in the batch so that bad ones can be set aside."""
    return spark.readStream.text(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Work through what has arrived, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---- jobs ------------------------------------------------------------------------------------

FEED_SNAPSHOT = ("item_key STRING, source_id STRING, source_type STRING, external_id STRING, url STRING, title STRING, summary STRING, content STRING,"
                 "language STRING, published_at TIMESTAMP_NTZ, region STRING, page_url STRING, page_handle STRING, hash STRING")


def inbox_store(root: str) -> Store:
    return Store(root, FEED_SNAPSHOT, ["item_key"])


def inbox_job(posts: DataFrame, accounts: DataFrame, root: str, as_of) -> DataStreamWriter:
    """Social posts into the store of feed items; of one post the latest text stays."""
    names = [f.split()[0] for f in FEED_SNAPSHOT.split(",")]
    return posts.writeStream.foreachBatch(inbox_store(root).writer(
        lambda old, rows: upsert_feed_items(old, rows, as_of, "seq").select(*names),
        lambda batch: keyed_items(social_items(batch, accounts).withColumn("seq", F.col("published_at")), as_of)))


DELIVERIES = ("alert_id BIGINT, user_id BIGINT, article_id BIGINT, channel STRING, status STRING, attempt_count INT, next_attempt_at TIMESTAMP_NTZ,"
              "queued_at TIMESTAMP_NTZ, dedupe_key STRING, dedupe_group STRING, normalized_url STRING, priority STRING, created_at TIMESTAMP_NTZ")
CURSORS = "alert_id BIGINT, last_ts TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"


def delivery_store(root: str) -> Store:
    return Store(f"{root}/deliveries", DELIVERIES, ["alert_id", "article_id", "channel"])


def alert_job(articles: DataFrame, alerts: DataFrame, searches: DataFrame, sources: DataFrame, prefs: DataFrame, root: str, as_of) -> DataStreamWriter:
    """Each batch of new articles through the alert cycle. Deliveries are written before the cursors; only new deliveries and moved cursors
    are written."""
    deliveries, cursors = delivery_store(root), Store(f"{root}/cursors", CURSORS, ["alert_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        queued, known = deliveries.read(spark, batch_id), cursors.read(spark, batch_id)
        new, matches = al.run_cycle(alerts, searches, known.select("alert_id", "last_ts"), batch, sources, queued, prefs, as_of)
        deliveries.put(new, batch_id)
        cursors.merge(matches, batch_id, lambda old, rows: advance_cursors(old, rows, as_of))

    return articles.writeStream.foreachBatch(write)


def dedupe_stream(events: DataFrame, keys: list[str], ts: str, window_sec: int, delay: str = "0 seconds") -> DataFrame:
    """First event of a key, and then the first that is at least the window after the last one emitted: ``key`` (JSON of the
    keys), ``emitted_at``. As ``cooldown_stream``."""
    return cooldown_stream(events.withColumn("_key", F.to_json(F.struct(*keys))), "_key", ts, window_sec, delay)


def activity_stream(articles: DataFrame, step: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts of all, and of each flagged kind of article, in panes of one step. ``activity_windows`` sums panes into sliding windows, so
    that an article is counted once and not in each window it lies in."""
    flags = rules.keyword_flags(F.col("title"), F.col("summary"))
    rows = articles.select(effective().alias("ts"), *[flag.alias(name) for name, flag in flags.items()])
    rows = event_time(rows, "ts").withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", step)).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(name).alias(name) for name in flags],
    ).select(wall(F.col("window.end")).alias("pane_end"), "total", *flags)


def activity_windows(panes: DataFrame, panes_each: int = 24, step_hours: int = 1) -> DataFrame:
    """Sliding windows of ``panes_each`` stored panes, by the end of the window."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(panes_each - 1)), lambda k: F.col("pane_end") + F.make_dt_interval(F.lit(0), k * step_hours))
    wide = panes.select(F.explode(ends).alias("window_end"), *[c for c in panes.columns if c != "pane_end"])
    return wide.groupBy("window_end").agg(*[F.sum(c).alias(c) for c in panes.columns if c != "pane_end"])


def daily_stream(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per-source sums of each UTC day. Rows up to ``delay`` late still count."""
    rows = m.exploded_runs(event_time(runs, "started_at").withWatermark("started_at", delay))
    tried = m.attempted()
    fine = rows.where(~((tried > 0) & (m.zero("m.saved") > tried)))
    return fine.groupBy(F.window("started_at", "1 day"), "source_key").agg(
        F.sum(m.zero("m.saved")).alias("saved"), F.sum(m.zero("m.failed")).alias("failed"), F.sum(m.zero("m.blocked")).alias("blocked"),
        F.sum(tried).alias("attempted"),
    ).select(wall(F.col("window.start")).alias("day"), "source_key", "saved", "failed", "blocked", "attempted")


#: Times in one element of a list state.
CHUNK = 10_000
LATE, MARK = "start TIMESTAMP_NTZ, n BIGINT", "name STRING, newest TIMESTAMP_NTZ"


def late_store(root: str, step: str = "hour") -> Store:
    return Store(f"{root}/counts", LATE, ["start"])


def late_job(events: DataFrame, ts: str, root: str, delay_sec: int = 86400, step: str = "hour") -> DataStreamWriter:
    """Counts per step of the rows that are in time, and a side table ``late/batch=N`` of those that are not: more than the delay behind
    the newest row of all earlier batches. Each row is in exactly one of the two. The newest time is stored with the batch."""
    counts, marks = late_store(root), Store(f"{root}/mark", MARK, ["name"])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = marks.read(spark, batch_id).where("name = 'newest'").agg(F.max("newest")).first()[0]
        rows = batch.withColumn("_t", F.col(ts).cast("timestamp_ntz"))
        late = F.lit(False) if mark is None else F.coalesce(F.col("_t") < F.lit(mark) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_sec)), F.lit(False))
        rows.where(late).drop("_t").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        new = rows.where(~late).groupBy(F.date_trunc(step, "_t").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))
        counts.merge(new, batch_id, lambda old, add: old.unionByName(add).groupBy("start").agg(F.sum("n").alias("n")))
        newest = rows.agg(F.max("_t").alias("newest")).where("newest IS NOT NULL").select(F.lit("newest").alias("name"), "newest")
        marks.merge(newest, batch_id, lambda old, add: old.unionByName(add).groupBy("name").agg(F.max("newest").alias("newest")))

    return events.writeStream.foreachBatch(write)


class Cooldown(StatefulProcessor):
    """Times of a key wait until the watermark has passed them, and are then judged in order. State: the waiting times, in lists of a
    whole Arrow batch each, and the last one emitted until nothing can depend on it any more. A list has one timer, for its first time."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.last = handle.getListState("waiting", "t array<long>"), handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            times = np.unique(batch["t"].to_numpy())
            self.waiting.appendValue((times.tolist(),))
            self.handle.registerTimer(int(times[0]) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        held = [np.asarray(ts, np.int64) for (ts,) in self.waiting.get()] if self.waiting.exists() else []
        times = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        ready, rest = np.split(times, [np.searchsorted(times, (now + 1) * 1000)])
        last = self.last.get()[0] if self.last.exists() else None
        sent = []
        # From one that is sent to the first that is far enough from it.
        at = 0 if last is None else int(np.searchsorted(ready, last + self.wait))
        while at < len(ready):
            last = int(ready[at])
            sent.append(last)
            at = max(at + 1, int(np.searchsorted(ready, last + self.wait)))
        if len(rest) and len(ready):
            self.waiting.put([(rest[k : k + CHUNK].tolist(),) for k in range(0, len(rest), CHUNK)])
            self.handle.registerTimer(int(rest[0]) // 1000)
        elif len(ready):
            self.waiting.clear()
        if sent:
            self.last.update((last,))
            self.handle.registerTimer((last + self.wait) // 1000 + 1)
        elif last is not None and (last + self.wait) // 1000 < now:
            self.last.clear()  # whatever comes now is late enough
        if not sent:
            return iter(())
        return iter([pd.DataFrame({"key": pd.Series([key[0]] * len(sent), dtype=str), "t": pd.Series(sent, dtype="int64")})])

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, key: str, ts: str, cooldown_sec: int, delay: str = "0 seconds") -> DataFrame:
    """Emit an event when the last emitted one of its key is at least the cooldown old: ``key, emitted_at``.

    An event is judged once the watermark, ``delay`` behind the newest event, has passed it; so events that are at most that late give
    what they would give in order, and later ones are dropped. A key's state goes when the cooldown is over.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.to_timestamp(ts)
    rows = events.select(F.col(key).cast("string").alias("key"), at.cast("timestamp").alias("at"), F.unix_micros(at).alias("t")).where("t IS NOT NULL AND key IS NOT NULL")
    out = rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Cooldown(cooldown_sec * 1_000_000), "key string, t long", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("t").cast("timestamp_ntz").alias("emitted_at"))


QUOTES = "instrument STRING, rate_type STRING, quote_currency STRING, value DOUBLE, as_of TIMESTAMP_NTZ, fetched_at TIMESTAMP_NTZ"


def quote_store(root: str) -> Store:
    return Store(root, QUOTES, ["instrument", "rate_type", "quote_currency"])


def quotes_job(quotes: DataFrame, root: str, as_of, seq: str = "seq") -> DataStreamWriter:
    """Latest quote per key; within a batch the newest ``as_of`` wins, and a batch replaces what was stored."""

    store = quote_store(root)

    def newest(batch: DataFrame) -> DataFrame:
        # One row of each key is left before anything is kept for the merge.
        return first_per_key(batch.withColumn("_order", F.struct("as_of", seq)).drop(seq), store.keys, [F.col("_order")], last=True)

    def into(old: DataFrame, rows: DataFrame) -> DataFrame:
        return upsert_quotes(old, rows, as_of, "_order").select("instrument", "rate_type", "quote_currency", "value", "as_of", "fetched_at")

    return quotes.writeStream.foreachBatch(store.writer(into, newest))


def table_store(root: str, result: DataFrame, keys: list[str]) -> Store:
    return Store(root, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.schema), keys)


def table_job(result: DataFrame, root: str, keys: list[str]) -> DataStreamWriter:
    """Changed rows of an aggregate put into its store."""
    store = table_store(root, result, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.put(batch, batch_id)

    return result.writeStream.outputMode("update").foreachBatch(write)


def append_job(result: DataFrame, path: str) -> DataStreamWriter:
    return result.writeStream.outputMode("append").format("parquet").option("path", path)
