"""Streaming jobs in several batches, with late rows and repeated batches, against the batch results."""

from __future__ import annotations

import collections
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.streaming import jobs as jb
from pressmill.streaming.store import Store

START = datetime(2024, 1, 1)


def feed(spark, folder, batches, schema):
    """One file for each batch, read one at a time in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not os.path.exists(f"{folder}/seen-{name}"):
                os.utime(f"{folder}/{name}", (1_700_000_000 + 60 * k,) * 2)
                open(f"{folder}/seen-{name}", "w").close()
    for name in os.listdir(folder):
        if name.startswith("seen-"):
            os.remove(f"{folder}/{name}")
    return jb.read_stream(spark, str(folder), files_per_batch=1)


def folders(path) -> set[str]:
    return {n for n in os.listdir(path) if "=" in n} if os.path.exists(path) else set()


def test_store(spark, tmp_path):
    """Random batches against a dictionary: upserts, compactions, repeated batches, and how little a batch writes."""
    r = random.Random(1)
    store = Store(str(tmp_path / "s"), "k BIGINT, v STRING, w INT", ["k"], buckets=8, compact_after=3)
    want: dict = {}

    def into(old, rows):
        old = old.select("k", F.col("w").alias("w0"))
        return rows.join(old, "k", "left").select("k", "v", (F.coalesce("w0", F.lit(0)) + 1).alias("w"))

    write = store.writer(into)
    for batch in range(8):
        keys = r.sample(range(40), 12) if batch != 5 else [3]
        rows = spark.createDataFrame([(k, f"{batch}-{k}") for k in keys], "k bigint, v string")
        for again in range(2 if batch in (2, 3, 5, 7) else 1):  # a batch that failed late is repeated whole
            write(rows, batch)
            if not again:
                want.update({k: (f"{batch}-{k}", want.get(k, ("", 0))[1] + 1) for k in keys})
            assert {x.k: (x.v, x.w) for x in store.read(spark).collect()} == want
    assert len(folders(tmp_path / "s/delta/batch=5")) == 1 and store.base(spark) in (2, 5, 6, 7)
    plan = store.read(spark, buckets=[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bucket") and "PartitionFilters: [isnotnull(bucket" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")


def test_store_of_keys_alone(spark, tmp_path):
    store = Store(str(tmp_path / "s"), "k STRING", ["k"])
    store.put(spark.createDataFrame([("a",), (None,)], "k string"), 0)
    store.put(spark.createDataFrame([("a",), ("b",)], "k string"), 1)
    assert {x.k for x in store.read(spark).collect()} == {None, "a", "b"} and store.read(spark).count() == 3


def test_quotes_in_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"i{r.randrange(9)}", "r", "q", float(k), START + timedelta(hours=k // 7), k) for k in range(140)]
    batches = [rows[k : k + 35] for k in range(0, 140, 35)]
    schema = "instrument string, rate_type string, quote_currency string, value double, as_of timestamp_ntz, seq long"
    out = str(tmp_path / "out")
    job = jb.quotes_job(feed(spark, tmp_path / "in", batches, schema), out, "2024-02-01 00:00:00")
    jb.run_available(job, str(tmp_path / "cp"))
    want = {x[0]: x[3] for x in rows}
    read = lambda: {x.instrument: x.value for x in jb.quote_store(out).read(spark).collect()}
    assert read() == want and len(folders(f"{out}/delta")) >= 4


def plain_cooldown(times, wait):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= wait:
            out.append(t)
    return out


@pytest.mark.parametrize("delay", [12, 30])
def test_cooldown_with_late_events(spark, tmp_path, delay):
    """Events up to the delay late give what they give in order; later ones are dropped."""
    r = random.Random(delay)
    hours, rows = 0, []
    for _ in range(160):
        hours += r.choice([0, 1, 2])
        rows.append((r.choice("abc"), hours - r.randrange(10)))  # at most 9 hours behind
    batches = [rows[k : k + 40] for k in range(0, 160, 40)]
    batches.append([("z", hours + 500)])  # lets the watermark pass all others
    batches.append([("a", 1), ("z", hours + 1000)])  # too late
    data = [[(k, START + timedelta(hours=h)) for k, h in b] for b in batches]
    stream = jb.cooldown_stream(feed(spark, tmp_path / "in", data, "k string, ts timestamp_ntz"), "k", "ts", 5 * 3600, f"{delay} hours")
    jb.run_available(jb.append_job(stream, str(tmp_path / "out")), str(tmp_path / "cp"))
    got = collections.defaultdict(list)
    for x in spark.read.parquet(str(tmp_path / "out")).collect():
        got[x.key].append((x.emitted_at - START) // timedelta(hours=1))
    for key in "abc":
        assert sorted(got[key]) == plain_cooldown([h for k, h in rows if k == key], 5)
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "cp"))
    assert state.where("key.key IN ('a', 'b', 'c')").count() == 0
    last = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "cp"))
    assert last.where("key.key IN ('a', 'b', 'c') AND value IS NOT NULL").count() == 0


def test_late_rows(spark, tmp_path):
    batches = [[0, 1, 5], [4, 30, 28], [3, 7, 29, 60], [59, 35, 36], [60]]
    data = [[(START + timedelta(hours=h),) for h in b] + ([(None,)] if k == 1 else []) for k, b in enumerate(batches)]
    out = str(tmp_path / "out")
    write = []
    job = jb.late_job(feed(spark, tmp_path / "in", data, "ts timestamp_ntz"), "ts", out, 24 * 3600)
    jb.run_available(job, str(tmp_path / "cp"))
    in_time, late, newest = collections.Counter(), [], None
    for k, b in enumerate(batches):
        for h in b:
            if newest is not None and h < newest - 24:
                late.append(h)
            else:
                in_time[h] += 1
        newest = max([*b, newest if newest is not None else -1])
    hour = lambda t: (t - START) // timedelta(hours=1)
    got = {x.start and hour(x.start): x.n for x in jb.late_store(out).read(spark).collect()}
    assert got == {**in_time, None: 1} and sorted(late) == [3, 35] and not write
    assert sorted(hour(x.ts) for x in spark.read.parquet(f"{out}/late").collect()) == sorted(late)


def test_activity_panes(spark, tmp_path):
    """An article is one row before the aggregate, and windows equal direct counts over several batches."""
    r = random.Random(3)
    rows = [(r.choice(["a tender", "new law", "sun"]), "", START + timedelta(minutes=r.randrange(6000))) for _ in range(90)]
    schema = "title string, summary string, published_at timestamp_ntz, created_at timestamp_ntz"
    data = [[(*x, x[2]) for x in rows[k : k + 30]] for k in range(0, 90, 30)]
    out = str(tmp_path / "out")
    result = jb.activity_stream(feed(spark, tmp_path / "in", data, schema), delay="30 days")
    jb.run_available(jb.table_job(result, out, ["pane_end"]), str(tmp_path / "cp"))
    got = {x.window_end: (x.total, x.tenders) for x in jb.activity_windows(jb.table_store(out, result, ["pane_end"]).read(spark)).collect()}
    want: dict = {}
    for title, _, t in rows:
        end = t.replace(minute=0) + timedelta(hours=1)
        for k in range(24):
            a, b = want.get(end + timedelta(hours=k), (0, 0))
            want[end + timedelta(hours=k)] = (a + 1, b + ("tender" in title))
    assert got == want
