"""Chains of events that keep a distance, against a sequential model."""

from __future__ import annotations

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from pressmill.operators.jumps import followers, longer, spaced


def model(times, wait):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= wait:
            out.append(t)
    return out


def keyed(rows):
    got: dict = {}
    for k, t in rows:
        got.setdefault(k, []).append(t)
    return got


@pytest.mark.parametrize("wait", [1, 7, 40])
def test_spaced_equals_model(spark, wait):
    """Dense keys, keys with gaps of many slices, times before zero, a NULL key, repeated and NULL times."""
    r = random.Random(wait)
    rows = [(None, t) for t in r.sample(range(-300, 300), 60)] + [("one", 5), ("one", 5), ("one", None), ("none", None)]
    rows += [("dense", t) for t in range(-200, 1200)] + [("edges", wait * i + d) for i in range(60) for d in (0, -1)]
    rows += [(f"gaps{i}", t + jump) for i in range(6) for jump in r.sample(range(0, 9000, 300), 5) for t in r.sample(range(0, 2 * wait + 9), 8)]
    got = keyed(spaced(spark.createDataFrame(rows, "key string, t long"), wait).collect())
    want = {k: model([t for x, t in rows if x == k and t is not None], wait) for k, _ in rows}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_spaced_small_cases(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("b", None)], "key string, t long")
    assert spaced(rows.where("false"), 5).count() == 0
    assert sorted(map(tuple, spaced(rows, 0).collect())) == [("a", 1), ("a", 3)]
    assert sorted(map(tuple, spaced(rows, 5).collect())) == [("a", 1)]


def test_jump_of_a_longer_slice(spark):
    """An entry's jump leaves its slice; entries are times of the first wait and the first time after it."""
    wait, length, r = 10, 80, random.Random(3)
    times = sorted(r.sample(range(1000), 300))
    level = followers(spark.createDataFrame([("k", t) for t in times], "key string, t long"), wait)
    follow = {t: e for _, t, e in level.collect()}
    assert follow == {t: min((x for x in times if x >= t + wait), default=None) for t in times}
    got = longer(level, 0, wait, length).collect()
    want = {t for t in times if t % length < wait} | {min(x for x in times if x // length == s and x % length >= wait) for s in {t // length for t in times}}
    assert {x.t for x in got} == want
    for x in got:
        path, at = [], x.t
        while at is not None and at // length == x.t // length:
            path.append(at)
            at = follow[at]
        assert (x.path, x.exit) == (path, at)


def test_one_key_is_spread_over_tasks(spark):
    """A key with nearly all rows: the plan has no Python, and no task of the sweep holds more than a few of its slices."""
    times = spark.range(40_000).select(F.lit("hot").alias("key"), (F.col("id") * 3).alias("t"))
    swept = followers(times, 1000)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        swept.explain("formatted")
    assert "Python" not in plan.getvalue() and "Arrow" not in plan.getvalue()
    parts = swept.groupBy(F.spark_partition_id()).count().collect()
    assert max(p["count"] for p in parts) < 0.5 * 40_000
    assert spaced(times, 1000).count() == len(model(range(0, 120_000, 3), 1000))
