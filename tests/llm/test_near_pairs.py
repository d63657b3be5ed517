"""Tests of candidate pairs: compiled comparisons, and shingles cut once for each distinct text of a batch."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm import near


def test_pair_tests(spark):
    r = random.Random(1)
    longs = lambda n: [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    rows = []
    for k in range(40):
        x, y = longs(4), longs(4)
        rows.append((k, x, [b if r.random() < 0.6 else a for a, b in zip(x, y)]))
    got = spark.createDataFrame(rows, "k int, x array<long>, y array<long>").select("k", near._apart("x", "y").alias("apart"), near._first_common("x", "y").alias("first")).collect()
    for g in got:
        _, x, y = rows[g.k]
        assert g.apart == sum(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(x, y))
        assert g.first == next((a for a, b in zip(x, y) if a == b), None)
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>")
    joined = df.alias("l").join(df.select(F.col("k").alias("j"), F.col("x").alias("z")), (F.col("k") == F.col("j")) & (near._apart("x", "z") <= 9))
    # A spelled-out test was one generated method that is too long for the JVM to compile.
    assert len(joined._jdf.queryExecution().optimizedPlan().toString()) < 1500


def test_sets_of_texts():
    texts = ["a b c d e f", "", "a b", " ", "a b c d e f", "x " * 50]
    got = near.shingle_sets(pa.array(texts))
    assert [len(g) for g in got] == [2, 0, 1, 0, 2, 1] and np.array_equal(got[0], got[4])
    assert near.shingle_sets(pa.array([], pa.string())) == []


def test_pairs_with_a_null_version(spark):
    """A candidate's id may have another row without text."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (1, None), (3, None), (4, "other words in here now")]
    got = {(x.id, x.n): x.component_id for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 56): 1, (1, 0): 1, (2, 57): 1, (3, 0): 3, (4, 1): 4}
