"""The token index holds blocks of bounded size, and long texts cross no block."""

from __future__ import annotations

import collections

import numpy as np

from pressmill.operators import search as se
from pressmill.session import prepare


def test_blocks_cover_all_rows():
    sizes = np.array([0, 3, 4, 0, 11, 5, 5, 1, 0])
    got = list(se._blocks(sizes, 10))
    assert got == [(0, 4), (4, 5), (5, 7), (7, 9)]
    assert list(se._blocks(np.zeros(0, np.int64), 10)) == [] and list(se._blocks(np.zeros(3, np.int64), 10)) == [(0, 3)]


def test_long_and_empty_texts_over_several_blocks(spark):
    prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    texts = {k: [f"w{(i * i + k) % 97}" for i in range(n)] for k, n in enumerate([150_000, 0, 150_000, 300_000, 7, 0, 90_000])}
    rows = spark.createDataFrame([(k, None, None, " ".join(t), None) for k, t in texts.items()], "id long, title string, summary string, content string, translated_content string")
    got = {(r.token, r.id): (r.tf, r.positions[0], r.positions[-1]) for r in se.build_token_index(rows.coalesce(1)).collect()}
    want = {}
    for k, t in texts.items():
        at = collections.defaultdict(list)
        for i, w in enumerate(t):
            at[w].append(i)
        want.update({(w, k): (len(p), p[0], p[-1]) for w, p in at.items()})
    assert got == want
