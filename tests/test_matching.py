"""Alert matching: the reverse index of queries and the ladder of time slices, against plain loops."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.operators import alerts as al, search as se, tables as tb

QUERIES = ["common", "common rare", '"common word" rare', "absent common", "common absent or rare", "-common", '-"common word" or rare',
           "word -rare", '"rare common"', "common common", "-absent", "or", "word or word"]


def articles(spark, n=60):
    r = random.Random(11)
    rows = [(i, " ".join(["common", *r.choices(["word", "common", "filler", "other"], k=6), *(["rare"] if i % 9 == 0 else [])])) for i in range(n)]
    rows += [(n, ""), (n + 1, None), (n + 2, "rare rare common word")]
    return spark.createDataFrame(rows, "id long, title string").selectExpr("id", "title", "CAST(NULL AS STRING) AS summary", "'' AS content", "'' AS translated_content")


@pytest.mark.parametrize("hot", [3, 100_000])
def test_query_hits_equal_ranking_each_article(spark, monkeypatch, hot):
    """Every query against every article; with a bound of 3 articles nearly all lookup words are dealt into slices."""
    monkeypatch.setattr(al, "HOT", hot)
    rows = articles(spark)
    got = {(r.query, r.id): r["rank"] for r in al.query_hits(spark.createDataFrame([(q,) for q in [*QUERIES, *QUERIES, ""]], "query string"), rows).collect()}
    want = {}
    for q in QUERIES:
        clauses = se.web_query(q)
        asked = F.array(*map(F.lit, se.asked_words(clauses))).cast("array<string>")
        held = rows.withColumn("e", se.places(se.article_tokens(), asked)).withColumn("c", se.clause_column(clauses))
        want.update({(q, r.id): r.r for r in held.select("id", F.expr(se.total_sql("e", "c")).alias("r")).where("r IS NOT NULL").collect()})
    assert got == pytest.approx(want) and len(got) > 300


def test_lookup_is_the_rarest_wanted_word(spark):
    clauses = al.query_clauses(spark.createDataFrame([("common rare -word",), ("gone common",), ("-word",)], "query string"))
    counts = spark.createDataFrame([("common", 900), ("rare", 4), ("word", 1)], "token string, n long")
    got = {r.query: (r.token, r.parts) for r in al.clause_lookups(clauses, counts).collect()}
    assert got == {"common rare -word": ("rare", 1), "-word": (al.NONE, al.MARK_PARTS)}


def test_ladder_gives_the_best_rows_from_any_time(spark):
    """Starts on, just before and just after slice bounds; bursts in one second, ties of rank, equal times, times before 1970."""
    r = random.Random(5)
    base = datetime(2024, 1, 31, 23, 59, 50)
    times = [base + timedelta(seconds=r.choice([0, 0, 1, 2, 30, 61, 3600, 86_400, 40 * 86_400, -90 * 86_400]), microseconds=r.choice([0, 0, 1, 500_000]) + 1_000_000 * r.randrange(20)) for _ in range(250)]
    times += [datetime(1969, 12, 31, 23, 59, 59), datetime(1960, 1, 1)]
    rows = [(f"s{i % 2}", i, t, float(r.randrange(4))) for i, t in enumerate(times)]
    starts = [base, base + timedelta(microseconds=1), datetime(2024, 2, 1), datetime(2024, 2, 1) - timedelta(microseconds=1), datetime(1969, 12, 31), datetime(1950, 1, 1), datetime(2030, 1, 1), *times[:6]]
    asking = [(scope, s) for scope in ("s0", "s1", "none") for s in sorted(set(starts))]
    found = spark.createDataFrame(rows, "scope string, id long, ts timestamp_ntz, rank double")
    got = al.from_ladder(found, spark.createDataFrame(asking, "scope string, start_ts timestamp_ntz"), 4).collect()
    order = lambda x: (-x[3], -x[2].timestamp(), -x[1])
    for scope, start in asking:
        mine = [(scope, x.id, x.ts, x["rank"]) for x in got if (x.scope, x.start_ts) == (scope, start)]
        assert len(mine) == len({x[1] for x in mine}) and all(x[2] >= start for x in mine)
        assert sorted(mine, key=order)[:4] == sorted([x for x in rows if x[0] == scope and x[2] >= start], key=order)[:4]


def test_names_with_one_prefix_do_not_meet(spark):
    """100 names share their first characters: candidates are those of the rarest run, about one text a needle."""
    names = spark.createDataFrame([(f"sourceoflibyanews{i:03d}",) for i in range(100)], "t string")
    pairs = tb.substring_candidates(names, "t", names.withColumnRenamed("t", "n"), "n")
    assert pairs.count() < 400 and tb.substring_pairs(names, "t", names.withColumnRenamed("t", "n"), "n").where("t = n").count() == 100


@pytest.mark.parametrize("wildcards", [False, True])
def test_substring_pairs_equal_all_pairs(spark, wildcards):
    r = random.Random(7)
    texts = ["".join(r.choices("abcd", k=r.randrange(1, 9))) for _ in range(120)] + ["", None]
    needles = ["".join(r.choices("abcd" + "%_" * wildcards, k=r.randrange(1, 6))) for _ in range(80)] + ["", None, "zzz", "abz"]
    hay, asked = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for rows, c in ((texts, "t"), (needles, "n")))
    pattern = lambda n: re.compile("".join({"%": ".*", "_": "."}.get(c, c) for c in n))
    want = {(t, n) for t in texts if t for n in needles if n and (pattern(n).search(t) if wildcards else n in t)}
    got = [tuple(x) for x in tb.substring_pairs(hay, "t", asked, "n", wildcards).collect()]
    assert len(got) == len(set(got)) and set(got) == want
