"""Search: rank against a sequential model, the stored index against the scan, the SQL function, and what their plans read."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pressmill.operators import index as ix, search as se

NOW = "2024-01-31 00:00:00"
WORDS = ["oil", "bank", "port", "vote", "the", "of"]
QUERIES = ["oil", "the -vote", "oil bank", '"oil bank"', 'oil "the port" or bank -"of the"', "vote or vote port", '"the the"', "oil oil", "missing", "port missing or oil", '"of the oil" bank the', "-vote", ""]


def plain_rank(tokens: list[str], q: str) -> float | None:
    """Cover density by its definition: all stretches that hold every item and no smaller such stretch."""
    total, any_ = 0.0, False
    for c in se.web_query(q):
        def at(phrase):
            return [k for k in range(len(tokens) - len(phrase) + 1) if tokens[k : k + len(phrase)] == phrase]

        if any(not at(p) for p in c["pos"]) or any(at(p) for p in c["neg"]):
            continue
        any_, words = True, {w for p in c["pos"] for w in p}
        spans = []
        for e in range(len(tokens)):
            starts = [max([k for k in at(p) if k + len(p) - 1 <= e], default=None) if at(p) else None for p in c["pos"]]
            if starts and None not in starts:
                spans.append((min(starts), e))
        for k, (b, e) in enumerate(spans):
            if k == 0 or b > spans[k - 1][0]:
                asked = sum(tokens[j] in words for j in range(b, e + 1))
                total += 0.1 / (1 + (e - b + 1) - asked)
    return round(total, 6) if any_ else None


@pytest.fixture(scope="module")
def articles(spark):
    r = random.Random(11)
    rows = []
    for k in range(400):
        words = [r.choice(WORDS[: r.choice([2, 4, 6])] + [f"w{r.randrange(30)}"] * 2) for _ in range(r.randint(0, 40))]
        rows.append((k, " ".join(words[:3]), None if k % 7 == 0 else words[3:4] and words[3], "; ".join(words[4:]).upper(), None, f"u{k}", f"src{k % 5}", f"Desk {k % 5}",
                     "Energy" if k % 3 == 0 else None, f"2024-01-{1 + k % 30:02d} 00:00:00" if k % 9 else None, f"2024-01-{1 + k % 30:02d} 01:00:00"))
    df = spark.createDataFrame(rows, "id long, title string, summary string, content string, translated_content string, url string, source string, source_name string, category string, p string, c string")
    return df.withColumn("published_at", F.col("p").cast("timestamp_ntz")).withColumn("created_at", F.col("c").cast("timestamp_ntz")).drop("p", "c").repartition(3).cache()


@pytest.fixture(scope="module")
def stored(articles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spark-index") / "index")
    ix.write_search_index(articles, path, buckets=8, slices=2)
    return path


def tokens(r) -> list[str]:
    return re.findall(r"[a-z0-9]+", " ".join(x or "" for x in (r.title, r.summary, r.content)).lower())


@pytest.mark.parametrize("q", QUERIES[:-1])
def test_rank(articles, q):
    got = {r.id: r.rank for r in se.search_articles(articles, q, NOW, days=365, n=1000).collect()}
    want = {r.id: plain_rank(tokens(r), q) for r in articles.collect()}
    assert got == pytest.approx({i: x for i, x in want.items() if x is not None})


@pytest.mark.parametrize("q", QUERIES)
@pytest.mark.parametrize("first", [1])
def test_stored_search_equals_scan(articles, stored, monkeypatch, q, first):
    monkeypatch.setattr(ix, "FIRST", first)
    for options in ({"days": 365, "n": 5}, {"days": 20, "n": 30, "category": "Energy"}, {"days": 365, "n": 4, "source": "desk 2%"}):
        want = [(r.id, r.ts, r.rank) for r in se.search_articles(articles, q, NOW, **options).collect()]
        assert [(r.id, r.ts, r.rank) for r in ix.search_articles_stored(articles, stored, q, NOW, buckets=8, **options).collect()] == want


def test_sql_function(spark, articles, stored):
    ix.register_search(articles, stored, NOW, buckets=8)
    null = lambda x: "NULL" if x is None else f"'{x}'"
    with pytest.raises(Exception, match="each alternative needs"):
        spark.sql("SELECT * FROM search_articles('oil or -vote', 365, NULL, NULL, 5)").collect()
    for q in [*QUERIES[5:-2], "", None, "it's"]:
        for days, category, source, n in ((365, None, None, 5), (20, "Energy", None, 50), (0, None, "desk 3%", 50)):
            got = spark.sql(f"SELECT * FROM search_articles({null(q and q.replace(chr(39), chr(39) * 2))}, {days}, {null(category)}, {null(source)}, {n})".replace("''''", "''"))
            want = se.search_articles(articles, q, NOW, days=days, category=category, source=source, n=n)
            key = lambda r: (r.id, r.rank, r.url)
            assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str), q
    assert got.columns == ["id", "title", "summary", "url", "source", "source_name", "category", "published_at", "created_at", "ts", "rank"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_search_reads_little(spark, articles, stored):
    """Only the asked buckets, with the tokens pushed to the files; no text column; the second look leaves out low impacts."""
    read = plan(ix.search_stored(spark, stored, "oil -vote", NOW, days=365, n=3, buckets=8))
    assert "postings" in read and "title" not in read and "content" not in read
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", read) and re.search(r"PushedFilters: \[[^\]]*In\(token, \[(oil,vote|vote,oil)\]\)", read)
    ix.register_search(articles.sparkSession.read.parquet(saved(articles, stored)), stored, NOW, buckets=8)
    table = plan(spark.sql("SELECT id, rank FROM search_articles('oil -vote', 365, NULL, NULL, 3)"))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket", table)) == 1 and "content" not in table
    times, most, start = ix.bounds(spark.read.parquet(f"{stored}/impacts"), se.web_query("the or oil"), 1, 8)
    assert ix.cuts({"a": 1.0}, {"a": 9}, 0.7) == {"a": 7} and ix.cuts({"a": 1.0, "b": 2.0}, {"a": 9, "b": 3}, 1.2) == {"a": 6, "b": 2}
    counts = {w: [tokens(r).count(w) for r in articles.collect()] for w in times}
    assert most == {w: max(c) for w, c in counts.items()} and all(sum(x >= start[w] for x in counts[w]) >= 20 for w in times)


def saved(articles, stored) -> str:
    articles.write.mode("ignore").parquet(f"{stored}-articles")
    return f"{stored}-articles"


def test_places_are_ordered_once_and_ranked_once(spark, articles, stored):
    """A filter on the rank must not carry the rank along, nor the rank the ordering of the places, which it reads for each place."""
    ix.register_search(articles, stored, NOW, buckets=8)
    told = [ix.search_stored(spark, stored, "the oil -vote", NOW, days=365, n=3, buckets=8), spark.sql("SELECT id, ts, rank FROM search_articles('the oil -vote', 365, NULL, NULL, 3)")]
    for df in told:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("sort_array(") == 1 and text.count("zip_with(") == 1 and "array_sort(" not in text
