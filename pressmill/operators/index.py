"""Stored full-text index: postings with places and impacts, searched without reading texts.

``postings``: one row for each token of an article, by bucket of the token, sorted by token and then by how often the article has it. A file's
row groups are thus blocks of falling impact with their bounds in the footer. ``impacts``: for each token, by powers of two of that number, how
many postings there are and the largest of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressmill.functions.text import any_of, ilike_any
from pressmill.functions.times import as_time, before, effective
from pressmill.operators.fence import fence
from pressmill.operators.search import WEIGHT, asked_words, build_token_index, clause_column, clauses_sql, search_articles, total_sql, web_query
from pressmill.session import settle

BUCKETS = 256
#: Postings of a word that the first look reads, times the rows asked for.
FIRST = 20
_KEPT = ["ts", "category", "source", "source_name"]


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_search_index(articles: DataFrame, path: str, buckets: int = BUCKETS, slices: int = 8) -> None:
    """Builds the index of all articles below ``path``. A bucket is written by ``slices`` tasks, so that a frequent token is not one task; each
    has the token's postings in falling order. ``impacts`` is read off what was written."""
    rows = build_token_index(articles.withColumn("ts", effective()), _KEPT)
    placed = rows.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(slices)))
    placed.sortWithinPartitions("bucket", "token", F.desc("tf")).write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = articles.sparkSession.read.parquet(f"{path}/postings")
    level = F.floor(F.log2(F.col("tf") + 0.5)).cast("int")
    counts = stored.groupBy("bucket", "token", level.alias("level")).agg(F.max("tf").alias("most"), F.min("tf").alias("least"), F.count(F.lit(1)).alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/impacts")


def _of(rows: DataFrame, words: list[str], buckets: int) -> DataFrame:
    """The rows of some tokens: their buckets' folders, and in those the row groups that may hold them."""
    return rows.where(F.col("bucket").isin(*(_bucket(F.lit(w), buckets) for w in words)) & F.col("token").isin(words))


def _entries_sql(postings: str) -> str:
    """The places of all asked words of an article in order, as ``search.places`` gives them, from its postings."""
    return f"sort_array(flatten(transform({postings}, p -> transform(p.positions, i -> named_struct('i', i, 'x', p.token)))))"


def _ranked(postings: DataFrame, clauses: Column) -> DataFrame:
    """``id, ts, rank`` of the articles that match. An article has at most one posting for each asked word. Its places are put in order once
    and its rank is computed once, not again for each place and each filter."""
    rows = postings.groupBy("id", "ts").agg(F.collect_list(F.struct("token", "positions")).alias("p"))
    rows = fence(rows, _e=F.expr(_entries_sql("p"))).withColumn("_c", clauses)
    return fence(rows, rank=F.expr(total_sql("_e", "_c"))).where(F.col("rank").isNotNull()).select("id", "ts", "rank")


def _filtered(rows: DataFrame, as_of, days: int, category: str | None, source: str | None) -> DataFrame:
    rows = rows.where(F.col("ts") >= before(as_of, days=max(days, 1)))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if source is not None:
        rows = rows.where(ilike_any([F.col("source"), F.col("source_name")], F.lit(source)))
    return rows


def bounds(impacts: DataFrame, clauses: list[dict], n: int, buckets: int = BUCKETS) -> tuple[dict[str, float], dict[str, int], dict[str, int]]:
    """For each word that may add to a rank: how many clauses count it, its largest number in an article, and the number from which on
    it has FIRST * ``n`` postings. The impacts of a word are at most 64 rows."""
    times: dict[str, float] = {}
    for c in clauses:
        for w in {w for phrase in c["pos"] for w in phrase}:
            times[w] = times.get(w, 0) + 1
    most, start = dict.fromkeys(times, 0), dict.fromkeys(times, 1)
    if times:
        rows = _of(impacts, sorted(times), buckets).groupBy("token", "level").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n")).collect()
        for w in times:
            seen = 0
            for r in sorted((r for r in rows if r.token == w), key=lambda r: -r.level):
                most[w] = max(most[w], r.most)
                if seen < FIRST * n:
                    start[w] = r.least
                seen += r.n
    return times, most, start


def cuts(times: dict[str, float], most: dict[str, int], rank: float) -> dict[str, int]:
    """For each word the number below which an article cannot reach ``rank``, whatever else it holds: each place of a word ends at most one
    stretch in each clause that counts the word, and a stretch adds at most WEIGHT."""
    whole = sum(times[w] * most[w] for w in times)
    return {w: max(1, math.ceil(((rank - 1e-6) / WEIGHT - (whole - times[w] * most[w])) / times[w])) for w in times}


def _above(rows: DataFrame, least: dict[str, int], asked: list[str]) -> DataFrame:
    """Postings of excluded words are all read: without one an article would seem to match."""
    return rows.where(any_of((F.col("token") == w) & (F.col("tf") >= least.get(w, 1)) for w in asked))


def search_stored(spark: SparkSession, path: str, q: str | None, as_of, days: int = 7, category: str | None = None, source: str | None = None, n: int = 50,
                  buckets: int = BUCKETS) -> DataFrame:
    """``id, ts, rank`` of the best ``n`` articles, as ``search.search_articles`` ranks them, from the stored index.

    The first look reads the postings of highest impact and gives a rank that ``n`` articles reach. The second reads only postings that can
    be part of such a rank: what an article's other words could add at most is known from the impacts. An empty query and an
    alternative of exclusions only ("-word") are errors here, since no posting leads to what they find.
    """
    clauses = web_query(q or "")
    asked = asked_words(clauses)
    if not clauses or any(not c["pos"] for c in clauses):
        raise ValueError("a stored search needs words in each alternative")
    told = clause_column(clauses)
    rows = _filtered(_of(spark.read.parquet(f"{path}/postings"), asked, buckets), as_of, days, category, source)
    times, most, start = bounds(spark.read.parquet(f"{path}/impacts"), clauses, n, buckets)
    least = dict.fromkeys(times, 1)
    if any(k > 1 for k in start.values()):
        best = _ranked(_above(rows, start, asked), told).orderBy(F.desc("rank")).limit(n).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")).first()
        if best.n == n:
            least = cuts(times, most, best.rank)
    return _ranked(_above(rows, least, asked), told).orderBy(F.desc("rank"), F.desc("ts"), F.desc("id")).limit(n)


def search_articles_stored(articles: DataFrame, path: str, q: str | None, as_of, **options) -> DataFrame:
    """The articles of ``search_stored`` with all their columns, ``ts`` and ``rank``. Texts are read for the best rows only; queries that no
    posting answers are left to ``search.search_articles``."""
    clauses = web_query(q or "")
    if not clauses or any(not c["pos"] for c in clauses):
        options.pop("buckets", None)
        return search_articles(articles, q, as_of, **options)
    hits = settle(search_stored(articles.sparkSession, path, q, as_of, **options))
    # At most n rows.
    return articles.join(F.broadcast(hits), "id").orderBy(F.desc("rank"), F.desc("ts"), F.desc("id"))


# Parameters and columns of the SQL function.
_PARAMETERS = "q STRING, days INT, category_filter STRING, source_filter STRING, limit_count INT"
_COLUMNS = {"id": "BIGINT", "title": "STRING", "summary": "STRING", "url": "STRING", "source": "STRING", "source_name": "STRING", "category": "STRING",
            "published_at": "TIMESTAMP_NTZ", "created_at": "TIMESTAMP_NTZ"}


def register_search(articles: DataFrame, path: str, as_of=None, name: str = "search_articles", buckets: int = BUCKETS) -> None:
    """Makes ``SELECT * FROM search_articles('words', days, category, source, n)`` work in the session: a SQL table function over the stored
    index and the articles. Its arguments become constants of the plan, so they choose the index's buckets. ``rank`` and ``ts`` are returned as well.

    A null or blank text lists the newest articles; an alternative of exclusions only is an error, as in ``search_stored``. ``as_of``: the time that counts as now; by default the current time.
    """
    spark = articles.sparkSession
    spark.read.parquet(f"{path}/postings").createOrReplaceTempView(f"{name}_postings")
    articles.createOrReplaceTempView(f"{name}_articles")
    now = "localtimestamp()" if as_of is None else f"TIMESTAMP_NTZ '{as_of}'"
    q = f"{name}.q"
    asked = f"array_distinct(flatten(transform({clauses_sql(q)}, c -> flatten(array_append(c.pos, flatten(c.neg))))))"
    since = f"{{ts}} >= {now} - make_dt_interval(greatest({name}.days, 1))"
    bare = f"exists({clauses_sql(q)}, c -> size(c.pos) = 0)"
    filters = f"""({name}.category_filter IS NULL OR category = {name}.category_filter)
        AND ({name}.source_filter IS NULL OR source ILIKE {name}.source_filter OR source_name ILIKE {name}.source_filter)"""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}({_PARAMETERS})
        RETURNS TABLE ({', '.join(f'{c} {k}' for c, k in _COLUMNS.items())}, ts TIMESTAMP_NTZ, rank DOUBLE)
        RETURN WITH posting AS (
            SELECT id, ts, token, positions FROM {name}_postings
            WHERE if({bare}, CAST(raise_error('each alternative needs a word that is searched for') AS BOOLEAN), true)
              AND array_contains(transform({asked}, w -> CAST(pmod(xxhash64(w), {buckets}) AS INT)), bucket) AND array_contains({asked}, token)
              AND {since.format(ts='ts')} AND {filters}),
        hit AS (
            SELECT id, ts, rank FROM (SELECT id, ts, collect_list(named_struct('token', token, 'positions', positions)) AS p FROM posting GROUP BY id, ts)
            LATERAL VIEW explode(array({_entries_sql('p')})) AS e
            LATERAL VIEW explode(array({total_sql('e', clauses_sql(q))})) AS rank),
        every AS (
            SELECT id, ts, rank FROM hit WHERE rank IS NOT NULL
            UNION ALL
            SELECT id, coalesce(published_at, created_at) AS ts, CAST(NULL AS DOUBLE) AS rank FROM {name}_articles
            WHERE trim(coalesce({q}, '')) = '' AND {since.format(ts='coalesce(published_at, created_at)')} AND {filters}),
        best AS (SELECT id, ts, rank, row_number() OVER (ORDER BY rank DESC, ts DESC, id DESC) AS place FROM every)
        SELECT {', '.join(f'a.{c}' for c in _COLUMNS)}, best.ts, best.rank FROM best JOIN {name}_articles a ON a.id = best.id WHERE best.place <= {name}.limit_count
    """)
