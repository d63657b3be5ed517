"""Full-text and substring search, token index, ranked reports.

Texts are compared as "simple" tokens: lower-cased letter and digit runs, no stemming, no stop words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions import rules, summaries as sm
from pressmill.functions.text import blank, contains_any, ilike_any, tokens
from pressmill.functions.times import as_time, before, effective, effective_from, epoch_seconds
from pressmill.operators.fence import fence
from pressmill.operators.tables import article_entities

SEARCH_COLS = ["title", "summary", "content", "translated_content"]
WEIGHT = 0.1


def article_tokens() -> Column:
    return tokens(F.concat_ws(" ", *[blank(F.col(c)) for c in SEARCH_COLS]))


#: Tokens of whole articles that are sorted at once; a longer article is sorted alone.
BLOCK = 1 << 18


def _blocks(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` tokens together, or one longer row."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + most, "right")))
        yield at, end
        at = end


def build_token_index(articles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(token, id, tf, positions) and the columns to ``keep``. Made inside each article's row, so nothing is shuffled and a frequent token
    is never one group: blocks of token lists are numbered, sorted and cut where the article or the token changes. A task's memory follows
    the block (and the longest text), not the batch or the partition."""
    rows = articles.select("id", *keep, article_tokens().alias("tokens"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ["id", *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(whole.column(whole.num_columns - 1).value_lengths().fill_null(0)).astype(np.int64)
            for at, end in _blocks(sizes, BLOCK):
                batch, size = whole.slice(at, end - at), sizes[at:end]
                coded = batch.column(batch.num_columns - 1).flatten().dictionary_encode()
                word, row = np.asarray(coded.indices), np.repeat(np.arange(len(size), dtype=np.int32), size)
                place = np.arange(len(word), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
                order = np.argsort(row * np.int64(len(coded.dictionary) + 1) + word, kind="stable")
                word, row = word[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])[: len(word)])
                cut = np.append(first, len(word)).astype(np.int32)
                owner = pa.array(row[first])
                places = pa.ListArray.from_arrays(pa.array(cut), pa.array(place[order]))
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(word[first])), *(batch.column(k).take(owner) for k in range(batch.num_columns - 1)), pa.array(np.diff(cut).astype(np.int64)), places],
                    ["token", "id", *keep, "tf", "positions"])

    return rows.mapInArrow(run, f"token string, {kinds}, tf bigint, positions array<int>")


def asked_postings(articles: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, id, positions) as in ``build_token_index``, of the words in ``asked`` (token, distinct) alone. Words that nobody asks for leave
    where the text is read, so no Python and only the asked places travel. Articles with one id stay apart."""
    numbered = articles.select("id", F.monotonically_increasing_id().alias("_row"), article_tokens().alias("_tokens"))
    words = numbered.select("_row", "id", F.posexplode("_tokens").alias("_at", "token"))
    met = words.join(asked, "token", "left_semi").groupBy("token", "_row", "id").agg(F.sort_array(F.collect_list("_at")).alias("positions"))
    return met.select("token", "id", "positions")


# ---- query grammar and rank ------------------------------------------------------------------

def web_query(q: str) -> list[dict]:
    """Web-style search text: words are ANDed, "…" is a phrase, ``or`` starts an alternative, a leading - excludes."""
    out: list[dict] = [{"pos": [], "neg": []}]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', q or ""):
        if not minus and word.lower() == "or":
            out.append({"pos": [], "neg": []})
            continue
        parts = re.findall(r"[^\W_]+", (quoted or word).lower())
        if parts:
            out[-1]["neg" if minus else "pos"].append(parts)
    return [c for c in out if c["pos"] or c["neg"]]


#: Rank and match as SQL text, so that DataFrames and SQL functions share them. ``{e}``: the places of all asked words of a text in order,
#: ``array<struct<i: int, x: string>>``; ``{p}``: one phrase, an array of words.
_ENDS = ("k + 1 >= size({p}) AND transform(slice({e}, k - size({p}) + 2, size({p})), y -> y.x) = {p} "
         "AND get({e}, k).i - get({e}, k - size({p}) + 1).i = size({p}) - 1")
_OCCURS = "exists(if(size({e}) = 0, array(), sequence(0, size({e}) - 1)), k -> " + _ENDS + ")"


def occurs_sql(entries: str, phrase: str) -> str:
    """Whether the words of a phrase stand one after the other."""
    return _OCCURS.format(e=entries, p=phrase)


def density_sql(entries: str, pos: str, weight: float = WEIGHT) -> str:
    """``struct<ok, rank>``: whether all items of ``pos`` occur, and the cover density: each shortest stretch that holds all of them adds
    ``weight`` / (1 + words in it that nobody asked for). One sweep over the places keeps for each item the latest start of an occurrence that has
    ended; the smallest of them begins a stretch. Every asked word counts as asked for, those of a phrase also outside it."""
    ends = _ENDS.format(e="en", p="p")
    step = f"""transform(array(zip_with({pos}, s.last, (p, l) -> if({ends}, k - size(p) + 1, l))), n ->
        transform(array(if(exists(n, l -> l IS NULL), -1, array_min(n))), b -> named_struct('last', n, 'prev', greatest(s.prev, b), 'rank', s.rank
        + if(b > s.prev, {weight}D / (1 + (get(en, k).i - get(en, b).i) - (k - b)), 0D)))[0])[0]"""
    own = f"filter({entries}, y -> array_contains(flatten({pos}), y.x))"
    start = f"named_struct('last', transform({pos}, p -> CAST(NULL AS INT)), 'prev', -1, 'rank', 0D)"
    sweep = f"aggregate(if(size(en) = 0, array(), sequence(0, size(en) - 1)), {start}, (s, k) -> {step}, s -> named_struct('ok', NOT exists(s.last, l -> l IS NULL), 'rank', s.rank))"
    return f"transform(array({own}), en -> {sweep})[0]"


def clauses_sql(q: str) -> str:
    """``array<struct<pos, neg>>`` of a search text: the form of ``web_query`` as an expression."""
    items = f"regexp_extract_all({q}, '-?(?:\"[^\"]*\"|[^\\\\s\"]+)', 0)"
    none = "CAST(array() AS array<array<string>>)"
    words = "filter(split(lower(x), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')"
    more = f"transform(array({words}), w -> if(size(w) = 0, c, named_struct('pos', if(startswith(x, '-'), c.pos, array_append(c.pos, w)), 'neg', if(startswith(x, '-'), array_append(c.neg, w), c.neg))))[0]"
    last = f"transform(array(element_at(a, -1)), c -> {more})[0]"
    blank_ = f"named_struct('pos', {none}, 'neg', {none})"
    read = f"aggregate({items}, array({blank_}), (a, x) -> if(lower(x) = 'or', array_append(a, {blank_}), array_append(slice(a, 1, size(a) - 1), {last})))"
    return f"filter({read}, c -> size(c.pos) + size(c.neg) > 0)"


def total_sql(entries: str, clauses: str) -> str:
    """Rank of a text over all clauses it satisfies; NULL where it satisfies none."""
    hit = f"transform(array({density_sql(entries, 'c.pos')}), d -> if(d.ok AND NOT exists(c.neg, q -> {occurs_sql(entries, 'q')}), d.rank, NULL))[0]"
    return f"transform(array(filter(transform({clauses}, c -> {hit}), r -> r IS NOT NULL)), r -> if(size(r) = 0, NULL, round(aggregate(r, 0D, (a, x) -> a + x), 6)))[0]"


def places(tk: Column, asked: Column) -> Column:
    """The places of the asked words in an array of words, as ``entries``."""
    found = F.transform(tk, lambda x, i: F.when(F.array_contains(asked, x), F.struct(i.alias("i"), x.alias("x"))))
    return F.filter(found, lambda e: e.isNotNull())


def clause_column(clauses: list[dict]) -> Column:
    """``array<struct<pos, neg>>`` of parsed clauses, as a literal."""
    return F.from_json(F.lit(json.dumps(clauses)), "array<struct<pos: array<array<string>>, neg: array<array<string>>>>")


def asked_words(clauses: list[dict]) -> list[str]:
    return sorted({w for c in clauses for side in ("pos", "neg") for phrase in c[side] for w in phrase})


def within(articles: DataFrame, as_of, days: int = 7, category: str | None = None, source: str | None = None) -> DataFrame:
    """The rows a search looks at."""
    rows = articles.where(effective_from(before(as_of, days=max(days, 1))))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if source is not None:
        rows = rows.where(ilike_any([F.col("source"), F.col("source_name")], F.lit(source)))
    return rows


def search_articles(articles: DataFrame, q: str | None, as_of, days: int = 7, category: str | None = None, source: str | None = None, n: int = 50) -> DataFrame:
    """Best ``n``: filters first, then the token test, rank, and one top-n merge."""
    rows = within(articles, as_of, days, category, source).withColumn("ts", effective())
    if not (q or "").strip():
        return rows.withColumn("rank", F.lit(None).cast("double")).orderBy(F.desc("ts"), F.desc("id")).limit(n)
    clauses = web_query(q)
    if not clauses:
        return rows.withColumn("rank", F.lit(0.0)).limit(0)
    asked = F.array(*map(F.lit, asked_words(clauses)))
    held = fence(rows, _e=places(article_tokens(), asked)).withColumn("_c", clause_column(clauses))
    held = fence(held, rank=F.expr(total_sql("_e", "_c"))).where(F.col("rank").isNotNull()).drop("_e", "_c")
    return held.orderBy(F.desc("rank"), F.desc("ts"), F.desc("id")).limit(n)


def with_category(items: DataFrame) -> DataFrame:
    return items.withColumn("category_guess", F.coalesce(F.nullif("category", F.lit("")), rules.category(F.col("title"), F.col("summary"))))


def search_like(articles: DataFrame, q: str | None, as_of, days: int = 7, category: str | None = None, source: str | None = None, n: int = 50) -> DataFrame:
    """Substring search over the text columns, newest first."""
    rows = articles.where(effective_from(before(as_of, days=days)))
    if q:
        rows = rows.where(ilike_any([F.col(c) for c in SEARCH_COLS], F.lit(f"%{q}%")))
    if source:
        low = F.lit(source.lower())
        rows = rows.where(F.contains(F.lower(blank(F.col("source"))), low) | F.contains(F.lower(blank(F.col("source_name"))), low))
    rows = with_category(rows).withColumn("ts", effective())
    if category:
        rows = rows.where(F.lower("category_guess") == category.lower())
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def search(articles: DataFrame, q: str | None, as_of, **filters) -> DataFrame:
    """Full text when a query is given, else the substring form with the same filters."""
    if (q or "").strip():
        f = dict(filters)
        if f.get("source"):
            f["source"] = f"%{f['source']}%"
        return with_category(search_articles(articles, q, as_of, **f))
    return search_like(articles, None, as_of, **filters)


def article_detail(articles: DataFrame, sources: DataFrame, bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """Article pages: source, category, clean body and entity names."""
    dim = sources.select(F.col("key").alias("source"), F.col("name").alias("s_name"), F.col("url").alias("source_url"))
    rows = with_category(articles).join(dim, "source", "left")
    rows = fence(rows, _clean=sm.clean_text(F.col("content"), allow_html=True))
    names = article_entities(articles, bridge, entities)
    return rows.join(names, rows.id == names.article_id, "left").select(
        "id", "title", "summary", "category_guess", "published_at", "created_at",
        F.coalesce(F.nullif("source_name", F.lit("")), F.nullif("source", F.lit("")), "s_name").alias("source_name"), "source_url", "url",
        sm.drop_boilerplate(F.col("_clean")).alias("content_clean"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


# ---- reports ---------------------------------------------------------------------------------

# Weight of a source in the ranked report; any other source counts 1.
SOURCE_WEIGHT = {"cbl": 3.0, "noc": 2.8, "unsmil": 2.4, "world_bank_libya": 2.2, "imf_libya": 2.2}


def report_window(feed: DataFrame, start, end, limit: int, language: str | None = None) -> DataFrame:
    rows = feed.where(~F.col("is_deleted") & (F.col("published_at") >= as_time(start)) & (F.col("published_at") <= as_time(end)))
    if language:
        rows = rows.where(F.col("language") == language)
    return rows.orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def _hits(keywords: Sequence[str]) -> Column:
    text = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("summary")), blank(F.col("content"))))
    total = F.lit(0)
    for k in [k.strip().lower() for k in keywords if k.strip()]:
        total = total + contains_any(text, [k]).cast("int")
    return total


def _recency(as_of) -> Column:
    hours = F.greatest((epoch_seconds(as_time(as_of)) - epoch_seconds("published_at")) / 3600.0, F.lit(0.0))
    return F.greatest(F.lit(0.0), 72 - hours) / 72


def report_rank(feed: DataFrame, sources: DataFrame, as_of, start, end, keywords: Sequence[str] = (), language: str | None = None,
                limit: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """Keyword hits, recency over three days and source weight."""
    weights = SOURCE_WEIGHT if weights is None else weights
    dim = sources.select(F.col("id").alias("source_id"), F.col("key").alias("source_key"), F.coalesce("name", "key", "id").alias("source_label"))
    rows = report_window(feed, start, end, limit, language).join(dim, "source_id", "left")
    weight = F.lit(1.0)
    for key, value in weights.items():
        weight = F.when(F.col("source_key") == key, value).otherwise(weight)
    score = _hits(keywords) * 2.5 + _recency(as_of) + weight
    return rows.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), F.desc("published_at"), F.desc("id"))


def report_rank_priority(feed: DataFrame, sources: DataFrame, as_of, start, end, keywords: Sequence[str] = (), language: str | None = None, limit: int = 50) -> DataFrame:
    """Variant: recency, the source's configured priority, and plain hits."""
    priority = F.coalesce(F.get_json_object("meta", "$.priority").try_cast("double"), F.lit(0.0))
    dim = sources.select(F.col("id").alias("source_id"), priority.alias("priority"), F.coalesce("name", "key", "id").alias("source_label"))
    rows = report_window(feed, start, end, limit, language).join(dim, "source_id", "left")
    score = _recency(as_of) + F.coalesce("priority", F.lit(0.0)) + _hits(keywords)
    return rows.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), F.desc("published_at"), F.desc("id"))


def report_lines(ranked: DataFrame, title: str, start: str, end: str) -> DataFrame:
    """Report rows (section, line_no, line). ``ranked`` holds at most the report's limit of items."""
    from pyspark.sql import Window

    section = F.when(F.coalesce("source_type", F.lit("")) == "social", 2).otherwise(1)
    order = Window.partitionBy("section").orderBy(F.desc("score"), F.desc("published_at"), F.desc("id"))
    items = ranked.withColumn("section", section).withColumn("n", F.row_number().over(order)).where("n <= 10")
    headline = F.coalesce(F.nullif("title", F.lit("")), F.substring_index(blank(F.col("summary")), "\n", 1))
    suffix = F.when(blank(F.col("url")) != "", F.concat(F.lit(" — "), "url")).otherwise("")
    when = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    lines = items.select("section", F.col("n").alias("line_no"), F.concat(F.lit("- "), headline, F.lit(" ("), when, F.lit(")"), suffix).alias("line"))
    names = ranked.where("source_id IS NOT NULL").select("source_id", F.coalesce("source_label", "source_id").alias("s")).distinct()
    by_id = Window.orderBy("source_id")
    named = names.select(F.lit(3).alias("section"), F.row_number().over(by_id).alias("line_no"), F.concat(F.lit("- "), "s").alias("line"))
    # Headings of the report.
    heads = {0: [f"# {title}", "", f"**Period:** {start} → {end}", "", "## Executive Summary", "", "- Deterministic summary (LLM optional).", ""],
             1: ["## Key Developments", ""], 2: ["## Notable Social Signals", ""], 3: ["## Sources", ""]}
    spark = ranked.sparkSession
    from pressmill.sources.config import rule_table

    fixed = rule_table(spark, [(s, i - len(ls), line) for s, ls in heads.items() for i, line in enumerate(ls)], "section int, line_no int, line string")
    ends = rule_table(spark, [(s, 1_000_000, "") for s in (1, 2, 3)], "section int, line_no int, line string")
    return fixed.unionByName(lines).unionByName(named).unionByName(ends).orderBy("section", "line_no")


def report_markdown(lines: DataFrame) -> DataFrame:
    """The whole report as one text; a report has a bounded number of lines."""
    text = lines.agg(F.sort_array(F.collect_list(F.struct("section", "line_no", "line"))).alias("l"))
    return text.select(F.concat(F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n ")), F.lit("\n")).alias("markdown"))
