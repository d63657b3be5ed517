"""Predicates, joins, paging and set operations over stored tables."""

from __future__ import annotations

import base64
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions import rules
from pressmill.functions.text import ilike_any, normalize_name
from pressmill.functions.times import as_time, before, effective, effective_from
from pressmill.operators.fence import fence


# ---- predicates ------------------------------------------------------------------------------

def recent(df: DataFrame, as_of, days: int) -> DataFrame:
    return df.where(effective_from(before(as_of, days=days)))


def optional_filter(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Equality for every parameter that is set; unset ones leave no trace in the plan."""
    for column, value in params.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def ilike_filter(df: DataFrame, cols: Sequence[str], text: str) -> DataFrame:
    """``%`` and ``_`` of the user stay wildcards."""
    return df.where(ilike_any([F.col(c) for c in cols], F.lit(f"%{text}%")))


def in_list(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def json_rows(df: DataFrame, raw: str, has: str, path: str, out: str) -> DataFrame:
    """Rows whose JSON has the key, with the text at ``path``."""
    variant = F.try_parse_json(raw)
    return df.where(F.try_variant_get(variant, f"$.{has}", "variant").isNotNull()).withColumn(out, F.try_variant_get(variant, path, "string"))


def enum_validate(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rejected rows with the first offending column."""
    bad = None
    for column, values in allowed.items():
        wrong = ~F.coalesce(F.col(column).isin(*values), F.lit(False))
        bad = F.when(wrong, column) if bad is None else bad.when(wrong, column)
    return df.where(bad.isNull()), df.withColumn("rejected_by", bad).where("rejected_by IS NOT NULL")


def needs_entities(df: DataFrame, col: str = "entities") -> DataFrame:
    filled = [F.coalesce(F.size(F.col(f"{col}.{f}")), F.lit(0)) > 0 for f in ("orgs", "people", "locations", "topics")]
    return df.where(~(filled[0] | filled[1] | filled[2] | filled[3]))


def reconcile_source_ids(articles: DataFrame, names: DataFrame) -> DataFrame:
    """Missing ids come from ``source``; known display names become ids. ``names``: name, id."""
    filled = articles.withColumn("source_id", F.coalesce("source_id", "source"))
    known = names.select(F.col("name").alias("source_id"), F.col("id").alias("_known"))
    return filled.join(known, "source_id", "left").withColumn("source_id", F.coalesce("_known", "source_id")).drop("_known")


# ---- joins -----------------------------------------------------------------------------------

def _runs(text: str | Column, lengths: Column) -> Column:
    """Distinct character runs of the given lengths."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.when(F.length(col) >= n, F.transform(
        F.sequence(F.lit(1), F.length(col) - n + 1), lambda at: F.substring(col, at, n))).otherwise(F.array().cast("array<string>")))))


def substring_candidates(texts: DataFrame, text: str, needles: DataFrame, needle: str, wildcards: bool = False) -> DataFrame:
    """(text, needle) that share the needle's signature: of the three-character runs of its longest plain part the one in the fewest texts
    (the whole part if it is shorter, nothing if there is none). A needle with a run that no text has meets no text."""
    part = F.array_sort(F.split(needle, "[%_]"), lambda a, b: F.length(b) - F.length(a))[0] if wildcards else F.col(needle)
    wanted = fence(needles.select(needle).distinct().where(F.length(needle) > 0), _part=part)
    wanted = wanted.select(needle, F.explode(F.when(F.length("_part") < 3, F.array("_part")).otherwise(_runs("_part", F.array(F.lit(3))))).alias("_run"))
    hay = texts.select(text).distinct().where(F.length(text) > 0)
    hay = hay.select(text, F.explode(F.array_append(_runs(text, F.sequence(F.lit(1), F.lit(3))), F.lit(""))).alias("_run"))
    hay = hay.join(wanted.select("_run").distinct(), "_run", "left_semi")
    counted = wanted.join(hay.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")), "_run", "left")
    rarest = counted.groupBy(needle).agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"), F.count_if(F.col("_n").isNull()).alias("_lost"))
    return hay.join(rarest.where("_lost = 0").select(needle, "_run"), "_run").select(text, needle)


def substring_pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str, wildcards: bool = False) -> DataFrame:
    """All (text, needle) with the needle inside the text, without comparing everything with everything: candidates by the needle's rarest
    run, then the whole needle. With ``wildcards`` % and _ match as in LIKE."""
    hit = F.like(F.col(text), F.concat(F.lit("%"), needle, F.lit("%"))) if wildcards else F.contains(text, F.col(needle))
    return substring_candidates(texts, text, needles, needle, wildcards).where(hit)


def map_source_name(raw: DataFrame, name: str, sources: DataFrame) -> DataFrame:
    """Raw source text to key: exact key, exact normalized name, then containment either way (smallest key)."""
    dim = sources.where("key IS NOT NULL AND key <> ''").select("key", normalize_name(F.col("name")).alias("norm")).where("norm <> ''")
    asked = raw.select(F.col(name).alias("raw")).where("raw IS NOT NULL AND raw <> ''").distinct().withColumn("raw_norm", normalize_name(F.col("raw")))
    exact_key = asked.join(sources.select(F.col("key").alias("raw")).distinct(), "raw").select("raw", F.lit(1).alias("tier"), F.col("raw").alias("key"))
    exact_name = asked.join(dim, asked.raw_norm == dim.norm).select("raw", F.lit(2).alias("tier"), "key")
    # Exact hits leave before names are compared by containment.
    left = asked.join(exact_key.unionByName(exact_name).select("raw"), "raw", "left_anti")
    inside = substring_pairs(left, "raw_norm", dim, "norm")
    around = substring_pairs(dim, "norm", left, "raw_norm").select("raw_norm", "norm")
    partial = inside.unionByName(around).distinct().join(dim, "norm").join(left, "raw_norm").select("raw", F.lit(3).alias("tier"), "key")
    best = exact_key.unionByName(exact_name).unionByName(partial).groupBy("raw").agg(F.min(F.struct("tier", "key")).alias("b"))
    return best.select(F.col("raw").alias(name), F.col("b.key").alias("source_key"), F.col("b.tier").alias("tier"))


def update_from(rows: DataFrame, other: DataFrame, on: str, fill: Sequence[str]) -> DataFrame:
    """Fill missing columns from a table with one row per key."""
    side = other.select(on, *[F.col(c).alias(f"_o_{c}") for c in fill])
    joined = rows.join(side, on, "left")
    return joined.select(*[F.coalesce(c, f"_o_{c}").alias(c) if c in fill else F.col(c) for c in rows.columns])


def article_entities(articles: DataFrame, bridge: DataFrame, entities: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct entity names of each article over its first ``limit`` links."""
    from pressmill.operators.ordered import top_k

    links = top_k(bridge.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi"),
                  ["article_id"], [F.col("entity_id")], limit, F.col("entity_id"))
    named = links.join(entities.select(F.col("id").alias("entity_id"), F.coalesce(F.nullif("name", F.lit("")), F.nullif("normalized_name", F.lit(""))).alias("n")), "entity_id")
    return named.where("n IS NOT NULL").groupBy("article_id").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("entity_id", "n"))), lambda x: x["n"])).alias("entities"))


# ---- paging ----------------------------------------------------------------------------------

def encode_cursor(published: Column, item_id: Column) -> Column:
    """URL-safe base64 of "time|id" without padding; a missing time is an empty text."""
    text = F.concat_ws("|", F.coalesce(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), item_id.cast("string"))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(token: str | None) -> tuple[str | None, int] | None:
    if not token:
        return None
    try:
        text = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
        when, item_id = text.split("|", 1)
        return when or None, int(item_id)
    except (ValueError, UnicodeDecodeError):
        return None


def feed_page(feed: DataFrame, limit: int = 50, cursor: str | None = None, source_type: str | None = None, language: str | None = None) -> DataFrame:
    """Newest first, items without time before all; each row carries the cursor of the page that follows it."""
    rows = optional_filter(feed.where(~F.col("is_deleted")), {"source_type": source_type, "language": language})
    at = decode_cursor(cursor)
    if at:
        when, item_id = at
        after_id = F.col("id") < item_id
        if when is None:
            rows = rows.where((F.col("published_at").isNull() & after_id) | F.col("published_at").isNotNull())
        else:
            t = as_time(when.replace("T", " "))
            rows = rows.where((F.col("published_at") < t) | ((F.col("published_at") == t) & after_id))
    page = rows.orderBy(F.col("published_at").desc_nulls_first(), F.desc("id")).limit(limit)
    return page.withColumn("next_cursor", encode_cursor(F.col("published_at"), F.col("id")))


def preview(articles: DataFrame, limit: int = 10) -> DataFrame:
    """The newest by publication, shown by effective time."""
    raw = articles.select("id", "title", "url", "source", "summary", "published_at", "created_at").orderBy(
        F.col("published_at").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.desc("id")).limit(max(limit, 30))
    shown = raw.orderBy(effective().desc_nulls_last(), F.desc("id")).limit(limit)
    return shown.withColumn("category_guess", rules.category(F.col("title"), F.col("summary")))


def list_recent(df: DataFrame, n: int, status: str | None = None, ts: str = "created_at", key: str = "id") -> DataFrame:
    return optional_filter(df, {"status": status}).orderBy(F.col(ts).desc_nulls_first(), F.desc(key)).limit(n)


# ---- sets ------------------------------------------------------------------------------------

def union_by_id(articles: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Rows published or created in the window whose effective time lies in it: one filter, no union needed."""
    return articles.where(effective_from(before(as_of, hours=hours)))


def ordered_distinct(rows: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(pos).alias(pos))


def facets(items: DataFrame) -> DataFrame:
    """Distinct categories and sources of a result."""
    pair = items.groupBy("category_guess", "source").agg(F.count(F.lit(1)).alias("n"))
    one = lambda kind, c: pair.where(f"coalesce({c}, '') <> ''").groupBy(F.lit(kind).alias("facet"), F.col(c).alias("value")).agg(F.sum("n").alias("n"))
    return one("category", "category_guess").unionByName(one("source", "source"))
