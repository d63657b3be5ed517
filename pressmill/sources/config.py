"""Rule and configuration tables.

They are read with an explicit schema and carry real size statistics, so the optimizer itself decides
whether one is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A rule table written in code, as a local relation with known size."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct])


PAGE_SOURCE = "id STRING, name STRING, type STRING, url STRING, rss STRING, enabled BOOLEAN, is_active BOOLEAN, ingest_method STRING, language STRING"
SOCIAL_SOURCE = (
    "id STRING, name STRING, type STRING, subtype STRING, page_url STRING, page_handle STRING, rss STRING,"
    "language ARRAY<STRING>, region_coverage ARRAY<STRING>, enabled BOOLEAN"
)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def source_config(page: DataFrame, social: DataFrame) -> DataFrame:
    """One row per configured source: key, enabled, source_type. Social entries win over page entries of the same id."""
    method = F.lower(F.trim(F.coalesce("ingest_method", F.lit("page"))))
    pages = page.select(
        F.col("id").alias("source_key"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.when(method == "rss", "rss").otherwise("page").alias("source_type"), F.lit(0).alias("rank"))
    socials = social.select(
        F.col("id").alias("source_key"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.lit("social").alias("source_type"), F.lit(1).alias("rank"))
    return config_union(pages.unionByName(socials), "source_key", "rank").drop("rank")


def config_union(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Later entries of a key win."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("r"))
    return picked.select(key, "r.*")


def active_sources(config: DataFrame, requested: Sequence[str] | None = None) -> DataFrame:
    """``is_active`` overrides ``enabled``; an explicit request overrides both."""
    if requested is not None:
        return config.where(F.col("id").isin(list(requested)))
    return config.where(F.coalesce("is_active", "enabled", F.lit(False)))


# Names under which a source type may be written.
_TYPE_NAMES = {
    "rss": ["rss", "feed"], "web": ["web", "site", "website", "page"],
    "social_inbox": ["facebook", "fb", "social", "social_inbox", "inbox"],
}


def seed_rows(page: DataFrame, social: DataFrame) -> DataFrame:
    """Both configuration shapes as rows of the sources table."""
    method = F.lower(F.coalesce("ingest_method", F.lit("")))
    is_rss = (F.coalesce("rss", F.lit("")) != "") | (method == "rss")
    pages = page.where(~F.contains(method, F.lit("facebook")) & (F.coalesce("type", F.lit("")) != "facebook")).select(
        F.col("id").alias("key"), "name",
        F.coalesce(F.nullif("type", F.lit("")), F.when(is_rss, "rss").otherwise("web")).alias("raw_type"),
        F.when(is_rss, F.coalesce(F.nullif("rss", F.lit("")), "url")).otherwise(F.col("url")).alias("url"), "rss", F.coalesce("enabled", F.lit(True)).alias("is_active"))
    socials = social.select(
        F.col("id").alias("key"), "name", F.col("type").alias("raw_type"), F.col("page_url").alias("url"), "rss",
        F.coalesce("enabled", F.lit(True)).alias("is_active"))
    rows = socials.unionByName(pages).where("key IS NOT NULL AND key <> ''")
    kind = F.lower(F.trim("raw_type"))
    news = F.when((F.coalesce("rss", F.lit("")) != "") | F.endswith(F.coalesce("url", F.lit("")), F.lit(".xml")), "rss").otherwise("web")
    source_type = (
        F.when(kind.isin(*_TYPE_NAMES["rss"]), "rss").when(kind.isin(*_TYPE_NAMES["web"]), "web")
        .when(kind.isin(*_TYPE_NAMES["social_inbox"]), "social_inbox")
        .when(kind.isin("news", "article", "articles"), news).otherwise("web")
    )
    return rows.select("key", "name", source_type.alias("source_type"), "url", "is_active")


def expand_seeds(config: DataFrame) -> DataFrame:
    """Seed pages of each source: ``templates`` with a %d page number, over ``first_page``..``last_page``."""
    rows = config.select("source_key", F.explode("templates").alias("template"), "first_page", "last_page")
    numbered = rows.select("source_key", "template", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    return numbered.select("source_key", "page", F.replace("template", F.lit("%d"), F.col("page").cast("string")).alias("url"))


def seed_mode(sitemap: DataFrame, feed: DataFrame, category: DataFrame) -> DataFrame:
    """Each source uses its first non-empty kind of seeds: sitemap, then feed, then category pages."""
    ranked = None
    for rank, (mode, df) in enumerate([("sitemap", sitemap), ("rss", feed), ("category", category)]):
        part = df.select("source_key", "url", "pos", F.lit(mode).alias("mode"), F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("source_key").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["source_key", "rank"]).drop("rank")


def config_documents(config: DataFrame, as_of) -> DataFrame:
    """Configuration rows that are themselves one document."""
    from pressmill.functions import urls
    from pressmill.functions.times import as_time

    link = urls.canonical_feed(F.col("url"), F.col("drop_params"))
    return config.where(F.col("type") == "pdf_listing").select(
        F.col("key").alias("source_key"), F.sha1(link).alias("external_id"), link.alias("url"), F.lit("document").alias("source_type"),
        F.coalesce("language", F.lit("mixed")).alias("language"), as_time(as_of).alias("published_at"))
