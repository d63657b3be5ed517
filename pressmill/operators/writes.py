"""Write policies as (existing, incoming) -> new snapshot.

A snapshot is written to a new folder and never over the one being read. Incoming rows are first reduced to one
per key with map-side combine, so a key that arrives very often does not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions.text import json_string, normalize_entity
from pressmill.functions.times import as_time
from pressmill.operators.ordered import first_per_key


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """Supplied columns replace, others keep. ``seq`` orders rows of one key; the last wins and it is not stored."""
    new = incoming
    if seq:
        new = first_per_key(incoming, keys, [F.col(seq)], last=True).drop(seq)
    supplied = [c for c in new.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in supplied], F.lit(True).alias("_new"))
    joined = existing.join(renamed, list(keys), "full_outer")
    columns = [*existing.columns, *[c for c in supplied if c not in existing.columns]]

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in supplied:
            return F.col(c)
        old = F.col(c) if c in existing.columns else F.lit(None)
        return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(old).alias(c)

    return joined.select(*[pick(c) for c in columns])


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    new = incoming.select(*keys).distinct()
    known = existing.select(*keys).distinct().withColumn("_old", F.lit(True))
    return new.join(known, list(keys), "left").agg(
        F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old")).alias("updated"))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that are inserted: first of each key, none whose key is stored."""
    firsts = first_per_key(incoming, keys, [F.col(c) for c in order])
    return firsts.join(existing.select(*keys), list(keys), "left_anti")


# The fields of an item's identity hash, in the order of their sorted names.
HASH_FIELDS = ["content", "external_id", "summary", "title", "url"]


def item_hash() -> Column:
    parts: list[Column] = []
    for n, field in enumerate(HASH_FIELDS):
        parts += [F.lit(("{" if n == 0 else ", ") + f'"{field}": '), json_string(F.col(field))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def keyed_items(items: DataFrame, as_of) -> DataFrame:
    """Fill the hash and the publication time; the row key is the external id, else the hash."""
    filled = items.withColumn("hash", F.coalesce(F.nullif("hash", F.lit("")), item_hash()) if "hash" in items.columns else item_hash())
    return filled.withColumn("published_at", F.coalesce("published_at", as_time(as_of))).withColumn(
        "item_key", F.coalesce(F.nullif("external_id", F.lit("")), "hash"))


def upsert_feed_items(existing: DataFrame, incoming: DataFrame, as_of, seq: str) -> DataFrame:
    return upsert(keyed_items(existing, as_of), keyed_items(incoming, as_of), ["item_key"], seq)


def upsert_quotes(existing: DataFrame, incoming: DataFrame, as_of, seq: str) -> DataFrame:
    new = incoming.withColumn("fetched_at", as_time(as_of))
    return upsert(existing, new, ["instrument", "rate_type", "quote_currency"], seq)


def advance_cursors(cursors: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    newest = matches.groupBy("alert_id").agg(F.max("ts").alias("max_ts")).where("max_ts IS NOT NULL")
    rows = cursors.join(newest, "alert_id", "full_outer")
    moved = F.col("max_ts").isNotNull()
    old_update = F.col("updated_at") if "updated_at" in cursors.columns else F.lit(None).cast("timestamp_ntz")
    return rows.select("alert_id", F.greatest("last_ts", "max_ts").alias("last_ts"), F.when(moved, as_time(as_of)).otherwise(old_update).alias("updated_at"))


# Preference defaults.
def pref_defaults() -> dict[str, Column]:
    return {
        "dedupe_window_sec": F.lit(21600), "immediate_priorities": F.array(F.lit("P0")),
        "digest_priorities": F.array(F.lit("P1"), F.lit("P2")), "digest_schedule": F.lit("daily"),
        "channels_enabled": F.array(F.lit("email")),
    }


def upsert_prefs(existing: DataFrame, incoming: DataFrame, mode: str = "reset") -> DataFrame:
    """``reset``: an omitted field goes back to its default. ``keep``: it keeps the stored value."""
    defaults = pref_defaults()
    fields = [*defaults, "priority_categories"]
    new = incoming.select("user_id", *[F.col(c).alias(f"n_{c}") for c in fields], F.lit(True).alias("n_hit"))
    rows = existing.select("user_id", *fields, F.lit(True).alias("o_hit")).join(new, "user_id", "full_outer")

    def value(c: str) -> Column:
        given = F.col(f"n_{c}")
        if c == "priority_categories":
            return F.coalesce(F.when(F.size(given) > 0, given), F.col(c)).alias(c)
        fresh = F.coalesce(given, defaults[c])
        updated = fresh if mode == "reset" else F.coalesce(given, F.when(F.col("o_hit"), F.col(c)), defaults[c])
        return F.when(F.col("n_hit"), updated).otherwise(F.col(c)).alias(c)

    return rows.select("user_id", *[value(c) for c in fields])


# Entity lists of an item and the type each stands for.
ENTITY_TYPES = {"orgs": "org", "people": "person", "locations": "location", "topics": "topic"}


def entity_mentions(items: DataFrame, item_id: str = "id") -> DataFrame:
    """(article, name, type, normalized name) for every name in the four lists."""
    lists = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(n).alias("rank"), F.col(f"entities.{field}").alias("names"))
                      for n, (field, kind) in enumerate(ENTITY_TYPES.items())])
    rows = items.select(F.col(item_id).alias("article_id"), F.explode(lists).alias("l")).select(
        "article_id", "l.type", "l.rank", F.posexplode("l.names").alias("at", "name"))
    return rows.withColumn("normalized_name", normalize_entity(F.col("name"))).where("normalized_name <> ''")


def upsert_entities(items: DataFrame, entities: DataFrame, links: DataFrame, item_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """New entity snapshot (last mention wins for name and type) and the new article links."""
    mentions = entity_mentions(items, item_id)
    last = mentions.groupBy("normalized_name").agg(
        F.max_by(F.struct("name", "type"), F.struct("article_id", "rank", "at")).alias("e")).select("normalized_name", "e.*")
    merged = upsert(entities, last, ["normalized_name"])
    pairs = mentions.select("article_id", "normalized_name").distinct()
    return merged, pairs.join(links.select("article_id", "normalized_name"), ["article_id", "normalized_name"], "left_anti")


def enqueue_fetch(queue: DataFrame, incoming: DataFrame, as_of) -> DataFrame:
    """New queue rows: none while an active row has the same source, URL and reason."""
    keys = ["source_id", "url", "reason"]
    active = queue.where(F.col("status").isin("queued", "running")).select(*keys)
    rows = incoming.where("coalesce(source_id, '') <> '' AND coalesce(url, '') <> ''").select(*keys).distinct()
    return rows.join(active, keys, "left_anti").withColumns({
        "status": F.lit("queued"), "attempts": F.lit(0), "next_run_at": as_time(as_of), "created_at": as_time(as_of)})


def apply_assignments(requests: DataFrame, assignments: DataFrame, as_of, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Requests with their partner, and one lead row per assignment. Of several assignments of a request the last by ``seq`` stays (the
    larger partner of equal ones)."""
    new = assignments.where("partner_id IS NOT NULL").select(F.col("request_id").alias("id"), F.col("partner_id").alias("n_partner"), F.col(seq).alias("n_seq"))
    last = new.groupBy("id").agg(F.max_by("n_partner", F.struct("n_seq", "n_partner")).alias("n_partner"))
    rows = requests.join(last, "id", "left")
    hit = F.col("n_partner").isNotNull()
    updated = rows.withColumns({
        "assigned_partner_id": F.coalesce("n_partner", "assigned_partner_id"),
        "status": F.when(hit, "assigned").otherwise(F.col("status")),
        "updated_at": F.when(hit, as_time(as_of)).otherwise(F.col("updated_at")),
    }).drop("n_partner")
    leads = assignments.select("partner_id", "request_id", F.lit("sent").alias("status"), as_time(as_of).alias("sent_at"))
    return updated, leads


def save_report(report: DataFrame, path: str) -> None:
    """Append report rows to the report table."""
    report.write.mode("append").parquet(path)


def run_row(metrics: DataFrame, job_name: str, started, finished) -> DataFrame:
    """One run-log row from per-source counters; ok means nothing failed and nothing was blocked."""
    meta = F.struct(*[F.col(c) for c in metrics.columns if c != "source_key"])
    return metrics.agg(
        F.map_from_entries(F.collect_list(F.struct("source_key", meta))).alias("by_source"),
        (F.coalesce(F.sum("failed"), F.lit(0)) + F.coalesce(F.sum("blocked"), F.lit(0)) == 0).alias("ok"),
    ).select(F.lit(job_name).alias("job_name"), as_time(started).alias("started_at"), as_time(finished).alias("finished_at"), "ok",
             F.struct("by_source").alias("stats"))
