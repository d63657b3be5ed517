"""Topic relevance, budgets and merged topic items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions import rules, urls
from pressmill.functions.text import blank, contains_any_of, strip
from pressmill.functions.times import as_time
from pressmill.operators.fence import fence
from pressmill.operators.ordered import top_k


def discovered_items(links: DataFrame, as_of, language: str = "mixed") -> DataFrame:
    """Feed items of newly found procurement links."""
    return links.select(
        urls.external_id(F.col("link")).alias("external_id"), F.col("link").alias("url"), "source_key",
        F.lit("article").alias("source_type"), F.lit("").alias("title"), F.lit(language).alias("language"),
        as_time(as_of).alias("published_at"),
    )


def prepared_topics(topics: DataFrame) -> DataFrame:
    """Lower-cased terms, the default places, and the keywords behind the tags."""
    words = F.create_map(*[x for tag, keys in rules.TAGS.items() for x in (F.lit(tag), F.array(*map(F.lit, keys)))])
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    places = F.when(F.coalesce(F.size("location_terms"), F.lit(0)) > 0, F.col("location_terms")).otherwise(F.array(*map(F.lit, rules.LOCATION_TERMS)))
    return topics.select(
        "topic_key", "priority", "topic_lang", "tags", "max_processed", "preferred_domains",
        low(places).alias("places"),
        *[F.filter(low(F.col(c)), lambda x: x != "").alias(c) for c in ("require_terms", "require_terms_any", "require_terms_any2")],
        F.flatten(F.filter(F.transform("tags", lambda t: F.try_element_at(words, t)), lambda x: x.isNotNull())).alias("keywords"),
    )


def judged(items: DataFrame, topics: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = rules.SOCIAL_DOMAINS) -> DataFrame:
    """Every item with its canonical URL, domain and skip reason (NULL: relevant)."""
    joined = items.join(prepared_topics(topics), "topic_key")
    text = F.lower(strip(F.concat_ws(" ", strip(blank(F.col("title"))), strip(blank(F.col("snippet"))))))
    rows = fence(joined, norm=urls.canonical_feed(F.col("url")), blob=text)
    rows = fence(rows, domain=urls.domain(F.col("norm")))
    has = lambda c: contains_any_of(F.col("blob"), F.col(c))
    given = lambda c: F.size(c) > 0
    preferred = F.coalesce(F.array_contains("preferred_domains", F.col("domain")), F.lit(False))
    relevant = has("places") & (
        F.when(given("require_terms_any") & given("require_terms_any2"), (has("require_terms_any") & has("require_terms_any2")) | preferred)
        .when(given("require_terms") & ~has("require_terms"), preferred).otherwise(has("keywords"))
    )
    reason = F.when(F.col("url").isNull() | (F.col("url") == ""), "missing_url")
    if allow:
        reason = reason.when((F.col("domain") != "") & ~F.col("domain").isin(*allow), "allowlist")
    reason = reason.when(F.col("domain").isin(*deny), "denylist").when(~relevant, "not_relevant")
    return rows.select(*items.columns, "priority", "topic_lang", "tags", "norm", "domain", reason.alias("skip_reason"))


def run_order() -> list[Column]:
    return [F.col("priority"), F.col("topic_key"), F.col("pos")]


def relevance_filter(items: DataFrame, topics: DataFrame, **lists: Sequence[str]) -> DataFrame:
    """Adds ``skip_reason`` with later copies of an accepted URL marked duplicate, the rest accepted."""
    rows = judged(items, topics, **lists)
    firsts = rows.where("skip_reason IS NULL").groupBy("norm").agg(F.min(F.struct(*run_order())).alias("first"))
    marked = rows.join(firsts, "norm", "left")
    own = F.struct(*run_order()) == F.col("first")
    reason = F.coalesce("skip_reason", F.when(own, "accepted").otherwise("duplicate"))
    return marked.withColumn("skip_reason", reason).drop("first")


def topic_budget(items: DataFrame, topics: DataFrame, max_total: int) -> DataFrame:
    """The items each topic may process, topics in priority order.

    An item without URL takes a place in its topic's slice but not from the run's budget, so the room of a topic
    depends on the ones before it. That fold runs over at most ``max_total`` flags per configured topic.
    """
    caps = topics.select("topic_key", "priority", F.when(F.col("max_processed") > 0, F.least("max_processed", F.lit(max_total))).otherwise(max_total).alias("cap"))
    sliced = top_k(items, ["topic_key"], [F.col("pos")], max_total, F.col("pos"), "i").join(caps, "topic_key").where(F.col("i") <= F.col("cap"))
    has_url = F.coalesce(F.col("url") != "", F.lit(False))
    flags = sliced.groupBy("priority", "topic_key", "cap").agg(F.sort_array(F.collect_list(F.struct("i", has_url.alias("has")))).alias("flags"))
    ordered = flags.agg(F.sort_array(F.collect_list(F.struct("priority", "topic_key", "cap", "flags"))).alias("topics"))

    def step(acc: Column, t: Column) -> Column:
        room = F.greatest(F.lit(0), F.least(t["cap"], F.lit(max_total) - acc["done"]))
        used = F.size(F.filter(t["flags"], lambda f: (f["i"] <= room) & f["has"]))
        return F.struct(
            (acc["done"] + used).alias("done"),
            F.concat(acc["rooms"], F.array(F.struct(t["topic_key"].alias("topic_key"), room.alias("room")))).alias("rooms"))

    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<struct<topic_key:string,room:int>>").alias("rooms"))
    rooms = ordered.select(F.explode(F.aggregate("topics", start, step, lambda acc: acc["rooms"])).alias("r")).select("r.*")
    return sliced.join(rooms, "topic_key").where(F.col("i") <= F.col("room")).select(*items.columns)


def topic_merge(items: DataFrame, topics: DataFrame, **lists: Sequence[str]) -> DataFrame:
    """One row per URL: the first item, and topics, tags and raw URLs in first-seen order.

    Besides the first item each topic adds its first further copy, so no more than two rows per URL and
    topic are ever brought together.
    """
    rows = judged(items, topics, **lists).where("skip_reason IS NULL")
    two = top_k(rows.select("norm", "topic_key", "priority", "pos", "tags", "url"), ["norm", "topic_key"], [F.col("pos")], 2, F.col("pos"), "rn")
    seen = two.groupBy("norm").agg(
        F.sort_array(F.collect_list(F.struct("priority", "topic_key", "pos", "tags", "url", "rn"))).alias("all"))
    # Of the first item's own topic both rows count; of any other topic only the first.
    used = F.filter("all", lambda x: (x["rn"] == 1) | (x["topic_key"] == F.get(F.col("all"), 0)["topic_key"]))
    first = F.get(F.col("used"), 0)
    return seen.select("norm", used.alias("used")).select(
        F.col("norm").alias("url"), F.sha1("norm").alias("external_id"), first["topic_key"].alias("topic_key"), first["pos"].alias("pos"),
        F.array_distinct(F.transform("used", lambda x: x["topic_key"])).alias("topics_found"),
        F.array_distinct(F.flatten(F.transform("used", lambda x: x["tags"]))).alias("tags"),
        F.array_distinct(F.transform("used", lambda x: x["url"])).alias("raw_urls"),
        F.array_distinct(F.transform(F.filter("used", lambda x: x["rn"] == 1), lambda x: x["url"])).alias("topic_urls"),
    )


def topic_ingest(items: DataFrame, topics: DataFrame, stored_ids: DataFrame, as_of, max_total: int = 500) -> tuple[DataFrame, DataFrame]:
    """Budget, relevance, merge and feed items; plus the judged rows for the run's statistics.

    ``stored_ids``: external_id and, where kept, the stored item's topics_found, tags and raw_urls. What a known item gains is
    appended to its stored lists; each topic adds one raw URL to it.
    """
    taken = topic_budget(items, topics, max_total)
    lists = ["topics_found", "tags", "raw_urls"]
    kept = [F.first(c, ignorenulls=True).alias("_" + c) if c in stored_ids.columns else F.first(F.array().cast("array<string>")).alias("_" + c) for c in lists]
    stored = stored_ids.groupBy("external_id").agg(*kept).withColumn("known", F.lit(True))
    merged = topic_merge(taken, topics).join(stored, "external_id", "left")
    merged = merged.withColumn("raw_urls", F.when(F.col("known"), F.col("topic_urls")).otherwise(F.col("raw_urls")))
    merged = merged.withColumns({c: F.array_distinct(F.concat(F.coalesce("_" + c, F.array().cast("array<string>")), c)) for c in lists})
    detail = taken.select("topic_key", "pos", "title", "seendate", F.col("language").alias("item_lang"))
    langs = topics.select("topic_key", "topic_lang")
    seen = F.try_to_timestamp("seendate", F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    built = merged.join(detail, ["topic_key", "pos"]).join(langs, "topic_key").select(
        "external_id", "url", "title", F.lit("article").alias("source_type"),
        F.coalesce("topic_lang", F.nullif("item_lang", F.lit("")), F.lit("unknown")).alias("language"),
        F.coalesce(seen, as_time(as_of)).alias("published_at"), "topic_key", "topics_found", "tags", "raw_urls",
        F.coalesce("known", F.lit(False)).alias("known"),
    )
    return built, relevance_filter(taken, topics)


def topic_stats(found: DataFrame, judged_rows: DataFrame, stored_ids: DataFrame) -> DataFrame:
    known = stored_ids.select(F.col("external_id").alias("_x")).distinct()
    rows = judged_rows.withColumn("_x", F.sha1("norm")).join(known.withColumn("known", F.lit(True)), "_x", "left")
    r, old = F.col("skip_reason"), F.coalesce("known", F.lit(False))
    counts = rows.groupBy("topic_key").agg(
        F.count_if(r != "missing_url").alias("processed"),
        F.count_if((r == "accepted") & ~old).alias("inserted_new"), F.count_if((r == "accepted") & old).alias("updated_existing"),
        F.count_if(r == "duplicate").alias("dedup_existing"),
        *[F.count_if(r == n).alias(f"skipped_{n}") for n in ("missing_url", "denylist", "allowlist", "not_relevant")],
        F.count_if((r == "duplicate") | ((r == "accepted") & old)).alias("skipped_duplicate"),
    )
    totals = found.groupBy("topic_key").agg(F.count(F.lit(1)).alias("found"))
    return totals.join(counts, "topic_key", "left").na.fill(0)


