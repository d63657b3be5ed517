"""Predicate, join, paging, set and write-policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import rules
from pressmill.operators import metrics as m, tables as tb, writes as w
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.session import scratch_path
from pressmill.sources.bind import AS_OF

T = "TIMESTAMP '2024-01-31'"
LOW = "lower(coalesce(title,'') || ' ' || coalesce(summary,''))"

# ---- predicates ------------------------------------------------------------------------------


@query("effective_time_filter", f"SELECT id FROM fx_articles WHERE coalesce(published_at, created_at) >= {T} - INTERVAL 3 DAY")
def _(t):
    return tb.recent(t.articles, AS_OF, 3).select("id")


@query("optional_filter", "SELECT id FROM fx_articles WHERE language = 'en' AND source_type = 'article'")
def _(t):
    return tb.optional_filter(t.articles, {"language": "en", "category": None, "source_type": "article"}).select("id")


@query("ilike_any", "SELECT id FROM fx_articles WHERE title ILIKE '%tender_and%' OR summary ILIKE '%tender_and%' OR content ILIKE '%tender_and%'")
def _(t):
    return tb.ilike_filter(t.articles, ["title", "summary", "content"], "TENDER_and").select("id")


@query("soft_delete_filter", "SELECT source_id, count(*) AS n FROM fx_articles WHERE NOT is_deleted GROUP BY 1")
def _(t):
    return m.live(t.feed).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("in_list", "SELECT id FROM fx_articles WHERE url IN (SELECT url FROM fx_articles WHERE category = 'Energy')")
def _(t):
    return tb.in_list(t.articles, t.articles.where("category = 'Energy'"), "url").select("id")


@query("any_array", "SELECT user_id FROM fx_prefs WHERE list_contains(channels_enabled, 'telegram')")
def _(t):
    return t.prefs.where(F.array_contains("channels_enabled", "telegram")).select("user_id")


@query("json_exists_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return tb.json_rows(t.raw("events").select("event_id", "props"), "props", "k", "$.k", "k").select("event_id", "k")


@query("null_default", "SELECT id, coalesce(query, '') AS query, coalesce(days, 7) AS days, nullif(category, '') AS category, nullif(source, '') AS source FROM fx_searches")
def _(t):
    s = t.searches
    return s.select("id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("days", F.lit(7)).alias("days"),
                    F.nullif("category", F.lit("")).alias("category"), F.nullif("source", F.lit("")).alias("source"))


@query("enum_validate", """SELECT CASE WHEN quote_currency <> 'LYD' THEN 'quote_currency' WHEN rate_type NOT IN ('official','parallel') THEN 'rate_type' ELSE 'ok' END AS verdict, count(*) AS n FROM fx_quotes GROUP BY 1""")
def _(t):
    good, bad = tb.enum_validate(t.quotes, {"quote_currency": ["LYD"], "rate_type": ["official", "parallel"]})
    return good.select(F.lit("ok").alias("verdict")).unionByName(bad.select(F.col("rejected_by").alias("verdict"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _items(t):
    """Feed items with entity lists made from the words of their text."""
    word = lambda n: f"element_at(split(title, ' '), {n})"
    lists = (f"named_struct('orgs', CASE WHEN id % 4 = 0 THEN array({word(-1)}, concat(' ', upper({word(-2)}), '  x')) END, 'people', CASE WHEN id % 4 = 1 THEN array({word(-2)}) ELSE CAST(array() AS ARRAY<STRING>) END,"
             f" 'locations', CAST(NULL AS ARRAY<STRING>), 'topics', CASE WHEN id % 4 < 2 THEN array({word(-3)}, ' ') END) AS entities")
    return t.articles.selectExpr("id", "title", lists)


ENT = """words AS (SELECT id, string_split(title, ' ') AS s FROM fx_articles), men AS (
    SELECT id AS article_id, s[-1] AS name, 'org' AS type, 0 AS rank, 0 AS pos FROM words WHERE id % 4 = 0 UNION ALL SELECT id, ' ' || upper(s[-2]) || '  x', 'org', 0, 1 FROM words WHERE id % 4 = 0
    UNION ALL SELECT id, s[-2], 'person', 1, 0 FROM words WHERE id % 4 = 1 UNION ALL SELECT id, s[-3], 'topic', 3, 0 FROM words WHERE id % 4 < 2),
  mm AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS normalized_name FROM men), m AS (SELECT * FROM mm WHERE normalized_name <> '')"""


@query("needs_entities", "SELECT id FROM fx_articles WHERE id % 4 >= 2")
def _(t):
    return tb.needs_entities(_items(t)).select("id")


@query("reconcile_source_ids", """SELECT a.id, coalesce(s.key, 'Desk ' || a.source) AS source_id FROM fx_articles a LEFT JOIN fx_sources s ON 'Desk ' || s.key = 'Desk ' || a.source""")
def _(t):
    rows = t.articles.select("id", F.lit(None).cast("string").alias("source_id"), F.col("source_name").alias("source"))
    names = t.sources.select(F.concat(F.lit("Desk "), "key").alias("name"), F.col("key").alias("id"))
    return tb.reconcile_source_ids(rows, names).select("id", "source_id")


# ---- joins -----------------------------------------------------------------------------------

@query("map_source_name", """WITH x AS (SELECT id, CASE WHEN id % 5 = 0 THEN source WHEN id % 5 = 1 THEN 'SOURCE ' || substr(source, 4) || ' (weekly)' WHEN id % 5 = 2 THEN 'The Source ' || substr(source, 4) || ' Post' WHEN id % 5 = 3 THEN 'Sour' ELSE 'Other' END AS raw FROM fx_articles),
    n AS (SELECT *, lower(regexp_replace(regexp_replace(raw, '\\(.*\\)', '', 'g'), '[^\\p{L}\\p{N}]+', '', 'g')) AS rn FROM x), s AS (SELECT key, 'source' || substr(key, 4) AS sn FROM fx_sources),
    hits AS (SELECT raw, 1 AS tier, key FROM n JOIN s ON raw = key UNION ALL SELECT raw, 2, key FROM n JOIN s ON rn = sn UNION ALL SELECT raw, 3, key FROM n JOIN s ON contains(rn, sn) OR contains(sn, rn)),
    best AS (SELECT raw, arg_min(key, (tier, key)) AS source_key FROM hits GROUP BY 1)
    SELECT n.raw, source_key, count(*) AS n FROM n LEFT JOIN best USING (raw) GROUP BY ALL""")
def _(t):
    raw = ("CASE WHEN id % 5 = 0 THEN source WHEN id % 5 = 1 THEN concat('SOURCE ', substr(source, 4), ' (weekly)') WHEN id % 5 = 2 THEN concat('The Source ', substr(source, 4), ' Post')"
           " WHEN id % 5 = 3 THEN 'Sour' ELSE 'Other' END AS raw")
    rows = t.articles.selectExpr("id", raw)
    mapped = tb.map_source_name(rows, "raw", t.sources).drop("tier")
    return rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).join(mapped, "raw", "left").select("raw", "source_key", "n")


@query("anti_users_without_prefs", "SELECT DISTINCT user_id FROM fx_deliveries WHERE user_id NOT IN (SELECT user_id FROM fx_prefs)")
def _(t):
    return t.deliveries.select("user_id").distinct().join(t.prefs.select("user_id"), "user_id", "left_anti")


@query("update_from_join", """SELECT d.id, coalesce(a.url, NULL) AS normalized_url, coalesce(a.url, a.source_name || '|' || a.title, 'unknown:' || d.article_id) AS dedupe_key FROM fx_deliveries d LEFT JOIN fx_articles a ON a.id = d.article_id""")
def _(t):
    rows = t.deliveries.select("id", "article_id", F.lit(None).cast("string").alias("normalized_url"), F.lit(None).cast("string").alias("dedupe_key"))
    side = t.articles.select(F.col("id").alias("article_id"), F.col("url").alias("normalized_url"),
                             F.coalesce("url", F.concat("source_name", F.lit("|"), "title")).alias("dedupe_key"))
    filled = tb.update_from(rows, side, "article_id", ["normalized_url", "dedupe_key"])
    return filled.select("id", "normalized_url", F.coalesce("dedupe_key", F.concat(F.lit("unknown:"), "article_id")).alias("dedupe_key"))


def _entity_tables(t):
    mentions = w.entity_mentions(_items(t))
    ents = mentions.groupBy("normalized_name").agg(F.min("article_id").alias("n")).select(
        F.col("normalized_name").alias("id"), F.when(F.col("n") % 3 == 0, "").otherwise(F.concat(F.lit("N:"), "normalized_name")).alias("name"), "normalized_name")
    return mentions.select("article_id", F.col("normalized_name").alias("entity_id")).distinct(), ents


@query("join_entities", f"""WITH {ENT}, e AS (SELECT normalized_name AS id, CASE WHEN min(article_id) % 3 = 0 THEN normalized_name ELSE 'N:' || normalized_name END AS nm FROM m GROUP BY 1)
    SELECT article_id, string_agg(nm, '|' ORDER BY id) AS entities FROM (SELECT DISTINCT article_id, normalized_name AS id FROM m) JOIN e USING (id) GROUP BY 1""")
def _(t):
    bridge, ents = _entity_tables(t)
    return tb.article_entities(t.articles, bridge, ents).select("article_id", F.array_join("entities", "|").alias("entities"))


# ---- paging and sets -------------------------------------------------------------------------

@query("feed_page", """WITH p AS (SELECT id, published_at FROM fx_articles WHERE NOT is_deleted AND language = 'en' AND (published_at < TIMESTAMP '2024-01-20' OR (published_at = TIMESTAMP '2024-01-20' AND id < 500))
      ORDER BY published_at DESC NULLS FIRST, id DESC LIMIT 50)
    SELECT id, published_at, rtrim(translate(base64(encode(coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S'), '') || '|' || id)), '+/', '-_'), '=') AS next_cursor FROM p""")
def _(t):
    import base64

    token = base64.urlsafe_b64encode(b"2024-01-20T00:00:00|500").decode().rstrip("=")
    return tb.feed_page(t.feed, 50, token, language="en").select("id", "published_at", "next_cursor")


@query("feed_first_page", """SELECT id, published_at FROM fx_articles WHERE NOT is_deleted ORDER BY published_at DESC NULLS FIRST, id DESC LIMIT 200""")
def _(t):
    return tb.feed_page(t.feed, 200).select("id", "published_at")


@query("preview", f"""WITH r AS (SELECT * FROM fx_articles ORDER BY published_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id DESC LIMIT 30)
    SELECT id, title, published_at, created_at, {q.first_label(LOW, rules.CATEGORIES, 'General')} AS category_guess FROM r ORDER BY coalesce(published_at, created_at) DESC, id DESC LIMIT 10""")
def _(t):
    return tb.preview(t.articles, 10).select("id", "title", "published_at", "created_at", "category_guess")


@query("list_recent", "SELECT id, status, created_at FROM fx_deliveries WHERE status = 'FAILED' ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 200")
def _(t):
    return tb.list_recent(t.deliveries, 200, "FAILED").select("id", "status", "created_at")


@query("union_dedupe_by_id", f"""SELECT DISTINCT id FROM (SELECT id, published_at, created_at FROM fx_articles WHERE published_at >= {T} - INTERVAL 24 HOUR UNION ALL SELECT id, published_at, created_at FROM fx_articles WHERE created_at >= {T} - INTERVAL 24 HOUR)
    WHERE coalesce(published_at, created_at) >= {T} - INTERVAL 24 HOUR""")
def _(t):
    return tb.union_by_id(t.articles, AS_OF).select("id")


@query("ordered_distinct", "SELECT source_key, url, min(pos) AS pos FROM fx_candidates GROUP BY ALL")
def _(t):
    return tb.ordered_distinct(t.candidates, ["source_key", "url"], "pos")


@query("distinct_facets", f"""WITH x AS (SELECT source, {q.first_label(LOW, rules.CATEGORIES, 'General')} AS c FROM fx_articles) SELECT 'category' AS facet, c AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY ALL""")
def _(t):
    return tb.facets(t.articles.withColumn("category_guess", rules.category(F.col("title"), F.col("summary"))))


# ---- write policies --------------------------------------------------------------------------

@query("upsert_articles", """WITH inc AS (SELECT url, arg_max('v' || id, id) AS title, arg_max(language, id) AS language FROM fx_articles WHERE source_type = 'article' GROUP BY 1), old AS (SELECT url, 'old' AS title, 'keep' AS summary FROM (SELECT DISTINCT url FROM fx_articles WHERE language = 'en'))
    SELECT url, CASE WHEN inc.url IS NOT NULL THEN inc.title ELSE old.title END AS title, summary, inc.language FROM old FULL JOIN inc USING (url)""")
def _(t):
    old = t.articles.where("language = 'en'").select("url").distinct().select("url", F.lit("old").alias("title"), F.lit("keep").alias("summary"))
    new = t.articles.where("source_type = 'article'").select("url", F.concat(F.lit("v"), "id").alias("title"), "language", F.col("id").alias("seq"))
    return w.upsert(old, new, ["url"], "seq")


@query("upsert_counts", """SELECT count(*) FILTER (WHERE NOT known) AS inserted, count(*) FILTER (WHERE known) AS updated FROM (SELECT DISTINCT url, url IN (SELECT url FROM fx_articles WHERE language = 'en') AS known FROM fx_articles WHERE source_type = 'article')""")
def _(t):
    return w.upsert_counts(t.articles.where("language = 'en'"), t.articles.where("source_type = 'article'"), ["url"])


@query("upsert_feed_items", """WITH h AS (SELECT id, CASE WHEN id % 3 = 0 THEN url END AS x, published_at, '{"content": ' || to_json(content) || ', "external_id": ' || coalesce(to_json(CASE WHEN id % 3 = 0 THEN url END), 'null') || ', "summary": ' || to_json(summary) || ', "title": ' || to_json(title) || ', "url": ' || to_json(url) || '}' AS j FROM fx_articles),
    k AS (SELECT *, coalesce(x, sha256(j)) AS item_key FROM h)
    SELECT item_key, max(id) AS id, arg_max(sha256(j), id) AS hash, arg_max(coalesce(published_at, TIMESTAMP '2024-01-31'), id) AS published_at FROM k GROUP BY 1""")
def _(t):
    items = t.feed.select("id", F.expr("CASE WHEN id % 3 = 0 THEN url END AS external_id"), "url", "title", "summary", "content", "published_at")
    stored = items.where("title LIKE '%weather%'")
    done = w.upsert_feed_items(stored.dropDuplicates(["external_id"]).where("external_id IS NOT NULL"), items.withColumn("seq", F.col("id")), AS_OF, "seq")
    return done.select("item_key", "id", "hash", "published_at")


@query("insert_ignore", """SELECT min(id) AS id, url FROM fx_articles WHERE url NOT IN (SELECT url FROM fx_articles WHERE category = 'Energy') GROUP BY url""")
def _(t):
    return w.insert_ignore(t.articles.where("category = 'Energy'"), t.articles.select("id", "url"), ["url"], ["id"]).select("id", "url")


@query("upsert_quotes", """SELECT instrument, rate_type, quote_currency, arg_max(value, l_orderkey * 10 + l_linenumber + value / 1000000) AS value, TIMESTAMP '2024-01-31' AS fetched_at FROM fx_quotes GROUP BY ALL""")
def _(t):
    new = t.quotes.select("instrument", "rate_type", "quote_currency", "value", F.expr("l_orderkey * 10 + l_linenumber + value / 1000000").alias("seq"))
    old = t.quotes.groupBy("instrument", "rate_type", "quote_currency").agg(F.min("value").alias("value"), F.min("fetched_at").alias("fetched_at"))
    return w.upsert_quotes(old, new, AS_OF, "seq")


@query("advance_cursors", """WITH mt AS (SELECT alert_id, max(created_at) AS max_ts FROM fx_deliveries GROUP BY 1) SELECT alert_id, greatest(last_ts, max_ts) AS last_ts, CASE WHEN max_ts IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS updated_at
    FROM fx_cursors FULL JOIN mt USING (alert_id)""")
def _(t):
    return w.advance_cursors(t.cursors, t.deliveries.select("alert_id", F.col("created_at").alias("ts")), AS_OF)


PREFQ = """inc AS (SELECT DISTINCT c_custkey % 300 AS user_id, CASE WHEN c_custkey % 300 % 2 = 0 THEN 900 END AS nw, CASE WHEN c_custkey % 300 % 5 = 0 THEN 'sms' END AS nc FROM customer WHERE c_custkey % 300 < 200)"""


def _pref_input(t):
    users = t.raw("customer").selectExpr("c_custkey % 300 AS user_id").distinct().where("user_id < 200")
    none = "CAST(NULL AS ARRAY<STRING>)"
    return users.selectExpr("user_id", "CAST(CASE WHEN user_id % 2 = 0 THEN 900 END AS INT) AS dedupe_window_sec", f"{none} AS immediate_priorities", f"{none} AS digest_priorities",
                            f"{none} AS priority_categories", "CAST(NULL AS STRING) AS digest_schedule", "CASE WHEN user_id % 5 = 0 THEN array('sms') END AS channels_enabled")


@query("upsert_prefs", f"""WITH {PREFQ}, j AS (SELECT coalesce(p.user_id, i.user_id) AS user_id, p.*EXCLUDE(user_id), nw, nc, i.user_id IS NOT NULL AS hit, p.user_id IS NOT NULL AS old FROM fx_prefs p FULL JOIN inc i ON i.user_id = p.user_id)
    SELECT user_id, 'reset' AS mode, CAST(CASE WHEN hit THEN coalesce(nw, 21600) ELSE dedupe_window_sec END AS INT) AS dedupe_window_sec, CASE WHEN hit THEN coalesce(nc, 'email') ELSE array_to_string(channels_enabled, ',') END AS channels, CASE WHEN hit THEN 'daily' ELSE digest_schedule END AS digest_schedule FROM j
    UNION ALL SELECT user_id, 'keep', CAST(CASE WHEN hit THEN coalesce(nw, dedupe_window_sec, 21600) ELSE dedupe_window_sec END AS INT), CASE WHEN hit THEN coalesce(nc, array_to_string(channels_enabled, ','), 'email') ELSE array_to_string(channels_enabled, ',') END,
      CASE WHEN hit THEN coalesce(digest_schedule, 'daily') ELSE digest_schedule END FROM j""")
def _(t):
    out = None
    for mode in ("reset", "keep"):
        rows = w.upsert_prefs(t.prefs, _pref_input(t), mode).select(
            "user_id", F.lit(mode).alias("mode"), "dedupe_window_sec", F.array_join("channels_enabled", ",").alias("channels"), "digest_schedule")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("upsert_entities", f"""WITH {ENT}, old AS (SELECT DISTINCT normalized_name FROM m WHERE article_id % 2 = 0 UNION ALL SELECT 'kept ' || r FROM range(5) x(r)), lk AS (SELECT DISTINCT article_id, normalized_name FROM m WHERE article_id % 4 = 0),
    new AS (SELECT normalized_name, arg_max(name, (article_id, rank, pos)) AS name, arg_max(type, (article_id, rank, pos)) AS type FROM m GROUP BY 1),
    p AS (SELECT normalized_name, count(*) AS links FROM (SELECT DISTINCT article_id, normalized_name FROM m ANTI JOIN lk USING (article_id, normalized_name)) GROUP BY 1)
    SELECT normalized_name, coalesce(new.name, 'old name') AS name, coalesce(new.type, 'OLD') AS type, links FROM old FULL JOIN new USING (normalized_name) LEFT JOIN p USING (normalized_name)""")
def _(t):
    mentions = w.entity_mentions(_items(t), "id")
    half = mentions.where("article_id % 2 = 0").select("normalized_name").distinct().unionByName(t.spark.range(5).select(F.concat(F.lit("kept "), "id").alias("normalized_name")))
    ents = half.select("normalized_name", F.lit("old name").alias("name"), F.lit("OLD").alias("type"))
    links = mentions.where("article_id % 4 = 0").select("article_id", "normalized_name").distinct()
    merged, pairs = w.upsert_entities(_items(t), ents, links)
    return merged.join(pairs.groupBy("normalized_name").agg(F.count(F.lit(1)).alias("links")), "normalized_name", "left")


@query("enqueue_fetch", f"""WITH act AS (SELECT DISTINCT source_id, url FROM fx_articles WHERE summary_status = 'PENDING')
    SELECT DISTINCT source_id, url, 'blocked' AS reason, 'queued' AS status, 0 AS attempts, {T} AS next_run_at FROM fx_articles a WHERE content_kind = 'title_only' AND NOT EXISTS (SELECT 1 FROM act WHERE act.source_id = a.source_id AND act.url = a.url)""")
def _(t):
    queue = t.articles.select("source_id", "url", F.lit("blocked").alias("reason"), F.when(F.col("summary_status") == "PENDING", "running").otherwise("done").alias("status"))
    new = t.articles.where("content_kind = 'title_only'").select("source_id", "url", F.lit("blocked").alias("reason"))
    return w.enqueue_fetch(queue, new, AS_OF).drop("created_at")


@query("apply_assignments", f"""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 'p0' END AS p FROM orders),
    s AS (SELECT l_orderkey AS id, 'p' || l_suppkey AS np, l_shipdate AS d, l_linenumber AS k FROM lineitem WHERE l_quantity > 40), a AS (SELECT id, arg_max(np, (d, k, np)) AS np FROM s GROUP BY 1)
    SELECT r.id, coalesce(np, p) AS assigned_partner_id, CASE WHEN np IS NOT NULL THEN 'assigned' ELSE status END AS status, CASE WHEN np IS NOT NULL THEN {T} END AS updated_at FROM r LEFT JOIN a USING (id)""")
def _(t):
    o = t.raw("orders")
    requests = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", "p0").alias("assigned_partner_id"),
                        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    given = t.raw("lineitem").where("l_quantity > 40").select(
        F.col("l_orderkey").alias("request_id"), F.concat(F.lit("p"), "l_suppkey").alias("partner_id"), F.struct("l_shipdate", "l_linenumber").alias("seq"))
    updated, _ = w.apply_assignments(requests, given, AS_OF)
    return updated.select("id", "assigned_partner_id", "status", "updated_at")


@query("log_run", f"""WITH s AS (SELECT source_key, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(blocked) AS BIGINT) AS blocked FROM fx_runs GROUP BY 1)
    SELECT 'page_ingest' AS job_name, {T} AS finished_at, (SELECT sum(failed) + sum(blocked) FROM s) = 0 AS ok, source_key, saved, failed, blocked FROM s""")
def _(t):
    sums = m.exploded_runs(t.runs).groupBy("source_key").agg(*[F.sum(m.zero(f"m.{c}")).alias(c) for c in ("saved", "failed", "blocked")])
    row = w.run_row(sums, "page_ingest", AS_OF, AS_OF)
    return row.select("job_name", "finished_at", "ok", F.explode("stats.by_source").alias("source_key", "m")).select("job_name", "finished_at", "ok", "source_key", "m.*")


@query("save_report", """SELECT source_id, count(*) AS items, 'Report ' || source_id AS title FROM fx_articles GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "reports")
    made = t.articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("items")).withColumn("title", F.concat(F.lit("Report "), "source_id"))
    w.save_report(made, path)
    return t.spark.read.parquet(path)


@query("job_merge_items", """WITH old AS (SELECT DISTINCT url FROM fx_articles WHERE is_deleted), inc AS (SELECT DISTINCT url FROM fx_articles WHERE NOT is_deleted)
    SELECT 'inserted' AS metric, count(*) AS n FROM inc WHERE url NOT IN (SELECT url FROM old) UNION ALL SELECT 'updated', count(*) FROM inc WHERE url IN (SELECT url FROM old)
    UNION ALL SELECT 'snapshot_rows', count(*) FROM (SELECT url FROM old UNION SELECT url FROM inc)""")
def _(t):
    old = t.articles.where("is_deleted").groupBy("url").agg(F.max("title").alias("title"))
    new = t.articles.where("NOT is_deleted").select("url", "title", F.col("id").alias("seq"))
    size = w.upsert(old, new, ["url"], "seq").agg(F.count(F.lit(1)).alias("n")).select(F.lit("snapshot_rows").alias("metric"), "n")
    counts = w.upsert_counts(old, new, ["url"])
    return size.unionByName(counts.select(F.lit("inserted").alias("metric"), F.col("inserted").alias("n"))).unionByName(
        counts.select(F.lit("updated").alias("metric"), F.col("updated").alias("n")))
