"""Selection, topic and source-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import rules
from pressmill.operators import links as lk, metrics as m, selection as se, topics as tp
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.sources.bind import AS_OF

INC = """idx AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY pos) AS i FROM fx_candidates),
    run AS (SELECT *, i - coalesce(max(CASE WHEN NOT stored THEN i END) OVER (PARTITION BY {k} ORDER BY i), 0) AS stale FROM idx),
    stops AS (SELECT {k}, min(i) AS s FROM run WHERE i >= {min} AND stale >= {stop} GROUP BY ALL),
    fresh AS (SELECT r.* FROM run r LEFT JOIN stops USING ({k}) WHERE NOT stored AND (s IS NULL OR i <= s))"""


@query("select_incremental", f"""WITH {INC.format(k='source_key', min=10, stop=3)}
    SELECT source_key, pos, url, slot FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY i) AS slot FROM fresh) WHERE slot <= 30""")
def _(t):
    return se.select_incremental(t.candidates.select("source_key", "pos", "url", "stored"), stop=3)


@query("select_bucketed", f"""WITH {INC.format(k='source_key, bucket', min=0, stop=4)}, per AS (SELECT *, row_number() OVER (PARTITION BY source_key, bucket ORDER BY i) AS rn FROM fresh),
    fs AS (SELECT source_key, bucket, min(pos) AS fp FROM fx_candidates GROUP BY ALL)
    SELECT source_key, bucket, pos, url, slot FROM (SELECT per.*, row_number() OVER (PARTITION BY source_key ORDER BY rn, CASE bucket WHEN 'news' THEN 0 WHEN 'inbrief' THEN 1 ELSE 2 END, fp) AS slot
      FROM per JOIN fs USING (source_key, bucket) WHERE rn <= 15) WHERE slot <= 30""")
def _(t):
    return se.select_bucketed(t.candidates.select("source_key", "bucket", "pos", "url", "stored"), stop=4)


@query("select_feed_mode", """SELECT source_key, pos, url, slot FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY pos) AS slot FROM fx_candidates WHERE NOT stored) WHERE slot <= 12""")
def _(t):
    return se.select_feed_mode(t.candidates, 12)


@query("consecutive_run_length", f"""WITH {INC.format(k='source_key', min=0, stop=3)} SELECT source_key, pos, i, stale FROM run""")
def _(t):
    return se.stored_run_length(t.candidates.select("source_key", "pos", "stored"), ["source_key"]).select("source_key", "pos", "i", "stale")


@query("round_robin", """SELECT bucket, pos, turn FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS turn FROM fx_candidates) ORDER BY turn, bucket LIMIT 25""")
def _(t):
    return se.round_robin(t.candidates.select("bucket", "pos"), "bucket", [F.col("pos")], 25, F.col("pos"))


_T = "TIMESTAMP '2024-01-31'"


@query("refresh_revisit", f"SELECT DISTINCT {q.canon_page('url')} AS page_key FROM fx_articles WHERE last_seen_at < {_T} - INTERVAL 72 HOUR")
def _(t):
    return se.refresh_allowed(t.articles, AS_OF)


@query("key_difference", f"""SELECT DISTINCT {q.canon_page('url')} AS page_key FROM fx_articles EXCEPT SELECT {q.canon_page('url')} FROM fx_articles WHERE last_seen_at < {_T} - INTERVAL 72 HOUR""")
def _(t):
    return se.effective_existing(t.articles, AS_OF)


@query("touch_last_seen", f"SELECT id, CASE WHEN url IN (SELECT url FROM fx_articles WHERE source_type = 'social') THEN {_T} ELSE last_seen_at END AS last_seen_at FROM fx_articles")
def _(t):
    seen = t.articles.where("source_type = 'social'").select("url")
    return se.touch_last_seen(t.articles, seen, AS_OF).select("id", "last_seen_at")


@query("discovery_ratio", f"""WITH h AS (SELECT page_id, source_key, url AS base, unnest({q.hrefs('html')}) AS href FROM fx_pages), k AS (SELECT page_id, source_key, base, {q.canon_page("CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href WHEN starts_with(href, '/') THEN " + q.piece('base', 1) + " || '://' || " + q.piece('base', 2) + " || href END")} AS k FROM h),
    ok AS (SELECT DISTINCT page_id, source_key, k, {q.piece('k', 2)} = {q.piece('base', 2)} AND contains(k, '/news/') OR ({q.piece('k', 2)} = {q.piece('base', 2)} AND len(string_split(trim({q.piece('k', 3)}, '/'), '/')) >= 2 AND NOT regexp_matches({q.piece('k', 3)}, '{q.MEDIA}')) AS good FROM k),
    s AS (SELECT source_key, count(*) FILTER (WHERE good) AS kept, count(*) AS unique_links FROM ok GROUP BY 1)
    SELECT source_key, kept, unique_links, kept / unique_links AS kept_ratio, kept / unique_links < 0.08 AS discovery_degraded FROM s""")
def _(t):
    found = lk.discover_article_links(t.pages)
    stats = found.groupBy("source_key").agg(F.sum(F.size("links")).alias("kept"), F.sum("unique_links").alias("unique_links"))
    return se.discovery_ratio(stats)


@query("fetch_degraded", """WITH s AS (SELECT source_key, CAST(sum(coalesce(attempted,0)) AS BIGINT) AS attempted, CAST(sum(blocked) AS BIGINT) AS blocked, CAST(sum(coalesce(new_candidates,0)) AS BIGINT) AS new_candidates FROM fx_runs GROUP BY 1)
    SELECT *, CASE WHEN new_candidates > 0 AND attempted = 0 THEN 'fetch_no_attempts' WHEN attempted >= 5 AND blocked / attempted >= 0.05 THEN 'blocked_rate' END AS degraded_reason,
      coalesce((new_candidates > 0 AND attempted = 0) OR (attempted >= 5 AND blocked / attempted >= 0.05), false) AS fetch_degraded FROM s""")
def _(t):
    rows = m.exploded_runs(t.runs)
    stats = rows.groupBy("source_key").agg(*[F.sum(m.zero(f"m.{c}")).alias(c) for c in ("attempted", "blocked", "new_candidates")])
    return se.fetch_degraded(stats, threshold=0.05)


# A source rests when it was blocked within the last day of the run log.
_HEALTH = f"""health AS (SELECT source_key, max(started_at) AS last_blocked_at, count(*) AS blocked_count_24h, max(started_at) + INTERVAL 24 HOUR AS cooldown_until FROM fx_runs WHERE blocked > 0 AND started_at < {_T} - INTERVAL 12 HOUR GROUP BY 1)"""


def _health(t):
    rows = m.exploded_runs(t.runs).where((F.col("m.blocked") > 0) & (F.col("started_at") < F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'")))
    return rows.groupBy("source_key").agg(
        F.max("started_at").alias("last_blocked_at"), F.count(F.lit(1)).alias("blocked_count_24h"),
        (F.max("started_at") + F.expr("INTERVAL '24' HOUR")).alias("cooldown_until"))


@query("cooldown_filter", f"WITH {_HEALTH} SELECT source_key FROM fx_config WHERE source_key NOT IN (SELECT source_key FROM health WHERE cooldown_until > {_T})")
def _(t):
    return se.cooldown_filter(t.config, _health(t), AS_OF).select("source_key")


@query("mark_blocked", f"""WITH {_HEALTH}, e AS (SELECT source_key, count(*) AS n FROM fx_runs WHERE last_error = 'blocked:403' AND started_at >= {_T} - INTERVAL 12 HOUR GROUP BY 1)
    SELECT source_key, CASE WHEN n IS NOT NULL THEN {_T} ELSE last_blocked_at END AS last_blocked_at, coalesce(blocked_count_24h,0) + coalesce(n,0) AS blocked_count_24h,
      CASE WHEN n IS NOT NULL THEN {_T} + INTERVAL 24 HOUR ELSE cooldown_until END AS cooldown_until FROM health FULL JOIN e USING (source_key)""")
def _(t):
    rows = m.exploded_runs(t.runs).where((F.col("m.last_error") == "blocked:403") & (F.col("started_at") >= F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'")))
    return se.mark_blocked(_health(t), rows.select("source_key"), AS_OF)


@query("errors_in_window", """SELECT id, errors, errors >= 3 AS tripped FROM (SELECT id, count(*) FILTER (WHERE ok IS NOT DISTINCT FROM FALSE) OVER (PARTITION BY job_name ORDER BY started_at RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS errors FROM fx_runs)""")
def _(t):
    log = t.runs.select("id", "job_name", "started_at", F.coalesce(~F.col("ok"), F.lit(False)).alias("bad"))
    return se.errors_in_window(log, ["job_name"], "started_at", "bad", seconds=3600).select("id", "errors", "tripped")


@query("notify_cooldown", """WITH RECURSIVE ev AS (SELECT DISTINCT job_name || ':' || source_key AS key, started_at AS ts FROM fx_runs WHERE NOT ok),
    e(key, ts) AS (SELECT key, min(ts) FROM ev GROUP BY 1 UNION ALL SELECT e.key, min(ev.ts) FROM e JOIN ev ON ev.key = e.key AND ev.ts >= e.ts + INTERVAL 3 HOUR GROUP BY e.key)
    SELECT key, ts AS emitted_at FROM e""")
def _(t):
    bad = m.exploded_runs(t.runs.where("NOT ok")).select(F.concat_ws(":", "job_name", "source_key").alias("key"), "started_at")
    return se.notify_cooldown(bad, "key", "started_at", 3 * 3600)


# ---- topics ----------------------------------------------------------------------------------

_NORM = f"CASE WHEN url IS NULL THEN NULL ELSE {q.canon_feed('url')} END"
_KW = "CASE topic_key " + " ".join(
    f"WHEN '{k}' THEN {q.has_any('blob', sum((rules.TAGS[x] for x in tags), []))}"
    for k, tags in {"energy_en": ["oil_gas"], "banking_en": ["banking"], "security_any": ["security", "governance"], "trade_de": ["regulation"]}.items()) + " END"
_ANY = "len(list_filter({0}, lambda x: contains(blob, x))) > 0"
JUDGED = f"""base AS (SELECT i.*, t.* EXCLUDE (topic_key), {_NORM} AS norm, lower(trim(title) || ' ' || regexp_replace(snippet, '^\\s+|\\s+$', '', 'g')) AS blob FROM {{src}} i JOIN fx_topics t USING (topic_key)),
    dom AS (SELECT *, {q.domain('norm')} AS domain FROM base),
    judged AS (SELECT *, CASE WHEN url IS NULL THEN 'missing_url' WHEN domain IN ({', '.join(f"'{d}'" for d in rules.SOCIAL_DOMAINS)}) THEN 'denylist'
      WHEN NOT ({_ANY.format('location_terms')} AND CASE WHEN len(require_terms_any) > 0 AND len(require_terms_any2) > 0 THEN ({_ANY.format('require_terms_any')} AND {_ANY.format('require_terms_any2')}) OR list_contains(preferred_domains, domain)
        WHEN len(require_terms) > 0 AND NOT {_ANY.format('require_terms')} THEN list_contains(preferred_domains, domain) ELSE {_KW} END) THEN 'not_relevant' END AS r FROM dom),
    ranked AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY norm, r IS NULL ORDER BY priority, topic_key, pos) END AS rk FROM judged),
    final AS (SELECT *, coalesce(r, CASE WHEN rk = 1 THEN 'accepted' ELSE 'duplicate' END) AS skip_reason FROM ranked)"""
ALL = JUDGED.replace('{src}', 'fx_topic_items')
TAKEN = JUDGED.replace('{src}', 'taken')


@query("relevance_filter", f"WITH {ALL} SELECT topic_key, pos, norm, skip_reason FROM final")
def _(t):
    return tp.relevance_filter(t.topic_items, t.topics).select("topic_key", "pos", "norm", "skip_reason")


BUDGET = """idx AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY pos) AS i FROM fx_topic_items), o AS (SELECT topic_key, priority AS p, CASE WHEN max_processed > 0 THEN least(max_processed, 120) ELSE 120 END AS cap FROM fx_topics),
    a1 AS (SELECT count(url) AS d FROM idx WHERE topic_key = 'energy_en' AND i <= 120), a2 AS (SELECT count(url) + (SELECT d FROM a1) AS d FROM idx WHERE topic_key = 'banking_en' AND i <= least(40, 120 - (SELECT d FROM a1))),
    a3 AS (SELECT count(url) + (SELECT d FROM a2) AS d FROM idx WHERE topic_key = 'security_any' AND i <= 120 - (SELECT d FROM a2)),
    taken AS (SELECT * EXCLUDE (i) FROM idx WHERE i <= CASE topic_key WHEN 'energy_en' THEN 120 WHEN 'banking_en' THEN least(40, 120 - (SELECT d FROM a1)) WHEN 'security_any' THEN 120 - (SELECT d FROM a2) ELSE least(25, 120 - (SELECT d FROM a3)) END)"""


@query("topic_budget", f"WITH {BUDGET} SELECT topic_key, pos, url FROM taken")
def _(t):
    return tp.topic_budget(t.topic_items, t.topics, 120).select("topic_key", "pos", "url")


MERGE = """firsts AS (SELECT norm, arg_min(topic_key, rk) AS ft FROM final WHERE rk IS NOT NULL GROUP BY 1),
    two AS (SELECT f.*, row_number() OVER (PARTITION BY f.norm, topic_key ORDER BY pos) AS rn, ft FROM final f JOIN firsts USING (norm) WHERE rk IS NOT NULL),
    used AS (SELECT * FROM two WHERE rn = 1 OR (rn = 2 AND topic_key = ft)),
    merged AS (SELECT norm AS url, sha1(norm) AS external_id, ft AS topic_key, min(pos) FILTER (WHERE rk = 1) AS pos,
      (SELECT string_agg(x, ',' ORDER BY m) FROM (SELECT u2.topic_key AS x, min(u2.rk) AS m FROM used u2 WHERE u2.norm = used.norm GROUP BY 1)) AS topics_found,
      (SELECT string_agg(x, ' ' ORDER BY m) FROM (SELECT u2.url AS x, min(u2.rk) AS m FROM used u2 WHERE u2.norm = used.norm GROUP BY 1)) AS raw_urls,
      (SELECT string_agg(x, ' ' ORDER BY m) FROM (SELECT u2.url AS x, min(u2.rk) AS m FROM used u2 WHERE u2.norm = used.norm AND u2.rn = 1 GROUP BY 1)) AS topic_urls FROM used GROUP BY norm, ft)"""


@query("topic_merge", f"WITH {ALL}, {MERGE} SELECT * EXCLUDE (topic_urls) FROM merged")
def _(t):
    merged = tp.topic_merge(t.topic_items, t.topics)
    return merged.select("url", "external_id", "topic_key", "pos", F.array_join("topics_found", ",").alias("topics_found"), F.array_join("raw_urls", " ").alias("raw_urls"))


# Already stored: items whose canonical URL has an even last digit.
_KNOWN = "(regexp_matches({0}, '[02468]$'))"


def _stored(t):
    norms = t.topic_items.select(tp.urls.canonical_feed(F.col("url")).alias("n")).where(F.rlike("n", F.lit("[02468]$"))).distinct()
    lists = {"topics_found": ("old_topic", "energy_en"), "tags": ("old",), "raw_urls": ("https://old.example.org/a",)}
    return norms.select(F.sha1("n").alias("external_id"), *(F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()))


def _appended(old: list[str], new: str, by: str) -> str:
    """SQL of a stored list and what is new in a joined list."""
    return f"array_to_string(list_concat({old!r}, list_filter(string_split({new}, '{by}'), lambda x: NOT list_contains({old!r}, x))), '{by}')"


@query("gdelt_ingest", f"""WITH {BUDGET}, {TAKEN}, {MERGE} SELECT m.external_id, m.url, i.title, coalesce(t.topic_lang, i.language) AS language, 'article' AS source_type,
      CASE WHEN i.seendate = 'bad' THEN TIMESTAMP '2024-01-31' ELSE strptime(i.seendate, '%Y%m%d%H%M%S') END AS published_at, m.topic_key,
      CASE WHEN {_KNOWN.format('m.url')} THEN {_appended(['old_topic', 'energy_en'], 'm.topics_found', ',')} ELSE m.topics_found END AS topics_found,
      CASE WHEN {_KNOWN.format('m.url')} THEN {_appended(['https://old.example.org/a'], 'm.topic_urls', ' ')} ELSE m.raw_urls END AS raw_urls, {_KNOWN.format('m.url')} AS known
    FROM merged m JOIN fx_topic_items i ON i.topic_key = m.topic_key AND i.pos = m.pos JOIN fx_topics t ON t.topic_key = m.topic_key""")
def _(t):
    built, _ = tp.topic_ingest(t.topic_items, t.topics, _stored(t), AS_OF, 120)
    return built.drop("tags").withColumns({"topics_found": F.array_join("topics_found", ","), "raw_urls": F.array_join("raw_urls", " ")})


@query("topic_stats", f"""WITH {BUDGET}, {TAKEN}, f AS (SELECT topic_key, count(*) AS found FROM fx_topic_items GROUP BY 1)
    SELECT f.topic_key, any_value(f.found) AS found, count(*) FILTER (WHERE skip_reason <> 'missing_url') AS processed, count(*) FILTER (WHERE skip_reason = 'accepted' AND NOT {_KNOWN.format('norm')}) AS inserted_new,
      count(*) FILTER (WHERE skip_reason = 'accepted' AND {_KNOWN.format('norm')}) AS updated_existing, count(*) FILTER (WHERE skip_reason = 'duplicate') AS dedup_existing,
      count(*) FILTER (WHERE skip_reason = 'missing_url') AS skipped_missing_url, count(*) FILTER (WHERE skip_reason = 'denylist') AS skipped_denylist, count(*) FILTER (WHERE skip_reason = 'allowlist') AS skipped_allowlist,
      count(*) FILTER (WHERE skip_reason = 'not_relevant') AS skipped_not_relevant, count(*) FILTER (WHERE skip_reason = 'duplicate' OR (skip_reason = 'accepted' AND {_KNOWN.format('norm')})) AS skipped_duplicate
    FROM f LEFT JOIN final USING (topic_key) GROUP BY 1""")
def _(t):
    _, rows = tp.topic_ingest(t.topic_items, t.topics, _stored(t), AS_OF, 120)
    return tp.topic_stats(t.topic_items, rows, _stored(t))


@query("job_topics", f"""WITH {BUDGET}, {TAKEN} SELECT topic_key, skip_reason, count(*) AS n, count(DISTINCT norm) AS urls FROM final GROUP BY ALL""")
def _(t):
    _, rows = tp.topic_ingest(t.topic_items, t.topics, _stored(t), AS_OF, 120)
    return rows.groupBy("topic_key", "skip_reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("norm").alias("urls"))
