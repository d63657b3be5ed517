"""Alert, delivery and fetch-queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.operators import alerts as al
from pressmill.operators.ordered import nearest_rank, top_k
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.plans.search import HIT, TOK
from pressmill.sources.bind import AS_OF

T = "TIMESTAMP '2024-01-31'"

REQ = f"""req AS (SELECT a.id AS alert_id, a.user_id, a.channel, a.target, s.name, trim(coalesce(s.query,'')) AS query, coalesce(nullif(s.days,0),7) AS days, nullif(s.category,'') AS category, nullif(s.source,'') AS source,
      coalesce(c.last_ts - INTERVAL 86400 SECOND, {T} - to_days(coalesce(nullif(s.days,0),7)::INT)) AS start_ts
    FROM fx_alerts a JOIN fx_searches s ON s.id = a.saved_search_id LEFT JOIN fx_cursors c ON c.alert_id = a.id WHERE a.active)"""
MATCH = f"""{TOK}, texts AS (SELECT DISTINCT query FROM req), scored AS (SELECT query, id, round({HIT}, 6)::DOUBLE AS rank FROM texts, tok),
    hits AS (SELECT * FROM scored WHERE rank IS NOT NULL AND (query = '' OR rank > 0)),
    art AS (SELECT a.id, coalesce(published_at, created_at) AS ts, a.category, a.source, a.source_id, a.source_name, s.name AS dim_name, a.url, a.title FROM fx_articles a LEFT JOIN fx_sources s ON s.id = a.source_id),
    cand AS (SELECT r.alert_id, a.id, a.ts, h.rank, row_number() OVER (PARTITION BY r.alert_id ORDER BY h.rank DESC, a.ts DESC, a.id DESC) AS match_no FROM req r JOIN hits h ON h.query = r.query JOIN art a ON a.id = h.id
      WHERE a.ts >= r.start_ts AND (r.category IS NULL OR a.category = r.category) AND (r.source IS NULL OR a.source_name ILIKE '%' || r.source || '%' OR a.source ILIKE '%' || r.source || '%' OR a.source_id ILIKE '%' || r.source || '%' OR a.dim_name ILIKE '%' || r.source || '%')),
    matches AS (SELECT * FROM cand WHERE match_no <= 50)"""


def _requests(t):
    return al.alert_requests(t.alerts, t.searches, AS_OF, t.cursors)


def _matches(t, limit=al.MATCH_LIMIT):
    return al.alert_matches(_requests(t), t.articles, t.sources, AS_OF, limit)


@query("join_alert_search", f"WITH {REQ} SELECT * FROM req")
def _(t):
    return _requests(t).drop("saved_search_id")


@query("join_match_articles", f"""WITH {REQ}, {MATCH} SELECT query, id, rank FROM hits WHERE query <> ''""")
def _(t):
    return al.query_hits(_requests(t), t.articles)


@query("alert_search", f"WITH {REQ}, {MATCH} SELECT alert_id, id, ts, rank, match_no FROM matches")
def _(t):
    return _matches(t)


@query("topk_per_alert", f"WITH {REQ}, {MATCH} SELECT alert_id, id, match_no FROM matches WHERE match_no <= 3")
def _(t):
    return _matches(t, 3).select("alert_id", "id", "match_no")


# ---- keys and preferences --------------------------------------------------------------------

_NT = "trim(regexp_replace(lower(coalesce(title,'')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_KEY = f"coalesce(nullif(concat_ws('|', nullif(lower(trim(coalesce(dim_name,''))), ''), nullif({_NT}, ''), strftime(ts, '%Y-%m-%d')), ''), 'unknown:' || id)"


@query("dedupe_key", f"""WITH x AS (SELECT id, CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 5 = 1 THEN NULL ELSE url END AS u, source_name AS dim_name, title, published_at AS ts FROM fx_articles)
    SELECT id, CASE WHEN trim(coalesce(u,'')) <> '' THEN {q.canon_alert('u')} ELSE {_KEY} END AS dedupe_key FROM x""")
def _(t):
    url = F.expr("CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 5 = 1 THEN NULL ELSE url END")
    key = al.dedupe_key(url, F.col("source_name"), F.col("title"), F.col("published_at"), F.col("id"))
    return t.articles.select("id", key.alias("dedupe_key"))


PREFS = """users AS (SELECT DISTINCT user_id FROM fx_alerts), prefs AS (SELECT u.user_id, coalesce(nullif(dedupe_window_sec, 0), 21600) AS dedupe_window_sec, coalesce(CASE WHEN len(immediate_priorities) > 0 THEN immediate_priorities END, ['P0']) AS immediate_priorities,
    coalesce(CASE WHEN len(digest_priorities) > 0 THEN digest_priorities END, ['P1','P2']) AS digest_priorities, coalesce(priority_categories, ['trade']) AS priority_categories, coalesce(digest_schedule, 'daily') AS digest_schedule,
    coalesce(CASE WHEN len(channels_enabled) > 0 THEN channels_enabled END, ['email']) AS channels_enabled, CASE WHEN p.user_id IS NULL THEN 'env' ELSE 'db' END AS prefs_source FROM users u LEFT JOIN fx_prefs p USING (user_id))"""


@query("effective_prefs", f"""WITH {PREFS} SELECT user_id, dedupe_window_sec, array_to_string(immediate_priorities, ',') AS immediate_priorities, array_to_string(digest_priorities, ',') AS digest_priorities, array_to_string(priority_categories, ',') AS priority_categories,
    digest_schedule, array_to_string(channels_enabled, ',') AS channels_enabled, prefs_source FROM prefs""")
def _(t):
    p = al.effective_prefs(t.alerts, t.prefs, ["trade"])
    lists = ["immediate_priorities", "digest_priorities", "priority_categories", "channels_enabled"]
    return p.withColumns({c: F.array_join(c, ",") for c in lists})


@query("alert_priority", f"""WITH {REQ}, {PREFS} SELECT alert_id, CASE WHEN query <> '' THEN 'P0' WHEN list_contains(priority_categories, lower(category)) THEN 'P1' ELSE 'P2' END AS priority FROM req JOIN prefs USING (user_id)""")
def _(t):
    rows = _requests(t).join(al.effective_prefs(t.alerts, t.prefs, ["trade"]), "user_id")
    return rows.select("alert_id", al.priority(F.col("query"), F.col("category"), F.col("priority_categories")).alias("priority"))


@query("semi_recent_keys", f"""WITH {PREFS}, c AS (SELECT DISTINCT user_id, channel, dedupe_key FROM fx_deliveries)
    SELECT c.* FROM c JOIN prefs p USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM fx_deliveries d WHERE d.user_id = c.user_id AND d.channel = c.channel AND d.dedupe_key = c.dedupe_key AND d.created_at >= {T} - INTERVAL 20 DAY - to_seconds(p.dedupe_window_sec))""")
def _(t):
    cand = t.deliveries.select("user_id", "channel", "dedupe_key").distinct()
    wide = al.effective_prefs(t.alerts, t.prefs, ["trade"]).withColumn("dedupe_window_sec", F.col("dedupe_window_sec") + 20 * 86400)
    return al.not_recent(cand, t.deliveries, wide, AS_OF).select("user_id", "channel", "dedupe_key")


# Deliveries already queued for the alerts' own matches come from the log, re-keyed by the article's URL for every third order.
ENQ = f"""{REQ}, {MATCH}, {PREFS.replace("['trade']", "CAST([] AS VARCHAR[])")}, dl AS (SELECT d.alert_id, d.article_id, d.user_id, d.channel, d.created_at, CASE WHEN d.id % 3 = 0 THEN coalesce({q.canon_alert('a.url')}, d.dedupe_key) ELSE d.dedupe_key END AS dedupe_key FROM fx_deliveries d LEFT JOIN fx_articles a ON a.id = d.article_id),
    keyed AS (SELECT m.alert_id, m.id AS article_id, r.user_id, r.channel, r.query, r.category, {q.canon_alert('a.url')} AS k FROM matches m JOIN req r USING (alert_id) JOIN art a ON a.id = m.id),
    s2 AS (SELECT k.*, p.channels_enabled, p.priority_categories FROM keyed k JOIN prefs p USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM dl d WHERE d.user_id = k.user_id AND d.channel = k.channel AND d.dedupe_key = k.k AND d.created_at >= {T} - to_seconds(p.dedupe_window_sec))),
    s4 AS (SELECT * FROM s2 WHERE list_contains(channels_enabled, channel) AND NOT EXISTS (SELECT 1 FROM dl d WHERE d.alert_id = s2.alert_id AND d.article_id = s2.article_id AND d.channel = s2.channel)),
    s5 AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, channel, k ORDER BY alert_id) AS dr FROM s4),
    new AS (SELECT alert_id, user_id, article_id, channel, k AS dedupe_key, CASE WHEN query <> '' THEN 'P0' WHEN list_contains(priority_categories, lower(category)) THEN 'P1' ELSE 'P2' END AS priority FROM s5 WHERE dr = 1)"""


def _log(t):
    from pressmill.functions import urls

    names = t.articles.select(F.col("id").alias("article_id"), urls.canonical_alert(F.col("url")).alias("u"))
    rows = t.deliveries.join(names, "article_id", "left")
    return rows.withColumn("dedupe_key", F.when(F.col("id") % 3 == 0, F.coalesce("u", "dedupe_key")).otherwise(F.col("dedupe_key"))).drop("u")


def _cycle(t):
    return al.run_cycle(t.alerts, t.searches, t.cursors, t.articles, t.sources, _log(t), t.prefs, AS_OF)


@query("alert_enqueue", f"WITH {ENQ} SELECT * FROM new")
def _(t):
    new, _ = _cycle(t)
    return new.select("alert_id", "user_id", "article_id", "channel", "dedupe_key", "priority")


@query("job_alerts", f"""WITH {ENQ}, mx AS (SELECT alert_id, max(ts) AS max_ts FROM matches GROUP BY 1), nn AS (SELECT alert_id, count(*) AS n FROM new GROUP BY 1)
    SELECT alert_id, greatest(c.last_ts, mx.max_ts) AS last_ts, coalesce(n, 0) AS queued FROM fx_cursors c FULL JOIN mx USING (alert_id) LEFT JOIN nn USING (alert_id)""")
def _(t):
    from pressmill.operators.writes import advance_cursors

    new, matches = _cycle(t)
    cursors = advance_cursors(t.cursors, matches, AS_OF).select("alert_id", "last_ts")
    counts = new.groupBy("alert_id").agg(F.count(F.lit(1)).alias("queued"))
    return cursors.join(counts, "alert_id", "left").withColumn("queued", F.coalesce("queued", F.lit(0)))


# ---- due -------------------------------------------------------------------------------------

_READY = f"status IN ('PENDING','FAILED') AND next_attempt_at <= {T} AND attempt_count < 5"
DUE = f"""rdy AS (SELECT d.*, a.target FROM fx_deliveries d JOIN fx_alerts a ON a.id = d.alert_id AND a.channel = d.channel AND a.active WHERE {_READY}),
    c1 AS (SELECT *, row_number() OVER (PARTITION BY alert_id, channel ORDER BY next_attempt_at, id) AS alert_no FROM rdy), c2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY alert_id, alert_no, id) AS user_no FROM c1 WHERE alert_no <= 25),
    capped AS (SELECT * FROM c2 WHERE user_no <= 25)"""


@query("join_due_alert", f"WITH {DUE} SELECT id, alert_id, target FROM rdy")
def _(t):
    ready = t.deliveries.where(F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt_at") <= al.as_time(AS_OF)) & (F.col("attempt_count") < 5))
    return ready.join(t.alerts.where("active").select(F.col("id").alias("alert_id"), "target", "channel"), ["alert_id", "channel"]).select("id", "alert_id", "target")


@query("cap_per_alert_user", f"WITH {DUE} SELECT id, alert_no, user_no FROM capped")
def _(t):
    ready = t.deliveries.where(F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt_at") <= al.as_time(AS_OF)) & (F.col("attempt_count") < 5))
    active = t.alerts.where("active").select(F.col("id").alias("alert_id"), "channel")
    return al.cap_due(ready.join(active, ["alert_id", "channel"]), 25).select("id", "alert_no", "user_no")


_WANT = """pw AS (SELECT user_id, list_concat(coalesce(CASE WHEN len(immediate_priorities) > 0 THEN immediate_priorities END, ['P0']), coalesce(CASE WHEN len(digest_priorities) > 0 THEN digest_priorities END, ['P1','P2'])) AS w FROM (SELECT DISTINCT user_id FROM fx_deliveries) LEFT JOIN fx_prefs USING (user_id)),
    due AS (SELECT c.* FROM capped c JOIN pw USING (user_id) WHERE list_contains(w, priority))"""


@query("alert_due", f"WITH {DUE}, {_WANT} SELECT id, alert_id, priority, target FROM due")
def _(t):
    return al.alert_due(t.deliveries, t.alerts, t.prefs, AS_OF).select("id", "alert_id", "priority", "target")


@query("join_article_by_id", f"WITH {DUE}, {_WANT} SELECT due.id, a.title, s.name AS source_name, a.id IS NULL AS missing FROM due LEFT JOIN fx_articles a ON a.id = due.article_id LEFT JOIN fx_sources s ON s.id = a.source_id")
def _(t):
    due = al.alert_due(t.deliveries, t.alerts, t.prefs, AS_OF)
    return al.due_articles(due, t.articles, t.sources).select("id", "title", "source_name", "missing")


@query("alert_digest", f"""WITH {DUE}, {_WANT}, it AS (SELECT due.*, a.title, a.url, a.summary, s.name AS sn, (due.alert_no - 1) // 50 AS batch_no FROM due JOIN fx_articles a ON a.id = due.article_id LEFT JOIN fx_sources s ON s.id = a.source_id),
    g AS (SELECT alert_id, batch_no, dedupe_key, min(alert_no) AS pos0, count(*) AS n, arg_min(title, alert_no) AS title, arg_min(url, alert_no) AS url, arg_min(summary, alert_no) AS summary,
        (SELECT string_agg(sn, ', ' ORDER BY m) FROM (SELECT i2.sn, min(i2.alert_no) AS m FROM it i2 WHERE i2.alert_id = it.alert_id AND i2.batch_no = it.batch_no AND i2.dedupe_key = it.dedupe_key AND sn IS NOT NULL GROUP BY 1)) AS srcs FROM it GROUP BY 1, 2, 3),
    b AS (SELECT *, {q.strip("title || CASE WHEN srcs IS NOT NULL THEN chr(10) || 'Sources: ' || srcs ELSE '' END || CASE WHEN " + q.strip('summary') + " <> '' THEN chr(10) || chr(10) || left(" + q.strip('summary') + ", 600) ELSE '' END || chr(10) || chr(10) || url")} AS block FROM g)
    SELECT alert_id, batch_no, count(*) AS groups, CAST(sum(n) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) || ' new items from your searches' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos0) AS message FROM b GROUP BY 1, 2""")
def _(t):
    due = al.alert_due(t.deliveries, t.alerts, t.prefs, AS_OF)
    return al.alert_digest(al.due_articles(due, t.articles, t.sources), batch=50)


# ---- outcomes and health ---------------------------------------------------------------------

OUT = f"""oc AS (SELECT alert_id, article_id, channel, bool_or(priority <> 'P2') AS ok FROM fx_deliveries WHERE {_READY} GROUP BY ALL), res AS (SELECT d.*, oc.ok, CASE WHEN oc.ok IS NOT NULL THEN d.attempt_count + 1 END AS tries FROM fx_deliveries d LEFT JOIN oc USING (alert_id, article_id, channel))"""


@query("delivery_result", f"""WITH {OUT} SELECT id, CASE WHEN ok IS NULL THEN CASE WHEN id % 11 = 0 THEN 'smtp down' END WHEN NOT ok THEN 'status=500' END AS error, CASE WHEN ok THEN {T} WHEN status = 'SENT' THEN created_at END AS delivered_at, CASE WHEN ok IS NULL THEN status WHEN ok THEN 'SENT' ELSE 'FAILED' END AS status, coalesce(tries, attempt_count) AS attempt_count, CASE WHEN ok IS NOT NULL THEN {T} ELSE last_attempt_at END AS last_attempt_at,
    CASE WHEN ok IS NULL THEN next_attempt_at WHEN ok THEN {T} ELSE {T} + to_seconds(least(3600, 60 * CAST(pow(2, greatest(tries - 1, 0)) AS INT))) END AS next_attempt_at, coalesce(NOT ok AND tries >= 5, false) AS gave_up FROM res""")
def _(t):
    ready = t.deliveries.where(F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt_at") <= al.as_time(AS_OF)) & (F.col("attempt_count") < 5))
    outcomes = ready.select("alert_id", "article_id", "channel", (F.col("priority") != "P2").alias("ok"), F.lit("status=500").alias("error"))
    stored = t.deliveries.withColumns({"error": F.expr("CASE WHEN id % 11 = 0 THEN 'smtp down' END"), "delivered_at": F.expr("CASE WHEN status = 'SENT' THEN created_at END")})
    done = al.delivery_result(stored, outcomes, AS_OF)
    return done.select("id", "error", "delivered_at", "status", "attempt_count", "last_attempt_at", "next_attempt_at", F.coalesce("gave_up", F.lit(False)).alias("gave_up"))


_OPEN = "status IN ('PENDING','FAILED') AND attempt_count < 5"


@query("backlog_health", f"""WITH s AS (SELECT count(*) FILTER (WHERE {_OPEN}) AS pending_count, count(*) FILTER (WHERE {_OPEN} AND (next_attempt_at IS NULL OR next_attempt_at <= {T})) AS pending_due_count,
      coalesce(CAST(epoch({T}) - epoch(min(queued_at) FILTER (WHERE {_OPEN} AND NOT queued_at_is_estimated)) AS BIGINT), 0) AS oldest_age_sec,
      coalesce(CAST(epoch(min(next_attempt_at) FILTER (WHERE {_OPEN} AND next_attempt_at > {T})) - epoch({T}) AS BIGINT), 0) AS next_due_in_sec,
      count(*) FILTER (WHERE {_OPEN} AND queued_at_is_estimated) AS queued_at_estimated, count(*) FILTER (WHERE status = 'FAILED' AND attempt_count >= 5) AS giveup_count FROM fx_deliveries)
    SELECT *, pending_due_count >= 200 OR oldest_age_sec >= 3600 AS warn FROM s""")
def _(t):
    return al.backlog_health(t.deliveries, AS_OF)


@query("priority_counts", "SELECT priority, count(*) AS n FROM fx_deliveries GROUP BY 1")
def _(t):
    return al.priority_counts(t.deliveries)


@query("dedupe_groups", f"""SELECT user_id, channel, dedupe_key, count(*) AS seen_count, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM fx_deliveries WHERE created_at >= {T} - INTERVAL 2000 DAY GROUP BY 1, 2, 3 HAVING count(*) > 1
    ORDER BY last_seen_at DESC, user_id, channel, dedupe_key LIMIT 200""")
def _(t):
    return al.dedupe_groups(t.deliveries, AS_OF, days=2000)


@query("queued_at_repair", """WITH x AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE created_at END AS created_at, CASE WHEN id % 6 = 0 THEN NULL ELSE queued_at END AS queued_at, queued_at_is_estimated AS e, last_attempt_at FROM fx_deliveries)
    SELECT id, CASE WHEN (queued_at IS NULL OR e) AND coalesce(created_at, last_attempt_at) IS NOT NULL THEN coalesce(created_at, last_attempt_at) ELSE coalesce(queued_at, TIMESTAMP '1970-01-01') END AS queued_at,
      (queued_at IS NULL OR e) AND coalesce(created_at, last_attempt_at) IS NULL AS queued_at_is_estimated FROM x""")
def _(t):
    rows = t.deliveries.withColumns({"created_at": F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE created_at END"), "queued_at": F.expr("CASE WHEN id % 6 = 0 THEN NULL ELSE queued_at END")})
    return al.queued_at_repair(rows).select("id", "queued_at", "queued_at_is_estimated")


# ---- fetch queue -----------------------------------------------------------------------------

# The queue is the article table seen as fetch jobs.
QUEUE = """que AS (SELECT id, source_id, url, CASE summary_status WHEN 'PENDING' THEN 'queued' WHEN 'TIMEOUT' THEN 'queued' WHEN 'ERROR' THEN 'running' ELSE 'done' END AS status, CAST(id % 6 AS INT) AS attempts, summary_next_attempt_at AS next_run_at FROM fx_articles)"""


def _queue(t):
    status = "CASE summary_status WHEN 'PENDING' THEN 'queued' WHEN 'TIMEOUT' THEN 'queued' WHEN 'ERROR' THEN 'running' ELSE 'done' END AS status"
    return t.articles.selectExpr("id", "source_id", "url", status, "CAST(id % 6 AS INT) AS attempts", "summary_next_attempt_at AS next_run_at", "CAST(NULL AS STRING) AS last_error")


@query("queue_claim", f"""WITH {QUEUE} SELECT id, 'running' AS status, attempts + 1 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY next_run_at, id) AS rn FROM que WHERE status = 'queued' AND next_run_at <= {T}) WHERE rn <= 5""")
def _(t):
    return al.queue_claim(_queue(t), AS_OF, 5).select("id", "status", "attempts")


@query("queue_skip_full", f"""WITH {QUEUE} SELECT id, CASE WHEN url IN (SELECT url FROM fx_articles WHERE content_kind = 'full') THEN 'done' ELSE status END AS status FROM que WHERE status = 'running'""")
def _(t):
    return al.queue_skip_full(_queue(t).where("status = 'running'"), t.articles).select("id", "status")


@query("queue_result", f"""WITH {QUEUE}, o AS (SELECT *, content_kind AS ck FROM que JOIN (SELECT id, content_kind FROM fx_articles) USING (id)), x AS (SELECT *, status = 'running' AS hit, ck IS NOT DISTINCT FROM 'full' AS ok, CASE WHEN ck = 'teaser' THEN 'blocked_html:retry_after=7300' WHEN ck = 'title_only' THEN 'blocked_html:retry_after=soon' ELSE 'content_too_short' END AS err FROM o)
    SELECT id, CASE WHEN NOT hit THEN status WHEN ok THEN 'done' WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END AS status, CASE WHEN hit AND NOT ok THEN err END AS last_error,
      CASE WHEN hit AND NOT ok AND attempts < 5 THEN {T} + to_seconds(CASE ck WHEN 'teaser' THEN 7300 WHEN 'title_only' THEN greatest([600,1800,7200,43200][greatest(1, least(attempts, 4))], 3600) ELSE [600,1800,7200,43200][greatest(1, least(attempts, 4))] END) ELSE next_run_at END AS next_run_at FROM x""")
def _(t):
    kinds = t.articles.select("id", "content_kind")
    running = _queue(t).where("status = 'running'").join(kinds, "id")
    error = F.when(F.col("content_kind") == "teaser", "blocked_html:retry_after=7300").when(F.col("content_kind") == "title_only", "blocked_html:retry_after=soon").otherwise("content_too_short")
    outcomes = running.select("id", F.col("content_kind").eqNullSafe("full").alias("ok"), error.alias("error"))
    return al.queue_result(_queue(t), outcomes, AS_OF).select("id", "status", "last_error", "next_run_at")


# ---- caps and ranks ---------------------------------------------------------------------------

@query("cap_per_source", """WITH r AS (SELECT id, source, length(content) AS n, row_number() OVER (PARTITION BY source ORDER BY length(content), id) AS rn FROM fx_articles WHERE summary_status = 'PENDING' AND content <> '')
    SELECT id, source FROM r WHERE rn <= 10 ORDER BY n, id LIMIT 30""")
def _(t):
    batch = 30
    per = min(30, max(5, batch // 3))
    pending = t.articles.where("summary_status = 'PENDING' AND content <> ''").select("id", "source", F.length("content").alias("n"))
    return top_k(pending, ["source"], [F.col("n"), F.col("id")], per, F.col("id")).orderBy("n", "id").limit(batch).select("id", "source")


@query("summary_source_stats", """WITH l AS (SELECT 'src' || (user_id % 21) AS source, event_type AS action, CAST(floor(value * 100) AS BIGINT) AS ms FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l)
    SELECT source, count(*) AS picked, count(*) FILTER (WHERE action = 'error') AS failed, CAST(floor(avg(ms)) AS BIGINT) AS avg_ms, max(ms) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95_ms FROM o GROUP BY 1""")
def _(t):
    log = t.raw("events").selectExpr("concat('src', user_id % 21) AS source", "event_type AS action", "CAST(floor(value * 100) AS BIGINT) AS ms")
    sums = log.groupBy("source").agg(F.count(F.lit(1)).alias("picked"), F.count_if(F.col("action") == "error").alias("failed"), F.floor(F.avg("ms")).alias("avg_ms"))
    return sums.join(nearest_rank(log, ["source"], "ms", 0.95, "p95_ms"), "source")
