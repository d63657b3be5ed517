"""Overview, coverage, health and daily queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.operators import metrics as m
from pressmill.plans.binding_sql import AS_OF as T
from pressmill.plans.registry import query
from pressmill.sources.bind import AS_OF

DAY = "2024-01-30 00:00:00"
D0, D1 = "TIMESTAMP '2024-01-30'", "TIMESTAMP '2024-01-31'"
ATT = "coalesce(attempted, total, coalesce(saved,0) + coalesce(failed,0) + coalesce(blocked,0))"

STATS = f"""stats AS (
  SELECT source_key, CAST(sum({ATT}) AS BIGINT) AS attempted, CAST(sum(coalesce(failed,0)) AS BIGINT) AS failed,
         max(CASE WHEN ok THEN coalesce(finished_at, started_at) END) AS last_ingest_ok_at,
         arg_max(CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'fail' ELSE 'unknown' END, started_at) AS last_ingest_status,
         arg_max(id, started_at) AS last_ingest_run_id
  FROM fx_runs WHERE started_at >= {T} - INTERVAL 24 HOUR GROUP BY 1)"""
ART = f"""art AS (
  SELECT coalesce(s.key, a.source_id) AS source_key, count(*) AS articles_7d, max(coalesce(published_at, created_at)) AS last_article_at
  FROM fx_articles a LEFT JOIN fx_sources s ON s.id = a.source_id
  WHERE coalesce(published_at, created_at) >= {T} - INTERVAL 7 DAY GROUP BY 1)"""
QUALITY = f"""quality AS (
  SELECT coalesce(s.key, a.source_id) AS source_key, count(*) FILTER (WHERE content_kind = 'full') AS full_count_7d,
         count(*) FILTER (WHERE content_kind = 'teaser') AS teaser_count_7d, count(*) FILTER (WHERE content_kind = 'title_only') AS blocked_count_7d
  FROM fx_articles a LEFT JOIN fx_sources s ON s.id = a.source_id
  WHERE coalesce(published_at, created_at) >= {T} - INTERVAL 7 DAY GROUP BY 1)"""
HEALTH = f"""health AS (
  SELECT source_key, CAST(sum(coalesce(discovered_total, new_candidates, total, 0)) AS BIGINT) AS discovered,
         CAST(sum(coalesce(attempted, total, 0)) AS BIGINT) AS fetched, CAST(sum(saved) AS BIGINT) AS saved,
         CAST(sum(blocked) AS BIGINT) AS blocked, CAST(sum(failed) AS BIGINT) AS failed,
         arg_max(last_error, started_at) FILTER (WHERE last_error IS NOT NULL) AS last_error,
         max(CASE WHEN ok THEN coalesce(finished_at, started_at) END) AS last_ok_at
  FROM fx_runs WHERE started_at >= {T} - INTERVAL 24 HOUR GROUP BY 1)"""
COVER = f"""cover AS (
  SELECT c.source_key, c.enabled, c.type, a.last_article_at, coalesce(a.articles_7d, 0) AS articles_7d, s.last_ingest_ok_at,
         s.last_ingest_run_id, coalesce(s.last_ingest_status, 'unknown') AS last_ingest_status,
         CASE WHEN s.attempted > 0 THEN s.failed / s.attempted END AS fail_rate_24h,
         CASE WHEN coalesce(a.articles_7d, 0) = 0 THEN 'no_articles_7d'
              WHEN a.last_article_at IS NULL OR a.last_article_at < {T} - INTERVAL 48 HOUR THEN 'stale_48h'
              WHEN s.attempted > 0 AND s.failed / s.attempted > 0.5 THEN 'high_fail_rate_24h' END AS notes
  FROM fx_config c LEFT JOIN art a USING (source_key) LEFT JOIN stats s USING (source_key))"""


@query("article_stats", f"WITH {ART} SELECT * FROM art")
def _(t):
    return m.article_stats(t.articles, t.sources, AS_OF)


@query("ingest_stats", f"WITH {STATS} SELECT * FROM stats")
def _(t):
    return m.ingest_stats(t.runs, AS_OF)


@query("coverage", f"WITH {ART}, {STATS}, {COVER} SELECT * FROM cover")
def _(t):
    return m.coverage(t.config, t.articles, t.sources, t.runs, AS_OF)


@query("coverage_totals", f"""WITH {ART}, {STATS}, {COVER} SELECT count(*) AS sources_configured,
    count(*) FILTER (WHERE articles_7d > 0) AS sources_with_articles_7d, CAST(sum(articles_7d) AS BIGINT) AS articles_7d FROM cover""")
def _(t):
    return m.coverage_totals(m.coverage(t.config, t.articles, t.sources, t.runs, AS_OF))


@query("anti_orphan_sources", """WITH used AS (SELECT DISTINCT source FROM documents)
    SELECT key AS source_key, (SELECT count(*) FROM documents d WHERE d.source = key) AS articles
    FROM fx_sources WHERE key NOT IN (SELECT source_key FROM fx_config)""")
def _(t):
    orphans = m.orphan_sources(t.sources, t.config)
    counts = t.articles.groupBy(F.col("source_id").alias("source_key")).agg(F.count(F.lit(1)).alias("articles"))
    return orphans.join(counts, "source_key", "left").withColumn("articles", m.zero("articles"))


@query("article_quality_counts", f"WITH {QUALITY} SELECT * FROM quality")
def _(t):
    return m.quality_counts(t.articles, t.sources, AS_OF)


@query("feed_quality_counts", f"WITH {QUALITY} SELECT * FROM quality")
def _(t):
    return m.quality_counts(t.feed, t.sources, AS_OF)


@query("ingest_health_stats", f"WITH {HEALTH} SELECT * FROM health")
def _(t):
    return m.ingest_health_stats(t.runs, AS_OF)


@query("ingest_health", f"""WITH {QUALITY}, {HEALTH}
    SELECT c.source_key, c.enabled, c.type, h.discovered AS discovered_24h, h.fetched AS fetched_24h, h.saved AS saved_24h,
      h.blocked AS blocked_24h, h.failed AS failed_24h, CASE WHEN h.fetched > 0 THEN h.failed / h.fetched END AS fail_rate_24h,
      h.last_error, h.last_ok_at,
      CASE WHEN h.source_key IS NULL THEN 'unknown' WHEN coalesce(q.full_count_7d,0) > 0 THEN 'ok'
           WHEN coalesce(q.teaser_count_7d,0) > 0 THEN 'degraded' WHEN h.fetched > 0 AND h.saved = 0 THEN 'extract'
           WHEN h.fetched = 0 AND h.blocked > 0 THEN 'blocked' WHEN h.discovered = 0 THEN 'config' ELSE 'unknown' END AS classification,
      coalesce(q.full_count_7d,0) AS full_count_7d, coalesce(q.teaser_count_7d,0) AS teaser_count_7d, coalesce(q.blocked_count_7d,0) AS blocked_count_7d,
      coalesce(q.full_count_7d,0) AS feed_full_count_7d, coalesce(q.teaser_count_7d,0) AS feed_teaser_count_7d, coalesce(q.blocked_count_7d,0) AS feed_blocked_count_7d
    FROM fx_config c LEFT JOIN health h USING (source_key) LEFT JOIN quality q USING (source_key)""")
def _(t):
    return m.ingest_health(t.config, t.articles, t.feed, t.sources, t.runs, AS_OF)


@query("overview_stats", f"""WITH w AS (SELECT * FROM fx_articles WHERE NOT is_deleted AND published_at >= {T} - INTERVAL 7 DAY),
    best AS (SELECT source_id, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, source_id LIMIT 5)
    SELECT 'total_24h' AS metric, '' AS key, NULL::VARCHAR AS name, count(*) AS n FROM w WHERE published_at >= {T} - INTERVAL 24 HOUR
    UNION ALL SELECT 'total_7d', '', NULL, count(*) FROM w
    UNION ALL SELECT 'by_language', coalesce(language,'unknown'), NULL, count(*) FROM w GROUP BY 2
    UNION ALL SELECT 'by_source_type', coalesce(source_type,'unknown'), NULL, count(*) FROM w GROUP BY 2
    UNION ALL SELECT 'top_sources_7d', b.source_id, s.name, b.n FROM best b LEFT JOIN fx_sources s ON s.id = b.source_id""")
def _(t):
    return m.overview_stats(t.feed, t.sources, AS_OF)


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(txt, '{w}')" for w in words) + ")"


@query("activity_24h", f"""WITH w AS (SELECT lower(coalesce(title,'') || ' ' || coalesce(summary,'')) AS txt FROM fx_articles
      WHERE coalesce(published_at, created_at) >= {T} - INTERVAL 24 HOUR)
    SELECT count(*) AS total_24h, count(*) FILTER (WHERE {_has(m.rules.FLAGS['tenders'])}) AS tenders_24h,
      count(*) FILTER (WHERE {_has(m.rules.FLAGS['regulations'])}) AS regulations_24h,
      count(*) FILTER (WHERE {_has(m.rules.FLAGS['high_impact'])}) AS high_impact_24h FROM w""")
def _(t):
    return m.activity(t.articles, AS_OF)


@query("source_counts", f"""WITH w AS (SELECT *, published_at >= {T} - INTERVAL 24 HOUR AS d FROM fx_articles
      WHERE NOT is_deleted AND published_at >= {T} - INTERVAL 7 DAY)
    SELECT w.source_id, count(*) FILTER (WHERE d) AS count_24h, max(published_at) FILTER (WHERE d) AS last_24h, count(*) AS count_7d,
      max(published_at) AS last_7d, any_value(s.name) AS name FROM w LEFT JOIN fx_sources s ON s.id = w.source_id GROUP BY 1""")
def _(t):
    return m.source_counts(t.feed, t.sources, AS_OF)


@query("run_errors_by_job", """SELECT job_name, count(*) AS errors FROM (SELECT * FROM fx_runs ORDER BY started_at DESC, id DESC LIMIT 200)
    WHERE NOT ok GROUP BY 1""")
def _(t):
    return m.run_errors_by_job(t.runs)


@query("source_health_status", f"""WITH items AS (SELECT source_id, max(created_at) FILTER (WHERE created_at >= {T} - INTERVAL 7 DAY) AS last_item_at,
        count(*) FILTER (WHERE published_at >= {T} - INTERVAL 24 HOUR) AS items_24h, count(*) FILTER (WHERE published_at >= {T} - INTERVAL 7 DAY) AS items_7d
      FROM fx_articles WHERE NOT is_deleted GROUP BY 1),
    log AS (SELECT source_key, CAST(sum(CASE WHEN started_at >= {T} - INTERVAL 24 HOUR THEN blocked ELSE 0 END) AS BIGINT) AS blocked_24h,
        arg_max(last_error, started_at) FILTER (WHERE last_error IS NOT NULL) AS last_error
      FROM fx_runs WHERE started_at >= {T} - INTERVAL 7 DAY GROUP BY 1)
    SELECT s.id AS source_id, s.name, last_item_at, coalesce(items_24h,0) AS items_24h, coalesce(items_7d,0) AS items_7d,
      coalesce(blocked_24h,0) AS blocked_24h, last_error,
      CASE WHEN coalesce(blocked_24h,0) > 0 AND coalesce(items_24h,0) = 0 THEN 'blocked'
           WHEN is_active AND (last_item_at IS NULL OR last_item_at < {T} - INTERVAL 24 HOUR) THEN 'stale' ELSE 'ok' END AS status
    FROM fx_sources s LEFT JOIN items i ON i.source_id = s.id LEFT JOIN log l ON l.source_key = s.key""")
def _(t):
    return m.source_health_status(t.feed, t.runs, t.sources, AS_OF)


DAILY = f"""daily AS (SELECT *, {ATT} AS att FROM fx_runs WHERE started_at >= {D0} AND started_at < {D1} AND job_name = 'page_ingest'
      AND NOT ({ATT} > 0 AND saved > {ATT}))"""


@query("daily_run_metrics", f"""WITH {DAILY}, s AS (SELECT source_key, CAST(sum(saved) AS BIGINT) AS saved_new,
      CAST(sum(updated_existing) AS BIGINT) AS updated_existing, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(blocked) AS BIGINT) AS blocked,
      CAST(sum(att) AS BIGINT) AS attempted, CAST(sum(coalesce(total,0)) AS BIGINT) AS total, CAST(sum(junk_saved) AS BIGINT) AS junk_saved,
      CAST(sum(coalesce(deduped_existing, dedup_existing, 0)) AS BIGINT) AS dedup_existing, CAST(sum(dedup_new) AS BIGINT) AS dedup_new,
      bool_or(discovery_degraded) AS discovery_degraded, bool_or(fetch_degraded) AS fd FROM daily GROUP BY 1)
    SELECT * EXCLUDE (fd), CASE WHEN attempted > 0 THEN failed / attempted END AS fail_rate, CASE WHEN attempted > 0 THEN blocked / attempted END AS block_rate,
      CASE WHEN attempted > 0 THEN saved_new / attempted END AS kept_ratio, fd OR (attempted = 0 AND (failed > 0 OR blocked > 0)) AS fetch_degraded FROM s""")
def _(t):
    return m.daily_run_metrics(t.runs, DAY)


@query("daily_error_rates", f"""WITH {DAILY}, s AS (SELECT source_key, CAST(sum(att) AS BIGINT) AS attempted,
      {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in m.ERROR_CLASSES)} FROM daily GROUP BY 1)
    SELECT *, CASE WHEN attempted > 0 THEN err_dns / attempted END AS dns_rate, CASE WHEN attempted > 0 THEN err_timeout / attempted END AS timeout_rate,
      CASE WHEN attempted > 0 THEN (err_http_403 + err_http_429 + err_http) / attempted END AS http_rate FROM s""")
def _(t):
    return m.daily_error_rates(t.runs, DAY)


@query("summary_state", f"""WITH a AS (SELECT coalesce(s.key,'unknown') AS source_key, CASE WHEN summary_status = 'DONE_FASTPATH' THEN 'DONE' ELSE summary_status END AS st,
      summary_updated_at >= {D0} AND summary_updated_at < {D1} AS today FROM fx_articles a LEFT JOIN fx_sources s ON s.id = a.source_id)
    SELECT source_key, count(*) FILTER (WHERE st = 'DONE') AS done, count(*) FILTER (WHERE st = 'PENDING') AS pending,
      count(*) FILTER (WHERE st = 'TIMEOUT') AS timeout, count(*) FILTER (WHERE st = 'ERROR') AS error,
      count(*) FILTER (WHERE st = 'DONE' AND today) AS done_today FROM a GROUP BY 1""")
def _(t):
    return m.summary_state(t.articles, t.sources, DAY)


@query("article_counts", f"""WITH c AS (SELECT s.key AS source_key, count(*) AS n, count(*) FILTER (WHERE published_at >= {T} - INTERVAL 48 HOUR) AS n48
      FROM fx_articles a JOIN fx_sources s ON s.id = a.source_id WHERE published_at >= {T} - INTERVAL 7 DAY GROUP BY 1)
    SELECT * FROM (SELECT 'top' AS metric, source_key, n FROM c ORDER BY n DESC, source_key LIMIT 5)
    UNION ALL SELECT 'active_48h', '', count(*) FILTER (WHERE n48 > 0) FROM c""")
def _(t):
    return m.article_counts(t.articles, t.sources, AS_OF)


@query("null_audit", """SELECT count(*) AS total_rows, count(*) FILTER (WHERE next_attempt_at IS NULL) AS next_attempt_at_nulls,
    count(*) FILTER (WHERE queued_at IS NULL) AS queued_at_nulls, count(*) FILTER (WHERE queued_at_is_estimated) AS queued_at_is_estimated_true FROM fx_deliveries""")
def _(t):
    return m.null_audit(t.deliveries, ["next_attempt_at", "queued_at"], ["queued_at_is_estimated"])


@query("recent_runs", "SELECT id, job_name, started_at, finished_at, ok FROM fx_runs ORDER BY started_at DESC NULLS FIRST, id DESC LIMIT 20")
def _(t):
    return m.latest_runs(t.runs, 20)


@query("latest_per_key", """SELECT source_key, arg_max(id, started_at) AS last_run_id, max(started_at) AS last_run_at,
    arg_max(last_error, started_at) FILTER (WHERE last_error IS NOT NULL) AS last_error,
    max(CASE WHEN ok THEN coalesce(finished_at, started_at) END) AS last_ok_at FROM fx_runs GROUP BY 1""")
def _(t):
    return m.latest_per_source(t.runs)


@query("join_source_dim", """SELECT coalesce(s.key, a.source_id) AS source_key, s.id IS NULL AS missing, count(*) AS n
    FROM fx_articles a LEFT JOIN fx_sources s ON s.id = a.source_id GROUP BY ALL""")
def _(t):
    dim = t.sources.select("id", "key")
    rows = t.articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("c"))
    joined = rows.join(dim, rows.source_id == dim.id, "left")
    return joined.groupBy(F.coalesce("key", "source_id").alias("source_key"), F.col("id").isNull().alias("missing")).agg(F.sum("c").alias("n"))


@query("job_metrics", f"""WITH {ART}, {STATS}, {COVER}, {QUALITY}, {HEALTH}, hl AS (SELECT CASE WHEN h.source_key IS NULL THEN 'unknown' WHEN coalesce(q.full_count_7d,0) > 0 THEN 'ok' WHEN coalesce(q.teaser_count_7d,0) > 0 THEN 'degraded' WHEN h.fetched > 0 AND h.saved = 0 THEN 'extract'
      WHEN h.fetched = 0 AND h.blocked > 0 THEN 'blocked' WHEN h.discovered = 0 THEN 'config' ELSE 'unknown' END AS c FROM fx_config f LEFT JOIN health h USING (source_key) LEFT JOIN quality q USING (source_key))
    SELECT 'coverage' AS area, coalesce(notes, 'ok') AS metric, count(*) AS n FROM cover GROUP BY 2 UNION ALL SELECT 'health', c, count(*) FROM hl GROUP BY 2
    UNION ALL SELECT 'runs', job_name, count(*) FROM fx_runs WHERE NOT ok GROUP BY 2""")
def _(t):
    one = lambda area, df, col: df.groupBy(F.lit(area).alias("area"), col.alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    cover = m.coverage(t.config, t.articles, t.sources, t.runs, AS_OF)
    health = m.ingest_health(t.config, t.articles, t.feed, t.sources, t.runs, AS_OF)
    return one("coverage", cover, F.coalesce("notes", F.lit("ok"))).unionByName(one("health", health, F.col("classification"))).unionByName(
        one("runs", t.runs.where("NOT ok"), F.col("job_name")))
