"""The stored tables as views over the test tables, for the checking engine.

Each view has the same columns as the DataFrame of the same name in ``sources.bind``.
"""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
# Order dates are moved so that the last ones end at AS_OF.
_SHIFT = "(TIMESTAMP '2024-01-31' - TIMESTAMP '2001-08-01')"
_K = "CAST(json_extract_string(props, '$.k') AS INT)"

# URL pieces by the generic-syntax regular expression: scheme, host, path, query.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):\/\/([^\/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

VIEWS: dict[str, str] = {
    "fx_articles": """
SELECT doc_id AS id, source AS source, source AS source_id, 'Desk ' || source AS source_name,
       substr(text,1,60) || ' ' || ['oil pipeline restart','central bank loan','militia attack reported','cabinet and minister vote',
         'customs tariff import','migrant detention','tender and procurement notice','weather and culture'][(doc_id % 8 + 1)::INT] AS title,
       substr(text,61,200) AS summary, text AS content, lang AS language,
       CAST(NULL AS VARCHAR) AS translated_content,
       CAST(CASE WHEN doc_id % 9 = 0 THEN 'Energy' END AS VARCHAR) AS category,
       'https://' || CASE WHEN doc_id % 4 = 0 THEN 'www.' ELSE '' END || source || '.example.org/' || lang || '/news/'
         || (doc_id % 700) || CASE WHEN doc_id % 3 = 0 THEN '/?utm_source=feed&b=2&a=1' ELSE '' END AS url,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours((doc_id * 7) % 720) END AS published_at,
       TIMESTAMP '2024-01-01' + to_hours((doc_id * 7) % 720 + 1) AS created_at,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars < 300 THEN 'title_only' WHEN n_chars < 800 THEN 'teaser' ELSE 'full' END AS content_kind,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars < 300 THEN 'blocked' WHEN n_chars < 800 THEN 'partial' ELSE 'full' END AS verification_status,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars < 300 THEN 0 WHEN n_chars < 800 THEN 30 ELSE 80 END AS fetch_quality,
       CASE WHEN doc_id % 5 = 0 THEN 'social' ELSE 'article' END AS source_type,
       doc_id % 17 = 0 AS is_deleted,
       ['DONE','DONE_FASTPATH','PENDING','TIMEOUT','ERROR'][(doc_id % 5 + 1)::INT] AS summary_status,
       TIMESTAMP '2024-01-01' + to_hours((doc_id * 7) % 720 + 2) AS summary_updated_at,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-01-20' + to_hours((doc_id * 11) % 360) END AS summary_next_attempt_at,
       TIMESTAMP '2024-01-20' + to_hours((doc_id * 13) % 264) AS last_seen_at,
       CASE WHEN doc_id % 4 = 1 THEN sha256(text) WHEN doc_id % 4 = 2 THEN sha256('old') END AS content_hash
FROM documents""",
    "fx_sources": """
SELECT 'src' || i AS id, 'src' || i AS key, 'Source ' || i || ' (Daily)' AS name, i % 6 <> 0 AS is_active,
       CASE WHEN i % 3 = 0 THEN 'social' WHEN i % 3 = 1 THEN 'rss' ELSE 'page' END AS source_type,
       'https://src' || i || '.example.org' AS url, '{"priority": ' || (i % 4) || '}' AS meta
FROM range(22) t(i) WHERE i NOT IN (18, 19)""",
    "fx_config": """
SELECT 'src' || i AS source_key, i % 5 <> 0 AS enabled, CASE WHEN i % 3 = 0 THEN 'social' WHEN i % 3 = 1 THEN 'rss' ELSE 'page' END AS type
FROM range(22) t(i) WHERE i <> 20""",
    "fx_runs": f"""
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'page_ingest' ELSE 'rss_ingest' END AS job_name,
       ts AS started_at, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + to_minutes(5) END AS finished_at,
       CASE WHEN event_type = 'error' THEN FALSE WHEN event_id % 19 = 0 THEN NULL ELSE TRUE END AS ok,
       'src' || (user_id % 21) AS source_key,
       {_K} % 7 AS saved,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_K} % 12 END AS attempted,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE {_K} % 15 END AS total,
       CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS failed,
       CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS blocked,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE {_K} % 20 END AS discovered_total,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE {_K} % 10 END AS new_candidates,
       CASE WHEN event_id % 4 = 1 THEN NULL ELSE {_K} % 5 END AS deduped_existing,
       {_K} % 3 AS dedup_existing, {_K} % 4 AS dedup_new, {_K} % 2 AS updated_existing,
       CAST({_K} % 9 = 0 AS INT) AS junk_saved,
       CAST({_K} % 11 = 0 AS INT) AS err_dns, CAST({_K} % 13 = 0 AS INT) AS err_timeout, CAST({_K} % 17 = 0 AS INT) AS err_connect,
       CAST({_K} % 19 = 0 AS INT) AS err_tls, CAST({_K} % 23 = 0 AS INT) AS err_http_403, CAST({_K} % 29 = 0 AS INT) AS err_http_429,
       CAST({_K} % 31 = 0 AS INT) AS err_http, CAST({_K} % 37 = 0 AS INT) AS err_other,
       event_id % 50 = 0 AS fetch_degraded, event_id % 60 = 0 AS discovery_degraded,
       CASE WHEN event_type = 'error' THEN ['blocked:403','request_error:dns','request_error:ReadTimeout','parse_error:ValueError'][(event_id % 4 + 1)::INT] END AS last_error
FROM events""",
    "fx_searches": """
SELECT c_custkey AS id, c_custkey % 300 AS user_id, 'Search ' || c_custkey AS name,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ['pipeline','central bank','attack -vote','minister','customs tariff','"tender and procurement"'][(c_custkey % 6 + 1)::INT] END AS query,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 + c_custkey % 30 END AS days,
       CASE WHEN c_custkey % 5 = 0 THEN 'Energy' WHEN c_custkey % 5 = 1 THEN '' END AS category,
       CASE WHEN c_custkey % 6 = 0 THEN 'src' || (c_custkey % 20) END AS source,
       CASE WHEN c_custkey % 8 = 0 THEN 'telegram' ELSE 'email' END AS channel, c_custkey % 10 <> 0 AS active
FROM customer""",
    "fx_alerts": """
SELECT c_custkey AS id, c_custkey % 300 AS user_id, c_custkey AS saved_search_id,
       CASE WHEN c_custkey % 8 = 0 THEN 'telegram' ELSE 'email' END AS channel,
       'target' || c_custkey AS target, c_custkey % 10 <> 0 AS active
FROM customer""",
    "fx_prefs": """
SELECT u AS user_id, 3600 * (1 + u % 12) AS dedupe_window_sec,
       CASE WHEN u % 4 = 0 THEN NULL WHEN u % 4 = 1 THEN CAST([] AS VARCHAR[]) ELSE ['energy'] END AS priority_categories,
       CASE WHEN u % 5 = 0 THEN ['email','telegram'] ELSE ['email'] END AS channels_enabled,
       CASE WHEN u % 7 = 0 THEN ['P0','P1'] END AS immediate_priorities,
       CASE WHEN u % 9 = 0 THEN ['P1'] END AS digest_priorities,
       CASE WHEN u % 2 = 0 THEN 'weekly' END AS digest_schedule
FROM (SELECT DISTINCT c_custkey % 300 AS u FROM customer) WHERE u % 3 <> 0""",
    "fx_cursors": """
SELECT c_custkey AS alert_id, TIMESTAMP '2024-01-20' + to_hours(c_custkey % 240) AS last_ts
FROM customer WHERE c_custkey % 3 = 0""",
    "fx_deliveries": f"""
SELECT o_orderkey AS id, o_orderkey % 1500 AS alert_id, (o_orderkey % 1500) % 300 AS user_id, o_orderkey % 1000 AS article_id,
       CASE WHEN o_orderkey % 8 = 0 THEN 'telegram' ELSE 'email' END AS channel,
       CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PENDING' ELSE 'SENT' END AS status,
       CAST(o_orderkey % 7 AS INT) AS attempt_count,
       o_orderdate + {_SHIFT} AS created_at,
       o_orderdate + {_SHIFT} AS queued_at,
       o_orderkey % 20 = 0 AS queued_at_is_estimated,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate + {_SHIFT} + to_hours(o_orderkey % 200) END AS next_attempt_at,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + {_SHIFT} + to_hours(3) END AS last_attempt_at,
       'k' || (o_orderkey % 400) AS dedupe_key, 'P' || least(CAST(substr(o_orderpriority,1,1) AS INT) - 1, 2) AS priority
FROM orders""",
    "fx_quotes": """
SELECT l_orderkey, l_linenumber, 'S' || l_suppkey AS instrument,
       CASE l_returnflag WHEN 'A' THEN 'official' WHEN 'N' THEN 'parallel' ELSE 'spot' END AS rate_type,
       CASE WHEN l_linestatus = 'O' THEN 'LYD' ELSE 'USD' END AS quote_currency, l_extendedprice AS value, l_shipdate AS as_of,
       l_shipdate + to_hours(1) AS fetched_at
FROM lineitem""",
    "fx_notices": """
SELECT doc_id AS id, source AS source_key, lang AS language, 'https://' || source || '.example.org/n/' || doc_id AS url,
       text || CASE
         WHEN doc_id % 5 = 0 THEN ' Closing date: ' || (doc_id % 28 + 1) || '/' || (doc_id % 12 + 1) || '/2024'
         WHEN doc_id % 5 = 1 THEN ' Submission deadline - ' || (doc_id % 28 + 1) || '-' || (doc_id % 12 + 1) || '-24'
         WHEN doc_id % 5 = 2 THEN ' آخر موعد ' || translate((doc_id % 28 + 1) || '/' || (doc_id % 12 + 1) || '/2024', '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' مناقصة'
         WHEN doc_id % 5 = 3 THEN ' Closing date: 31/02/2024 drilling rig' ELSE ' generator and transformer' END AS body,
       TIMESTAMP '2024-01-01' + to_hours((doc_id * 7) % 720) AS created_at
FROM documents""",
    "fx_inbox": """
SELECT 'fb_' || (conv_id % 14) AS source_id, 'https://social.example.org/' || conv_id || '/' || turn AS post_url,
       CASE WHEN role = 'system' THEN '' WHEN conv_id % 6 = 0 THEN 'خبر عاجل ' || text ELSE text END AS captured_text,
       TIMESTAMP '2024-01-01' + to_hours((conv_id * 3 + turn) % 720) AS captured_at
FROM conversations""",
    "fx_candidates": """
SELECT page_id AS pos, url, html, CASE WHEN page_id % 3 = 0 THEN 'news' WHEN page_id % 3 = 1 THEN 'inbrief' ELSE 'other' END AS bucket,
       'site' || (page_id % 4) AS source_key, page_id % 7 < 3 AS stored
FROM pages""",
    "fx_pages": """
SELECT page_id, url, 'site' || (page_id % 4) AS source_key,
  replace(replace(html, '<head>', '<head>' || CASE page_id % 5
    WHEN 0 THEN '<meta property="og:type" content="article"><meta content="2024-01-05T08:00:00Z" property="article:published_time">'
    WHEN 1 THEN '<meta name="pubdate" content=" 2024-01-06 ">'
    WHEN 2 THEN '<script type="application/ld+json">[{"@type":["Thing","NewsArticle"]}]</script>'
    WHEN 3 THEN '<!-- <meta property="og:type" content="article"> -->' ELSE '<meta name="dc.date" content="2024-01-08">' END),
   '</nav>', '<a href="/news/2024/1/' || (page_id % 9 + 1) || '/story-' || page_id || '?utm_source=x&amp;p=1#c">Story</a>'
    || '<a href="/news/2024/1/' || (page_id % 9 + 1) || '/story-' || page_id || '/?p=1">Again</a>'
    || '<a class="d" href="/docs/2024/tender/file' || (page_id % 3) || '.pdf">Tender file</a><a href="/docs/2024/tender/file' || (page_id % 3) || '.pdf">Copy</a>'
    || '<a href="mailto:a@b.c">m</a><a href="/category/x/">c</a><a href="https://other.example.org/press/9">o</a><time datetime="2024-01-09">t</time></nav>') AS html
FROM pages""",
    "fx_topics": """
SELECT * FROM (VALUES
  ('energy_en', 1, 'en', ['oil_gas'], ['is','the'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0),
  ('banking_en', 2, 'en', ['banking'], ['er','re'], ['bank','loan'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['src3.example.org'], 40),
  ('security_any', 3, NULL, ['security','governance'], ['e'], CAST([] AS VARCHAR[]), ['attack','vote'], ['militia','minister'], ['src1.example.org'], 0),
  ('trade_de', 4, 'de', ['regulation'], ['en'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 25))
  t(topic_key, priority, topic_lang, tags, location_terms, require_terms, require_terms_any, require_terms_any2, preferred_domains, max_processed)""",
    "fx_topic_items": """
SELECT ['energy_en','banking_en','security_any','trade_de'][(doc_id % 4 + 1)::INT] AS topic_key, doc_id AS pos,
       CASE WHEN doc_id % 29 = 0 THEN NULL
            WHEN doc_id % 31 = 0 THEN 'https://www.facebook.com/p/' || doc_id
            ELSE 'https://' || source || '.example.org/' || lang || '/' || (doc_id % 160) || CASE WHEN doc_id % 3 = 0 THEN '/?utm_source=x&b=2' ELSE '' END END AS url,
       substr(text,1,60) || ' ' || ['oil pipeline restart','central bank loan','militia attack reported','cabinet and minister vote',
         'customs tariff import','migrant detention','tender and procurement notice','weather and culture'][(doc_id % 8 + 1)::INT] AS title,
       text AS snippet,
       CASE WHEN doc_id % 6 = 0 THEN 'bad' ELSE strftime(TIMESTAMP '2024-01-01' + to_hours((doc_id * 7) % 720), '%Y%m%d%H%M%S') END AS seendate,
       lang AS language
FROM documents""",
}
