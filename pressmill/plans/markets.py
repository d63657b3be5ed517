"""Tender and quote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import rules
from pressmill.operators import quotes as qt, tenders as td
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.session import scratch_path
from pressmill.sources.bind import AS_OF

T = "TIMESTAMP '2024-01-31'"
# Planted dates: day = id % 28 + 1, month = id % 12 + 1; id % 5 = 3 carries an impossible date.
DEADLINE = "CASE WHEN id % 5 < 3 THEN make_date(2024, id % 12 + 1, id % 28 + 1) END"
SECTOR = q.first_label("lower(body)", rules.SECTORS, "unknown")
WORDS = q.has_any("body", rules.TENDER_WORDS)


@query("extract_deadline", f"SELECT id, {DEADLINE} AS deadline FROM fx_notices")
def _(t):
    return t.notices.select("id", td.extract_deadline(F.col("body")).alias("deadline"))


def _notice_rows(t):
    """Notices as feed rows; the text of an attachment is the article's summary with a tender word for some."""
    return t.notices.selectExpr(
        "id", "source_key", "language", "url", "body", "created_at AS ingested_at", "created_at AS published_at",
        "CASE WHEN id % 4 = 0 THEN concat('كراسة الشروط ', body) END AS attachment_text", "CAST(id % 3 AS INT) AS attachments_count")


def _tender_sources(t):
    return t.sources.select(
        F.col("key").alias("source_key"), F.col("is_active").alias("needs_words"), F.when(F.col("source_type") == "rss", F.col("name")).alias("buyer"),
        F.when(F.col("source_type") == "page", "donor").alias("sector"))


def _stored_tenders(t):
    """Tenders that exist already: German notices."""
    return t.notices.where("language = 'de'").select(F.col("id").alias("raw_article_id"), "url")


GATE = f"""n AS (SELECT id, source_key, language, url, body, created_at, CASE WHEN id % 4 = 0 THEN 'كراسة الشروط ' || body END AS att, id % 3 AS ac FROM fx_notices),
    j AS (SELECT n.*, coalesce(s.is_active, false) AS nw, CASE WHEN s.source_type = 'rss' THEN s.name END AS buyer, CASE WHEN s.source_type = 'page' THEN 'donor' END AS cs FROM n LEFT JOIN fx_sources s ON s.key = n.source_key),
    g AS (SELECT *, CASE WHEN NOT nw THEN CASE WHEN body = '' THEN 'empty' ELSE 'open' END WHEN {WORDS} THEN 'html' WHEN att IS NOT NULL THEN 'attachment' ELSE 'fail' END AS gate FROM j)"""
FIELDS = f"""f AS (SELECT *, CASE WHEN gate = 'attachment' THEN att ELSE body END AS txt, coalesce(cs, {SECTOR}) AS sector, {DEADLINE} AS deadline_date FROM g WHERE gate NOT IN ('fail','empty')),
    tenders AS (SELECT source_key AS source, coalesce(buyer, source_key) AS buyer, left(string_split(txt, chr(10))[1], 200) AS title, array_to_string((string_split({q.squash('txt')}, ' '))[1:40], ' ') AS summary, created_at::DATE AS publish_date, deadline_date, sector, url, id AS raw_article_id, language,
      round(0.2 + CASE WHEN deadline_date IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN sector <> 'unknown' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence_score, CAST(ac AS INT) AS attachments_count, created_at FROM f)"""


@query("tender_gate", f"WITH {GATE} SELECT id, gate FROM g")
def _(t):
    return td.gate(_notice_rows(t), _tender_sources(t)).select("id", "gate")


@query("tender_fields", f"WITH {GATE}, {FIELDS} SELECT * EXCLUDE (created_at) FROM tenders")
def _(t):
    judged = td.gate(_notice_rows(t), _tender_sources(t)).where("gate NOT IN ('fail', 'empty')")
    return td.tender_fields(judged).drop("pdf_text", "seq")


@query("tender_confidence", f"WITH {GATE}, {FIELDS} SELECT confidence_score, count(*) AS n FROM tenders GROUP BY 1")
def _(t):
    judged = td.gate(_notice_rows(t), _tender_sources(t)).where("gate NOT IN ('fail', 'empty')")
    return td.tender_fields(judged).groupBy("confidence_score").agg(F.count(F.lit(1)).alias("n"))


@query("anti_new_tenders", "SELECT id FROM fx_notices WHERE language <> 'de'")
def _(t):
    done = _stored_tenders(t).select(F.col("raw_article_id").alias("id"))
    return t.notices.join(done, "id", "left_anti").select("id")


_NEW = f"""WITH {GATE}, {FIELDS}, cand AS (SELECT id FROM n WHERE language <> 'de'), ins AS (SELECT * FROM tenders WHERE raw_article_id IN (SELECT id FROM cand) QUALIFY row_number() OVER (PARTITION BY url ORDER BY raw_article_id DESC) = 1)"""


def _extracted(t):
    return td.extract_tenders(_notice_rows(t), _stored_tenders(t), _tender_sources(t))


@query("extract_tenders", f"{_NEW} SELECT raw_article_id, url, buyer, title, sector, deadline_date, confidence_score FROM ins")
def _(t):
    new, _ = _extracted(t)
    return new.select("raw_article_id", "url", "buyer", "title", "sector", "deadline_date", "confidence_score")


@query("extract_gate_stats", f"""{_NEW}, c AS (SELECT g.* FROM g JOIN cand USING (id)) SELECT 'candidates' AS metric, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'gate_html', count(*) FROM c WHERE gate = 'html' UNION ALL SELECT 'gate_attachment', count(*) FROM c WHERE gate = 'attachment'
    UNION ALL SELECT 'gate_fail', count(*) FROM c WHERE gate = 'fail' UNION ALL SELECT 'gate_fail_rate', count(*) FILTER (WHERE gate = 'fail') / count(*) FROM c UNION ALL SELECT 'inserted', count(*) FROM ins""")
def _(t):
    new, judged = _extracted(t)
    return td.gate_stats(judged, new)


def _tender_table(t):
    judged = td.gate(_notice_rows(t), _tender_sources(t)).where("gate NOT IN ('fail', 'empty')")
    times = t.notices.select(F.col("id").alias("raw_article_id"), "created_at")
    return td.tender_fields(judged).join(times, "raw_article_id")


BUY = f"""w AS (SELECT *, coalesce(nullif(buyer, ''), source) AS who FROM tenders WHERE created_at >= {T} - INTERVAL 7 DAY), b AS (SELECT who, arg_max(sector, (created_at, raw_article_id)) AS sector, count(*) AS n FROM w GROUP BY 1)"""


@query("tender_by_buyer", f"WITH {GATE}, {FIELDS}, {BUY} SELECT * FROM b")
def _(t):
    return td.by_buyer(_tender_table(t), AS_OF)


_LINE = q.strip("replace(coalesce({0},''), chr(10), ' ')")
DIGEST = f"""{GATE}, {FIELDS}, {BUY}, r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY created_at DESC, raw_article_id DESC) AS k FROM w), lines AS (
    SELECT 0 AS part, '' AS buyer, 1 AS line_no, '# Procurement Digest' AS line UNION ALL SELECT 0, '', 2, '' UNION ALL SELECT 0, '', 3, '**Window:** 2024-01-24 -> 2024-01-31' UNION ALL SELECT 0, '', 4, '**Total new items:** ' || (SELECT count(*) FROM w)
    UNION ALL SELECT 0, '', 5, '' UNION ALL SELECT 0, '', 6, '## Summary by buyer' UNION ALL SELECT 1, who, 0, '- **' || who || '** (' || sector || '): ' || n FROM b UNION ALL SELECT 2, '', 0, ''
    UNION ALL SELECT 3, who, -5, '## ' || who FROM b UNION ALL SELECT 3, who, -4, '**Sector:** ' || sector || '  |  **Count:** ' || n FROM b UNION ALL SELECT 3, who, -3, '' FROM b UNION ALL SELECT 3, who, -2, '| Title | Published | Deadline | Attachments | Link |' FROM b
    UNION ALL SELECT 3, who, -1, '|---|---:|---:|---:|---|' FROM b UNION ALL SELECT 3, who, 1000000, '' FROM b
    UNION ALL SELECT 3, who, k, '| ' || coalesce(nullif(left({_LINE.replace('{0}', 'title')}, 160), ''), '(no title)') || ' | ' || publish_date || ' | ' || coalesce(deadline_date::VARCHAR, '') || ' | ' || attachments_count || ' | ' || url || ' |' FROM r WHERE k <= 200)"""


@query("procurement_digest", f"WITH {DIGEST} SELECT CAST(part AS INT) AS part, buyer, CAST(line_no AS INT) AS line_no, line FROM lines")
def _(t):
    return td.digest_lines(_tender_table(t), AS_OF)


@query("job_tenders", f"WITH {DIGEST} SELECT line AS value, count(*) AS n FROM lines GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "digest")
    td.write_digest(td.digest_lines(_tender_table(t), AS_OF), path)
    return t.spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# ---- quotes ----------------------------------------------------------------------------------

def _incoming(t):
    """Quotes of open lines are new, the others are stored."""
    seq = F.expr("l_orderkey * 10 + l_linenumber + value / 1000000").alias("seq")
    return t.quotes.where("quote_currency = 'LYD'").select("instrument", "rate_type", "quote_currency", "value", "as_of", F.lit("ok").alias("status"), seq)


def _existing(t):
    rows = t.quotes.select("instrument", "rate_type", "quote_currency", "value", "as_of", "fetched_at", F.lit("ok").alias("status"), F.expr("l_orderkey * 10 + l_linenumber + value / 1000000").alias("seq"))
    return qt.latest(rows, "seq").drop("seq")


LATEST = "latest AS (SELECT instrument, rate_type, quote_currency, arg_max(value, (as_of, l_orderkey * 10 + l_linenumber + value / 1000000)) AS value, max(as_of) AS as_of, max(as_of) + INTERVAL 1 HOUR AS fetched_at FROM fx_quotes GROUP BY ALL)"
REFRESH = f"""{LATEST}, inc AS (SELECT instrument, rate_type, quote_currency, arg_max(value, l_orderkey * 10 + l_linenumber + value / 1000000) AS v, arg_max(as_of, l_orderkey * 10 + l_linenumber + value / 1000000) AS a FROM fx_quotes WHERE quote_currency = 'LYD' GROUP BY ALL),
    ref AS (SELECT l.instrument, l.rate_type, l.quote_currency, coalesce(v, value) AS value, coalesce(a, as_of) AS as_of, CASE WHEN v IS NOT NULL THEN {T} ELSE fetched_at END AS fetched_at, CASE WHEN v IS NULL AND fetched_at < {T} - INTERVAL 180 MINUTE THEN 'stale' ELSE 'ok' END AS status FROM latest l LEFT JOIN inc USING (instrument, rate_type, quote_currency))"""


@query("latest_quotes", f"WITH {LATEST} SELECT * FROM latest")
def _(t):
    return _existing(t).drop("status")


@query("market_refresh", f"WITH {REFRESH} SELECT * FROM ref")
def _(t):
    return qt.refresh(_existing(t), _incoming(t), AS_OF, "seq")


@query("job_quotes", f"WITH {REFRESH} SELECT 'updated' AS metric, count(*) AS n FROM inc UNION ALL SELECT status, count(*) FROM ref GROUP BY 1")
def _(t):
    return qt.refresh_counts(qt.refresh(_existing(t), _incoming(t), AS_OF, "seq"), _incoming(t))


@query("fx_pairs", f"""WITH {REFRESH} SELECT instrument, max(value) FILTER (WHERE rate_type = 'official') AS official, max(value) FILTER (WHERE rate_type = 'parallel') AS parallel,
    coalesce(max(as_of) FILTER (WHERE rate_type = 'official'), max(as_of) FILTER (WHERE rate_type = 'parallel')) AS as_of, bool_or(status <> 'ok') AS warn FROM ref WHERE quote_currency = 'LYD' AND rate_type <> 'spot' GROUP BY 1""")
def _(t):
    return qt.pairs(qt.refresh(_existing(t), _incoming(t), AS_OF, "seq"))


@query("quotes_sorted", f"WITH {LATEST} SELECT instrument, rate_type, quote_currency, value FROM latest ORDER BY 1, 2, 3")
def _(t):
    return qt.listing(_existing(t)).select("instrument", "rate_type", "quote_currency", "value")


@query("latest_as_of", "SELECT max(as_of) AS as_of FROM fx_quotes")
def _(t):
    return qt.latest_as_of(t.quotes)
