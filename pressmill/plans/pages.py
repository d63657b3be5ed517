"""Page, quality, tag and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import html as h, rules, summaries as sm, text as tx, urls
from pressmill.operators import metrics as m, pages as pg
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.sources.bind import AS_OF

TXT = q.text_of("html")
TITLE = q.strip(q.unesc(f"regexp_replace(regexp_extract({q.vis('html')}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]+>', ' ', 'g')"))
PAGE = f"""pg AS (SELECT page_id, source_key, url, html, {TXT} AS content, {TITLE} AS title, page_id % 5 IN (0, 2) AS article_meta,
    len(regexp_extract_all({q.vis('html')}, '(?i)<a[\\s>]')) AS anchors FROM fx_pages)"""
SENT = "string_split(regexp_replace({0}, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("html_main_text", f"SELECT page_id, {TXT} AS content FROM fx_pages")
def _(t):
    return t.pages.select("page_id", h.main_text(F.col("html")).alias("content"))


@query("html_title", f"SELECT page_id, {TITLE} AS title FROM fx_pages")
def _(t):
    return t.pages.select("page_id", h.title(F.col("html")).alias("title"))


@query("html_published_at", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-01-05T08:00:00Z' WHEN 1 THEN '2024-01-06' WHEN 4 THEN '2024-01-08' ELSE '2024-01-09' END AS published FROM fx_pages""")
def _(t):
    return t.pages.select("page_id", h.published_at(F.col("html")).alias("published"))


@query("html_article_meta", "SELECT page_id, page_id % 5 IN (0, 2) AS article_meta FROM fx_pages")
def _(t):
    return t.pages.select("page_id", h.has_article_meta(F.col("html")).alias("article_meta"))


@query("html_item_block", """WITH d AS (SELECT page_id, '<div class="item-page" itemscope>' || html || CASE page_id % 3 WHEN 0 THEN '<ul class="pagenav">x' WHEN 1 THEN '<div class="ja-moduletable y">z<div class="bt-social-share">q' ELSE '' END AS html FROM pages)
    SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN substr(html, 34, length(html) - 33 - 21) WHEN 1 THEN regexp_extract(substr(html, 34), '(?s)^(.*)<div class="bt-social-share">q$', 1) ELSE substr(html, 34) END) AS block FROM d""")
def _(t):
    tail = F.expr("CASE page_id % 3 WHEN 0 THEN '<ul class=\"pagenav\">x' WHEN 1 THEN '<div class=\"ja-moduletable y\">z<div class=\"bt-social-share\">q' ELSE '' END")
    page = F.concat(F.lit('<div class="item-page" itemscope>'), "html", tail)
    return t.raw("pages").select("page_id", F.md5(h.item_block(page)).alias("block"))


@query("link_density", f"WITH {PAGE} SELECT page_id, anchors / greatest(length(content), 1) AS density FROM pg")
def _(t):
    return t.pages.select("page_id", h.link_density(F.col("html"), h.main_text(F.col("html"))).alias("density"))


ARTICLE = """(title <> '' AND length(content) >= 200)"""


@query("is_article_like", f"WITH {PAGE} SELECT page_id, {ARTICLE} AS article_like FROM pg")
def _(t):
    html = F.col("html")
    return t.pages.select("page_id", pg.is_article_like(html, h.main_text(html), h.title(html), F.col("url")).alias("article_like"))


JUNK = "(title = '' OR length(content) < 600 OR (anchors / greatest(length(content), 1) > 0.02 AND length(content) < 1200))"


@query("junk_filter", f"WITH {PAGE} SELECT page_id FROM pg WHERE NOT {JUNK}")
def _(t):
    rows = pg.read_pages(t.pages)
    return rows.where(~pg.is_junk_page(F.col("title"), F.col("content"), F.col("link_density"))).select("page_id")


@query("thin_filter", f"WITH {PAGE} SELECT page_id FROM pg WHERE NOT (source_key = 'site1' AND length(content) < 800)")
def _(t):
    rows = pg.assess_pages(t.pages, thin={"site1": 800})
    return rows.where(~((F.col("source_key") == "site1") & (F.length("content") < 800))).select("page_id")


@query("blocked_text", f"""SELECT page_id, {q.has_any("lower(html || CASE WHEN page_id % 6 = 0 THEN ' Checking your BROWSER ' ELSE '' END)", rules.BLOCK_MARKERS)} AS blocked FROM fx_pages""")
def _(t):
    html = F.concat("html", F.expr("CASE WHEN page_id % 6 = 0 THEN ' Checking your BROWSER ' ELSE '' END"))
    return t.pages.select("page_id", rules.blocked_text(html).alias("blocked"))


OUTCOME = f"""CASE WHEN NOT {ARTICLE} THEN 'not_article' WHEN source_key = 'site1' AND length(content) < 800 THEN 'thin_content'
    WHEN NOT article_meta AND source_key <> 'site3' THEN 'no_article_meta' WHEN {JUNK} AND NOT (source_key = 'site2' AND {q.has_any('lower(html || content)', rules.BLOCK_MARKERS)}) THEN 'junk' ELSE 'saved' END"""


@query("job_clean_pages", f"""WITH {PAGE} SELECT page_id, title, content, {OUTCOME} AS outcome, CASE WHEN contains(url, '/en/') THEN 'en' ELSE 'unknown' END AS language, article_meta,
    'full' AS content_kind, 'full' AS verification_status, 80 AS fetch_quality FROM pg""")
def _(t):
    rows = pg.assess_pages(t.pages, thin={"site1": 800}, partial_sources=["site2"], no_meta_sources=["site3"])
    return rows.select("page_id", "title", "content", "outcome", "language", "article_meta", *pg.QUALITY)


@query("content_quality", f"""WITH {PAGE}, o AS (SELECT source_key, {OUTCOME} AS outcome FROM pg)
    SELECT source_key, count(*) FILTER (WHERE outcome = 'saved') AS saved, count(*) FILTER (WHERE outcome = 'not_article') AS not_article,
      count(*) FILTER (WHERE outcome = 'thin_content') AS thin_content, count(*) FILTER (WHERE outcome = 'no_article_meta') AS no_article_meta,
      count(*) FILTER (WHERE outcome = 'junk') AS junk FROM o GROUP BY 1""")
def _(t):
    return pg.page_reject_counts(pg.assess_pages(t.pages, thin={"site1": 800}, partial_sources=["site2"], no_meta_sources=["site3"]))


@query("teaser_fallback", f"""WITH p AS (SELECT page_id, url || '#' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN '  ' ELSE html END AS html FROM pages),
    x AS (SELECT page_id, page_id % 3 = 0 AND url LIKE '%/en/%' AS used, html, {TXT} AS content, {TITLE} AS title FROM p)
    SELECT page_id, used AS used_teaser, CASE WHEN used THEN 'teaser ' || page_id ELSE nullif(title, '') END AS title, CASE WHEN used THEN 'sum' ELSE content END AS content FROM x""")
def _(t):
    raw = t.raw("pages").withColumn("url", F.concat("url", F.lit("#"), "page_id"))
    blank_some = raw.withColumn("html", F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.col("html")))
    teasers = raw.where("url LIKE '%/en/%'").select("url", F.concat(F.lit("teaser "), "page_id").alias("title"), F.lit("sum").alias("summary"))
    return pg.teaser_fallback(blank_some, teasers).select("page_id", "used_teaser", "title", "content")


# ---- stored quality --------------------------------------------------------------------------

INCOMING = """inc AS (SELECT id, source_id, ['full','teaser','title_only','other'][(id % 4 + 1)::INT] AS content_kind, 'partial' AS verification_status,
    [80,30,0,5][(id % 4 + 1)::INT] AS fetch_quality, 'new text ' || id AS content, 'new title' AS title, '' AS summary FROM fx_articles)"""


def incoming(t):
    return t.articles.selectExpr(
        "id", "source_id", "element_at(array('full','teaser','title_only','other'), CAST(id % 4 + 1 AS INT)) AS content_kind", "'partial' AS verification_status",
        "element_at(array(80,30,0,5), CAST(id % 4 + 1 AS INT)) AS fetch_quality", "concat('new text ', id) AS content", "'new title' AS title", "'' AS summary")


_RANK = "CASE lower(coalesce(nullif({0}, ''), 'full')) WHEN 'full' THEN 3 WHEN 'teaser' THEN 2 WHEN 'title_only' THEN 1 ELSE 0 END"


@query("quality_merge", f"""WITH {INCOMING}, old AS (SELECT * FROM fx_articles WHERE NOT is_deleted), j AS (SELECT i.*, o.content_kind AS ok, o.verification_status AS ov, o.fetch_quality AS oq, o.content AS oc, o.title AS ot, o.summary AS os,
      {_RANK.format('i.content_kind')} < 3 AND {_RANK.format('o.content_kind')} > {_RANK.format('i.content_kind')} AND NOT (i.source_id IN ('src1','src2') AND length(coalesce(o.content,'')) < 1800) AS keep FROM inc i LEFT JOIN old o USING (id))
    SELECT id, CASE WHEN keep THEN coalesce(ok, content_kind) ELSE content_kind END AS content_kind, CASE WHEN keep THEN coalesce(ov, verification_status) ELSE verification_status END AS verification_status,
      CASE WHEN keep THEN coalesce(nullif(oq, 0), fetch_quality) ELSE fetch_quality END AS fetch_quality, md5(CASE WHEN keep THEN coalesce(nullif(oc,''), content) ELSE content END) AS content,
      CASE WHEN keep THEN coalesce(ot, title) ELSE title END AS title, CASE WHEN keep THEN coalesce(nullif(os, ''), summary) ELSE summary END AS summary FROM j""")
def _(t):
    merged = pg.quality_merge(t.articles.where("NOT is_deleted"), incoming(t), key="id", short_sources=["src1", "src2"])
    return merged.withColumn("content", F.md5("content")).drop("source_id")


@query("quality_backfill", """WITH f AS (SELECT id, url, coalesce(content_kind, 'full') AS content_kind, coalesce(verification_status, 'full') AS verification_status, coalesce(fetch_quality, 80) AS fetch_quality FROM fx_articles),
    g AS (SELECT url, arg_min(content_kind, id) AS ck, arg_min(verification_status, id) AS vs, arg_min(fetch_quality, id) AS fq FROM f GROUP BY 1)
    SELECT a.id, coalesce(a.content_kind, ck) AS content_kind, coalesce(a.verification_status, vs) AS verification_status, coalesce(a.fetch_quality, fq) AS fetch_quality FROM fx_articles a LEFT JOIN g USING (url)""")
def _(t):
    _, fixed = pg.quality_backfill(t.feed, t.articles)
    return fixed.select("id", *pg.QUALITY)


@query("refetch_upgrade", f"""WITH r AS (SELECT doc_id AS id, 'better' AS t, CASE WHEN doc_id % 8 = 0 THEN 'Access Denied ' || text ELSE text END AS c FROM documents WHERE lang = 'en'),
    x AS (SELECT a.*, r.t, r.c, CASE WHEN r.c IS NULL THEN 'none' WHEN {q.has_any('lower(r.c)', rules.BLOCK_MARKERS)} THEN 'blocked_html' WHEN length({q.strip('r.c')}) < 600 THEN 'content_too_short' ELSE 'ok' END AS res FROM fx_articles a LEFT JOIN r USING (id))
    SELECT id, title, md5(CASE WHEN res = 'ok' THEN c ELSE content END) AS content, CASE WHEN res = 'ok' THEN 'full' ELSE content_kind END AS content_kind,
      CASE WHEN res = 'ok' THEN CASE WHEN length({q.strip('c')}) >= 2000 THEN 90 ELSE 70 END ELSE fetch_quality END AS fetch_quality, res AS refetch_result FROM x""")
def _(t):
    again = t.raw("documents").where("lang = 'en'").selectExpr(
        "doc_id AS id", "'better' AS title", "CASE WHEN doc_id % 8 = 0 THEN concat('Access Denied ', text) ELSE text END AS content")
    done = pg.refetch_upgrade(t.articles, again, key="id")
    return done.select("id", "title", F.md5("content").alias("content"), "content_kind", "fetch_quality", "refetch_result")


@query("content_changed", """WITH n AS (SELECT id, CASE WHEN id % 3 = 0 THEN content ELSE content || '!' END AS content FROM fx_articles),
    x AS (SELECT n.id, sha256(n.content) AS h, coalesce(o.content_hash, sha256(o.content)) AS oh, o.summary_status FROM n LEFT JOIN (SELECT * FROM fx_articles WHERE NOT is_deleted) o USING (id))
    SELECT id, h IS DISTINCT FROM oh AS changed, CASE WHEN h IS DISTINCT FROM oh THEN 'PENDING' ELSE summary_status END AS summary_status, h AS content_hash FROM x""")
def _(t):
    new = t.articles.select("id", F.when(F.col("id") % 3 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!"))).alias("content"))
    return pg.content_changed(t.articles.where("NOT is_deleted"), new, key="id").select("id", "changed", "summary_status", "content_hash")


# ---- text ------------------------------------------------------------------------------------

@query("clean_text", f"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<\\s*br\\s*/?>', chr(10), 'g'), '(?i)</\\s*p\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS a FROM fx_pages),
    y AS (SELECT page_id, {q.unesc('a')} AS a FROM x)
    SELECT page_id, nullif({q.strip("regexp_replace(regexp_replace(regexp_replace(a, '\\s+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")}, '') AS text FROM y""")
def _(t):
    return t.pages.select("page_id", sm.clean_text(F.col("html"), allow_html=True).alias("text"))


_GOOD = "lambda s: NOT " + q.has_any("lower(s)", rules.BOILERPLATE) + " AND length(s) > {0}"


@query("boilerplate_filter", f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'Skip to main content and then read on' WHEN doc_id % 4 = 1 THEN 'هل وصل؟ ' || replace(text, chr(10), ' ') ELSE text END AS t FROM documents),
    y AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n+'), lambda s: {q.strip('s')}), lambda s: s <> '') AS l,
      list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {q.strip('s')}), lambda s: s <> '') AS s FROM x)
    SELECT doc_id, nullif(left(CASE WHEN len(l) <= 2 THEN array_to_string(list_filter(s, {_GOOD.format(40)}), chr(10) || chr(10)) ELSE array_to_string(list_filter(l, {_GOOD.format(25)}), chr(10) || chr(10)) END, 4000), '') AS body FROM y""")
def _(t):
    text = F.expr("CASE WHEN doc_id % 4 = 0 THEN concat(text, '\\nSkip to main content and then read on') WHEN doc_id % 4 = 1 THEN concat('هل وصل؟ ', replace(text, '\\n', ' ')) ELSE text END")
    return t.raw("documents").select("doc_id", sm.drop_boilerplate(text).alias("body"))


def _junk(c: str) -> str:
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda s: {q.strip('s')}), lambda s: s <> '')"
    return (f"(len({lines}) = 0 OR (len({lines}) >= 5 AND 1.0 - len(list_distinct({lines}))::DOUBLE / len({lines}) > 0.5) "
            f"OR ({q.has_any(f'lower({c})', rules.CONSENT_WORDS)} AND length({c}) < 1200))")


@query("repeated_line_junk", f"SELECT doc_id, {_junk('text')} AS junk FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", sm.is_junk(F.col("text")).alias("junk"))


_C = q.squash("text")
_FAST = "trim(left(coalesce(nullif(trim(array_to_string(({1})[1:2], ' ')), ''), {0}), 320))"


@query("fast_summary", f"WITH c AS (SELECT doc_id, {_C} AS c FROM documents) SELECT doc_id, {_FAST.format('c', SENT.format('c'))} AS summary FROM c")
def _(t):
    return t.raw("documents").select("doc_id", sm.fast_summary(tx.collapse(F.col("text"))).alias("summary"))


_EXTRACT = ("CASE WHEN {0} = '' THEN {1} ELSE {1} || chr(10) || chr(10) || '- ' || trim(left(trim(array_to_string((" + SENT + ")[1:3], ' ')), 800)) || chr(10) || chr(10) || '"
            + sm.CLOSING["en"] + "' END")


@query("extractive_summary", f"WITH c AS (SELECT doc_id, {_C} AS c, 'T ' || doc_id AS ttl FROM documents) SELECT doc_id, {_EXTRACT.format('c', 'ttl')} AS summary FROM c")
def _(t):
    return t.raw("documents").select("doc_id", sm.extractive_summary(F.col("text"), F.concat(F.lit("T "), "doc_id")).alias("summary"))


@query("lead_words", f"""WITH c AS (SELECT doc_id, {_C} AS c FROM documents) SELECT doc_id, array_to_string((string_split(c, ' '))[1:40], ' ') AS lead,
    CASE WHEN length(c) <= 280 THEN c ELSE trim(left(c, 280)) || '…' END AS clamped FROM c""")
def _(t):
    return t.raw("documents").select("doc_id", tx.lead_words(F.col("text"), 40).alias("lead"), tx.clamp(F.col("text")).alias("clamped"))


@query("detect_script", "SELECT post_url, CASE WHEN regexp_matches(captured_text, '[؀-ۿݐ-ݿࢠ-ࣿ]') THEN 'ar' ELSE 'en' END AS lang FROM fx_inbox")
def _(t):
    return t.inbox.select("post_url", tx.script_language(F.col("captured_text")).alias("lang"))


@query("credibility", "SELECT CASE k WHEN 'social' THEN 9 WHEN 'rss' THEN 8 ELSE 5 END AS credibility, count(*) AS n FROM (SELECT s.source_type AS k FROM fx_articles a JOIN fx_sources s ON s.id = a.source_id) GROUP BY 1")
def _(t):
    kinds = t.sources.select("id", F.expr("CASE source_type WHEN 'social' THEN 'official' WHEN 'rss' THEN 'institutional' ELSE 'media' END AS k"))
    joined = t.articles.join(kinds, t.articles.source_id == kinds.id).select("k")
    return joined.groupBy(rules.credibility(F.col("k")).alias("credibility")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_title", "SELECT id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM fx_articles")
def _(t):
    return t.articles.select("id", tx.normalize_title(F.col("title")).alias("norm"))


@query("normalize_name", "SELECT id, lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g')) AS norm FROM (SELECT id, regexp_replace(regexp_replace(title, '\\([^()]*\\)', '', 'g'), '\\(.*$', '') AS title FROM fx_articles)")
def _(t):
    wrapped = F.concat("title", F.lit(" (Daily (East)) (x"))
    return t.articles.select("id", tx.normalize_name(wrapped).alias("norm"))


@query("json_in_text", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"id": ' || doc_id || '}' WHEN 1 THEN 'Sure:' || chr(10) || '{"id": ' || doc_id || ', "a": {"b": [1, 2]}}' || chr(10) || 'Done. ' || text ELSE text END AS t FROM documents),
    y AS (SELECT doc_id, trim(t) AS t, nullif(regexp_extract(t, '\\{.*\\}', 0, 's'), '') AS part FROM x)
    SELECT doc_id, CASE WHEN json_valid(t) THEN CASE WHEN t LIKE '{%' THEN CAST(t->>'id' AS BIGINT) END WHEN json_valid(part) THEN CAST(part->>'id' AS BIGINT) END AS id FROM y""")
def _(t):
    noisy = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('{\"id\": ', doc_id, '}') WHEN 1 THEN concat('Sure:\\n{\"id\": ', doc_id, ', \"a\": {\"b\": [1, 2]}}\\nDone. ', text) ELSE text END")
    found = t.raw("documents").select("doc_id", tx.json_in_text(noisy).alias("j"))
    return found.select("doc_id", F.get_json_object("j", "$.id").cast("bigint").alias("id"))


LOW = "lower(coalesce(title,'') || ' ' || coalesce(summary,''))"


@query("category_rules", f"SELECT {q.first_label(LOW, rules.CATEGORIES, 'General')} AS category, count(*) AS n FROM fx_articles GROUP BY 1")
def _(t):
    return t.articles.groupBy(rules.category(F.col("title"), F.col("summary")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("keyword_flags", f"SELECT id, {', '.join(f'{q.has_any(LOW, w)} AS is_{k}' for k, w in rules.FLAGS.items())} FROM fx_articles")
def _(t):
    flags = rules.keyword_flags(F.col("title"), F.col("summary"))
    return t.articles.select("id", *[f.alias(f"is_{k}") for k, f in flags.items()])


@query("sector_rules", f"SELECT {q.first_label('lower(body)', rules.SECTORS, 'unknown')} AS sector, count(*) AS n FROM fx_notices GROUP BY 1")
def _(t):
    return t.notices.groupBy(rules.sector(F.col("body")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {q.has_any(LOW, w)} THEN '{k}' END" for k, w in rules.TAGS.items()) + "], lambda x: x IS NOT NULL)"


@query("topic_tags", f"SELECT id, array_to_string({_TAGS}, ',') AS tags FROM fx_articles")
def _(t):
    return t.articles.select("id", F.array_join(rules.tag_hits(rules.headline_text(F.col("title"), F.col("summary"))), ",").alias("tags"))


@query("job_tag", f"""WITH x AS (SELECT coalesce(category, {q.first_label(LOW, rules.CATEGORIES, 'General')}) AS category_guess, unnest({_TAGS}) AS tag FROM fx_articles)
    SELECT tag, category_guess, count(*) AS n FROM x GROUP BY ALL""")
def _(t):
    return pg.tag_counts(pg.tag_articles(t.articles))


@query("error_bucket", """SELECT source_key, CASE last_error WHEN 'blocked:403' THEN 'err_http_403' WHEN 'request_error:dns' THEN 'err_dns' WHEN 'request_error:ReadTimeout' THEN 'err_timeout' ELSE 'err_other' END AS error_class, count(*) AS n
    FROM fx_runs WHERE last_error IS NOT NULL GROUP BY ALL""")
def _(t):
    return pg.error_counts(m.exploded_runs(t.runs))


@query("giveup_class", """SELECT CASE WHEN id % 3 = 0 THEN 'Timeout' WHEN id % 3 = 1 THEN 'missing_article' ELSE 'unknown' END AS error_class, channel, count(*) AS n
    FROM fx_deliveries WHERE status = 'FAILED' AND attempt_count >= 5 GROUP BY ALL""")
def _(t):
    error = F.expr("CASE WHEN id % 3 = 0 THEN 'send_exception=Timeout:read' WHEN id % 3 = 1 THEN 'missing_article' ELSE '' END")
    given_up = t.deliveries.where("status = 'FAILED' AND attempt_count >= 5")
    return given_up.groupBy(rules.giveup_class(error).alias("error_class"), "channel").agg(F.count(F.lit(1)).alias("n"))


# ---- summaries -------------------------------------------------------------------------------

_CL = "CASE WHEN contains(content, '<') AND contains(content, '>') THEN trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) ELSE trim(regexp_replace(content, '\\s+', ' ', 'g')) END"
ROUTED = f"""cl AS (SELECT *, {_CL} AS cleaned FROM fx_articles), routed AS (SELECT *, CASE WHEN coalesce(content,'') = '' THEN 'NO_CONTENT'
    WHEN summary_status = 'DONE' AND content_hash = sha256(cleaned) THEN 'HASH_SKIP' WHEN summary_status = 'PENDING' AND coalesce(summary,'') <> '' AND content_hash = sha256(cleaned) THEN 'KEEP_SUMMARY'
    WHEN {q.has_any('lower(url)', rules.BRIEF_PATHS)} THEN 'BRIEF_EXTRACTIVE' WHEN cleaned = '' THEN 'NO_TEXT' WHEN length(cleaned) < 600 AND len(string_split(cleaned, ' ')) < 80 THEN 'SHORT_BOTH'
    WHEN {_junk('content')} THEN CASE WHEN contains(lower(content), 'cookie') OR contains(lower(content), 'privacy') THEN 'JUNK_COOKIE'
      WHEN len(list_distinct(list_filter(list_transform(string_split(content, chr(10)), lambda s: trim(s)), lambda s: s <> ''))) < greatest(1, floor(len(string_split(content, chr(10))) * 0.5)) THEN 'JUNK_REPEATED_LINES' ELSE 'JUNK_OTHER' END
    ELSE 'EXTRACTIVE' END AS route FROM cl)"""


@query("summary_route", f"WITH {ROUTED} SELECT id, route FROM routed")
def _(t):
    return pg.summary_route(t.articles).select("id", "route")


_DUE = "(summary_status = 'PENDING' OR (summary_status = 'TIMEOUT' AND (summary_next_attempt_at IS NULL OR summary_next_attempt_at <= TIMESTAMP '2024-01-31')))"


@query("retry_eligible", f"SELECT id FROM fx_articles WHERE {_DUE}")
def _(t):
    return pg.retry_eligible(t.articles, AS_OF).select("id")


@query("job_summarize", f"""WITH {ROUTED}, d AS (SELECT *, CASE WHEN route = 'SHORT_BOTH' THEN {_FAST.format('cleaned', SENT.format('cleaned'))} WHEN route IN ('EXTRACTIVE','BRIEF_EXTRACTIVE') THEN {_EXTRACT.format('cleaned', 'trim(title)')}
      WHEN route IN ('KEEP_SUMMARY','HASH_SKIP') THEN summary WHEN route = 'NO_TEXT' THEN title ELSE '' END AS ns FROM routed WHERE {_DUE})
    SELECT id, route, ns AS new_summary, CASE WHEN route IN ('HASH_SKIP','KEEP_SUMMARY') THEN 'DONE' WHEN route LIKE 'JUNK%' THEN 'SKIPPED_JUNK' WHEN route = 'NO_CONTENT' THEN summary_status WHEN ns <> '' THEN 'DONE_FASTPATH' ELSE 'ERROR' END AS new_status,
      sha256(cleaned) AS new_content_hash FROM d""")
def _(t):
    due = pg.retry_eligible(t.articles, AS_OF)
    return pg.summarize(due, AS_OF).select("id", "route", "new_summary", "new_status", "new_content_hash")


@query("clean_entity_lists", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS p FROM documents),
    c AS (SELECT doc_id, trim(regexp_replace(w, '\\s+', ' ', 'g')) AS w, min(p) AS p FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rn FROM c WHERE w <> '')
    SELECT doc_id, string_agg(w, '|' ORDER BY p) AS names FROM r WHERE rn <= 15 GROUP BY 1""")
def _(t):
    return t.raw("documents").select("doc_id", F.array_join(sm.clean_entity_list(F.split("text", " ")), "|").alias("names")).where("names <> ''")
