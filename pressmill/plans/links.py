"""URL, link and link-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import urls as u
from pressmill.operators import links as lk
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.sources.config import rule_table


def _joined(col: str = "links"):
    return F.array_join(col, " ")


@query("url_canonical_alert", f"SELECT id, {q.canon_alert('url')} AS canonical FROM fx_articles")
def _(t):
    return t.articles.select("id", u.canonical_alert(F.col("url")).alias("canonical"))


@query("url_canonical_feed", f"SELECT id, {q.canon_feed('url')} AS canonical FROM fx_articles")
def _(t):
    return t.articles.select("id", u.canonical_feed(F.col("url")).alias("canonical"))


@query("url_canonical_page", f"SELECT page_id, {q.canon_page('url')} AS canonical FROM pages")
def _(t):
    return t.raw("pages").select("page_id", u.canonical_page(F.col("url")).alias("canonical"))


@query("url_domain", f"SELECT {q.domain('url')} AS domain, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return t.raw("pages").groupBy(u.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("url_external_id", f"SELECT id, sha1({q.canon_feed('url')}) AS external_id FROM fx_articles")
def _(t):
    return t.articles.select("id", u.external_id(F.col("url")).alias("external_id"))


@query("job_canonicalize", f"""SELECT id, {q.canon_alert('url')} AS alert_key, {q.canon_feed('url')} AS feed_key, {q.canon_page('url')} AS page_key,
    {q.domain('url')} AS domain, sha1({q.canon_feed('url')}) AS external_id,
    row_number() OVER (PARTITION BY {q.canon_feed('url')} ORDER BY id) = 1 AS is_first,
    count(*) OVER (PARTITION BY {q.canon_feed('url')}) - 1 AS dropped FROM fx_articles""")
def _(t):
    rows = lk.canonical_forms(t.articles.select("id", "url"))
    # Groups of copies are summarized with map-side combine; no window over a group.
    groups = rows.groupBy("feed_key").agg(F.min("id").alias("first_id"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return rows.join(groups, "feed_key").select(
        "id", "alert_key", "feed_key", "page_key", "domain", "external_id", (F.col("id") == F.col("first_id")).alias("is_first"), "dropped")


@query("dedupe_url", f"SELECT {q.canon_feed('url')} AS canonical, min(id) AS id, count(*) - 1 AS dropped FROM fx_articles GROUP BY 1")
def _(t):
    return lk.dedupe_url(t.articles.select("id", "url"), ["id"]).select("canonical", "id", "dropped")


@query("dedupe_against_store", f"""WITH stored AS (SELECT DISTINCT {q.canon_page('url')} AS k FROM fx_articles WHERE is_deleted)
    SELECT id, {q.canon_page('url')} AS page_key FROM fx_articles WHERE NOT is_deleted AND {q.canon_page('url')} NOT IN (SELECT k FROM stored)""")
def _(t):
    stored = t.articles.where("is_deleted").select("url")
    return lk.dedupe_against_store(t.articles.where("NOT is_deleted").select("id", "url"), stored).select("id", "page_key")


LINKS = f"""links AS (SELECT page_id, source_key, url AS base, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (
    SELECT page_id, source_key, url, list_filter({q.hrefs('html')}, lambda v: NOT (starts_with(v, 'mailto:') OR starts_with(v, 'javascript:'))) AS h FROM fx_pages))"""


@query("extract_links", f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href, {q.rooted('base', 'href')} AS link FROM links")
def _(t):
    return lk.extract_links(t.pages).select("page_id", "pos", "href", "link")


@query("is_index_page", f"""SELECT page_id, ({q.has_any('lower(url)', u.DENY_PARTS)} OR regexp_matches(rtrim(lower(url), '/'), '(/blog|/news|/announcements|/press-releases|/press)$'))
    AS index_like, len(list_filter(string_split({q.piece('url', 3)}, '/'), lambda s: s <> '')) = 1 AND
      regexp_matches({q.piece('url', 3)}, '(?i)^/*(news|inbrief|economy|politics|sports|opinions)/*$') AS single_section FROM fx_pages""")
def _(t):
    c = F.col("url")
    return t.pages.select("page_id", u.looks_like_index(c).alias("index_like"), u.is_single_section(c).alias("single_section"))


_ABS = f"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href WHEN starts_with(href, '/') THEN {q.piece('base', 1)} || '://' || {q.piece('base', 2)} || href END"""
_SAMEHOST = f"lower({q.piece('abs', 1)}) IN ('http','https') AND {q.piece('abs', 2)} = {q.piece('base', 2)}"
_KEYWORDS = q.has_any(f"lower({q.piece('k', 3)})", lk.LINK_KEYWORDS)


@query("extract_internal_links", f"""WITH {LINKS}, a AS (SELECT *, {_ABS} AS abs FROM links), k AS (SELECT *, {q.canon_page('abs')} AS k, {q.canon_page('base')} AS bk FROM a WHERE {_SAMEHOST}),
    f AS (SELECT page_id, k, min(pos) AS pos FROM k WHERE rtrim(k, '/') <> rtrim(bk, '/') AND NOT {q.has_any('lower(k)', u.DENY_PARTS)}
      AND NOT regexp_matches(rtrim(lower(k), '/'), '(/blog|/news|/announcements|/press-releases|/press)$') AND {_KEYWORDS} GROUP BY 1, 2)
    SELECT page_id, string_agg(k, ' ' ORDER BY pos) AS links FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM f) WHERE rn <= 20 GROUP BY 1""")
def _(t):
    return lk.extract_internal_links(t.pages).where(F.size("links") > 0).select("page_id", _joined().alias("links"))


@query("discover_article_links", f"""WITH all_links AS (SELECT page_id, url AS base, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (SELECT page_id, url, {q.hrefs('html')} AS h FROM fx_pages)),
    k AS (SELECT page_id, base, pos, {q.canon_page(_ABS)} AS k FROM all_links WHERE NOT starts_with(href, 'mailto:')),
    f AS (SELECT page_id, k, min(pos) AS pos FROM k WHERE {q.piece('k', 2)} = {q.piece('base', 2)} AND NOT starts_with({q.piece('k', 3)}, '/cdn-cgi/')
        AND NOT regexp_matches({q.piece('k', 3)}, '{q.MEDIA}') AND {q.piece('k', 3)} NOT IN ('', '/') AND NOT regexp_matches({q.piece('k', 3)}, '(?i)^/(user|search)')
        AND (regexp_matches({q.piece('k', 3)}, '{q.HINT}') OR len(string_split(trim({q.piece('k', 3)}, '/'), '/')) >= 2) GROUP BY 1, 2),
    n AS (SELECT page_id, count(*) AS a_count FROM all_links GROUP BY 1)
    SELECT n.page_id, n.a_count, coalesce(string_agg(k, ' ' ORDER BY pos), '') AS links FROM n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM f) f
      ON f.page_id = n.page_id AND rn <= 30 GROUP BY 1, 2""")
def _(t):
    return lk.discover_article_links(t.pages).select("page_id", "a_count", _joined().alias("links"))


@query("harvest_urls", f"""WITH r AS (SELECT page_id, url, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (
      SELECT page_id, url, regexp_extract_all('self ' || url || ' and https://other.example.org/press/9 again ' || url || '/pic.png ' || html, '(?i)https?://[^\\s"''<>]+', 0) AS l FROM fx_pages)),
    f AS (SELECT page_id, {q.canon_page('x')} AS k, min(pos) AS pos FROM r WHERE lower({q.piece('x', 2)}) = lower({q.piece('url', 2)}) AND NOT regexp_matches({q.piece('x', 3)}, '{q.MEDIA}') GROUP BY 1, 2)
    SELECT page_id, string_agg(k, ' ' ORDER BY pos) AS links FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM f) WHERE rn <= 50 GROUP BY 1""")
def _(t):
    text = F.concat(F.lit("self "), "url", F.lit(" and https://other.example.org/press/9 again "), "url", F.lit("/pic.png "), "html")
    return lk.harvest_urls(t.pages.withColumn("html", text)).select("page_id", _joined().alias("links"))


@query("attachments", f"""WITH r AS (SELECT page_id, url, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href="([^"]+\\.(?:pdf|docx?|jpg|jpeg|png))"', 1) AS l FROM fx_pages)),
    d AS (SELECT page_id, {q.rooted('url', 'x')} AS a, min(pos) AS pos FROM r GROUP BY 1, 2)
    SELECT page_id, string_agg(a, ' ' ORDER BY pos) AS attachments, CAST(count(*) AS INT) AS attachments_count FROM d GROUP BY 1""")
def _(t):
    return lk.attachments(t.pages).select("page_id", _joined("attachments").alias("attachments"), "attachments_count")


@query("doc_link_prefixes", f"""WITH {LINKS} SELECT regexp_replace({q.piece(q.rooted('base', 'href'), 3)}, '^((/[^/]*){{3}}).*$', '\\1') AS prefix, count(*) AS n, 'Copy' AS sample_text
    FROM links WHERE contains(lower(href), '.pdf') OR contains(lower(href), '.doc') GROUP BY 1 ORDER BY n DESC, prefix LIMIT 5""")
def _(t):
    return lk.doc_link_prefixes(t.pages)


# ---- link rules ------------------------------------------------------------------------------

_RULES = [
    # key, candidate, order, drop_params, allow_prefixes, deny_prefixes, allow/deny contains, allow/deny regex, pdf allow/deny, must, stage, max_items, max_inserts
    ("site0", True, 2, ["p"], [], [], [], ["/category/"], [], [], ["tender"], ["file2"], [], "", 8, 3),
    ("site1", True, 1, [], ["http"], ["https://other.example.org"], ["/news/", ".pdf"], [], [], [r"story-\d*5$"], [], ["file1"], [], "", 0, 40),
    ("site2", True, 3, [], [], [], [], [], [r"/news/\d{4}/", r"\.pdf$"], [], ["tender"], [], ["story", "file"], "", 0, 0),
    ("site3", False, 4, [], [], [], [], ["mailto"], [], [], [], [], ["news"], "detail", 5, 0),
]
_RULE_SCHEMA = (
    "source_key string, candidate boolean, source_order int, drop_params array<string>, allow_prefixes array<string>, deny_prefixes array<string>,"
    "allow_contains array<string>, deny_contains array<string>, allow_regex array<string>, deny_regex array<string>,"
    "pdf_allow array<string>, pdf_deny array<string>, must_contain array<string>, filter_stage string, max_items int, max_inserts int"
)


def rules(t):
    return rule_table(t.spark, _RULES, _RULE_SCHEMA)


def _ruled(t):
    return lk.extract_links(t.pages).join(rules(t), "source_key")


# Per-source rule text of the table above.
_DROPP = f"CASE WHEN source_key = 'site0' THEN regexp_replace(regexp_replace({q.canon_feed('link')}, '([?&])p=[^&]*&?', '\\1'), '[?&]$', '') ELSE {q.canon_feed('link')} END"
RULED = f"""{LINKS}, l AS (SELECT page_id, source_key, pos, {q.rooted('base', 'href')} AS link FROM links), norm AS (SELECT page_id, source_key, pos, CASE WHEN source_key = 'site0' THEN rtrim({_DROPP}, '/') ELSE {_DROPP} END AS link FROM l)"""
_PREFIX = "(source_key <> 'site1' OR (NOT starts_with(link, 'https://other.example.org') AND starts_with(link, 'http')))"
_CONTAINS = """(CASE source_key WHEN 'site0' THEN NOT contains(lower(link), '/category/') WHEN 'site1' THEN contains(lower(link), '/news/') OR contains(lower(link), '.pdf')
   WHEN 'site3' THEN NOT contains(lower(link), 'mailto') ELSE TRUE END)"""
_REGEX = r"(CASE source_key WHEN 'site1' THEN NOT regexp_matches(link, 'story-\d*5$') WHEN 'site2' THEN regexp_matches(link, '/news/\d{4}/') OR regexp_matches(link, '\.pdf$') ELSE TRUE END)"
_PDF = """(NOT contains(lower(link), '.pdf') OR CASE source_key WHEN 'site0' THEN NOT contains(lower(link), 'file2') AND contains(lower(link), 'tender')
   WHEN 'site1' THEN NOT contains(lower(link), 'file1') WHEN 'site2' THEN contains(lower(link), 'tender') ELSE TRUE END)"""
_MUST = "(CASE source_key WHEN 'site2' THEN contains(lower(link), 'story') OR contains(lower(link), 'file') ELSE TRUE END)"
_MUST_ALL = "(CASE source_key WHEN 'site2' THEN contains(lower(link), 'story') OR contains(lower(link), 'file') WHEN 'site3' THEN contains(lower(link), 'news') ELSE TRUE END)"
_COLS = ["page_id", "source_key", "pos", "link"]
_PICK = "page_id, source_key, CAST(pos AS INT) AS pos, link"


@query("filter_link_prefix", f"WITH {RULED} SELECT {_PICK} FROM norm WHERE {_PREFIX}")
def _(t):
    return lk.filter_link_prefix(_ruled(t)).select(_COLS)


@query("filter_link_contains", f"WITH {RULED} SELECT {_PICK} FROM l WHERE {_CONTAINS}")
def _(t):
    return lk.filter_link_contains(_ruled(t)).select(_COLS)


@query("filter_link_regex", f"WITH {RULED} SELECT {_PICK} FROM l WHERE {_REGEX}")
def _(t):
    return lk.filter_link_regex(_ruled(t)).select(_COLS)


@query("filter_link_pdf", f"WITH {RULED} SELECT {_PICK} FROM l WHERE {_PDF}")
def _(t):
    return lk.filter_link_pdf(_ruled(t)).select(_COLS)


@query("filter_must_contain", f"WITH {RULED} SELECT {_PICK} FROM l WHERE {_MUST_ALL}")
def _(t):
    return lk.filter_must_contain(_ruled(t), F.col("link"), F.col("must_contain")).select(_COLS)


@query("probe_candidates", f"""WITH {RULED} SELECT k AS source_key, coalesce(n, 0) AS matched FROM (VALUES ('site0'), ('site1'), ('site2')) v(k)
    LEFT JOIN (SELECT source_key, count(*) AS n FROM norm WHERE {_PREFIX} AND {_CONTAINS} AND {_REGEX} AND {_MUST} AND {_PDF} GROUP BY 1) c ON c.source_key = k
    ORDER BY matched DESC, source_key LIMIT 2""")
def _(t):
    return lk.probe_candidates(lk.extract_links(t.pages), rules(t), 2)


# One source after the other, each without what the earlier ones took.
_TURNS = ", ".join(
    f"t{k} AS (SELECT * EXCLUDE (j) FROM (SELECT *, row_number() OVER (ORDER BY pos) AS j FROM b WHERE so = {k}"
    + "".join(f" AND link NOT IN (SELECT link FROM t{n})" for n in range(1, k))
    + ") WHERE CASE source_key WHEN 'site0' THEN j <= 3 WHEN 'site1' THEN j <= 40 ELSE TRUE END)" for k in range(1, 5))
BUDGET = f"""kept AS (SELECT source_key, page_id * 1000 + pos AS pos, link FROM norm WHERE {_PREFIX} AND {_CONTAINS} AND {_REGEX} AND {_MUST} AND {_PDF}),
    capped AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY pos) AS i, ['site1','site0','site2','site3'] AS o FROM kept),
    a AS (SELECT *, list_position(o, source_key) AS so FROM capped WHERE CASE source_key WHEN 'site0' THEN i <= 8 WHEN 'site3' THEN i <= 5 ELSE TRUE END),
    b AS (SELECT source_key, so, link, min(pos) AS pos FROM a GROUP BY ALL),
    {_TURNS},
    e AS (SELECT *, row_number() OVER (ORDER BY so, pos) AS slot FROM ({" UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, 5))}))"""


def ruled_items(t):
    rows = lk.apply_link_rules(lk.extract_links(t.pages), rules(t))
    return rows.select("source_key", (F.col("page_id") * 1000 + F.col("pos")).alias("pos"), "link")


def budgeted(t):
    return lk.source_budget(ruled_items(t), rules(t).select("source_key", "source_order", "max_items", "max_inserts"), 60)


@query("source_budget", f"WITH {RULED}, {BUDGET} SELECT source_key, pos, link, slot FROM e WHERE slot <= 60")
def _(t):
    return budgeted(t)


@query("procurement_discover", f"""WITH {RULED}, {BUDGET} SELECT sha1({q.canon_feed('link')}) AS external_id, link AS url, source_key, 'article' AS source_type, '' AS title, 'mixed' AS language,
    TIMESTAMP '2024-01-31' AS published_at FROM e WHERE slot <= 60""")
def _(t):
    from pressmill.operators.topics import discovered_items

    return discovered_items(budgeted(t), "2024-01-31 00:00:00")


# ---- URL rules per source ---------------------------------------------------------------------

def source_rules(t):
    none: list[str] = []
    rows = [
        ("site0", ["/en/"], True, ["/fr/"], none, none, ["/en/"]),
        ("site1", none, False, none, ["/en/", "/es/"], [".html"], none),
        ("site2", ["/en/"], False, ["/en/1"], none, none, ["example"]),
        ("site3", none, False, none, none, none, none),
    ]
    return rule_table(
        t.spark, rows, "source_key string, include_prefixes array<string>, include_non_en boolean, exclude_prefixes array<string>,"
        "link_allow array<string>, link_deny array<string>, include array<string>")


@query("filter_by_source_rules", f"""WITH c AS (SELECT pos, source_key, url, {q.piece('url', 3)} AS p FROM fx_candidates)
    SELECT pos, source_key, url FROM c WHERE CASE source_key WHEN 'site0' THEN (starts_with(p, '/en/') OR NOT starts_with(p, '/en/')) AND NOT starts_with(p, '/fr/')
      WHEN 'site1' THEN (contains(p, '/en/') OR contains(p, '/es/')) AND NOT contains(p, '.html')
      WHEN 'site2' THEN starts_with(p, '/en/') AND NOT starts_with(p, '/en/1') ELSE TRUE END""")
def _(t):
    return lk.filter_by_source_rules(t.candidates.select("pos", "source_key", "url"), source_rules(t))


@query("filter_sitemap_candidates", f"""WITH c AS (SELECT source_key, url, min(pos) AS pos FROM fx_candidates
      WHERE CASE source_key WHEN 'site0' THEN contains(url, '/en/') AND NOT starts_with({q.piece('url', 3)}, '/fr/') WHEN 'site2' THEN contains(url, 'example') AND NOT starts_with({q.piece('url', 3)}, '/en/1') ELSE TRUE END GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY pos) AS rn FROM c)
    SELECT source_key, url, pos, rn, (SELECT count(*) FROM fx_candidates f WHERE f.source_key = r.source_key) AS raw_total FROM r WHERE rn <= 50""")
def _(t):
    return lk.filter_sitemap_candidates(t.candidates.select("source_key", "pos", "url"), source_rules(t), 50)


_FOLDER = f"rtrim(coalesce(nullif({q.piece('u', 3)}, ''), '/'), '/') || '/'"


@query("url_reject_report", f"""WITH x AS (SELECT CASE WHEN page_id % 6 = 0 THEN regexp_replace(url, '^([a-z]+://[^/]+).*$', '\\1/a-long-statement-') || page_id ELSE url END AS u FROM fx_pages), f AS (SELECT u, {_FOLDER} AS fo, lower(coalesce(nullif({q.piece('u', 3)}, ''), '/')) AS p FROM x)
    SELECT CASE WHEN NOT regexp_matches(fo, '^/(fr|de)/') AND (starts_with(fo, '/%') OR (len(string_split(fo, '/')) = 3 AND length(fo) >= 20 AND NOT starts_with(fo, '/en/'))) THEN 'accepted'
      WHEN NOT ends_with({q.piece('u', 2)}, 'example.org') THEN 'other_host' WHEN {q.piece('u', 4)} <> '' THEN 'query' WHEN regexp_matches(p, '^/(tag|category|author|page|feed)/') THEN 'taxonomy' WHEN regexp_matches(p, '{q.MEDIA}') THEN 'extension'
      WHEN regexp_matches(p, '^/(fr|de)/') THEN 'static_section' ELSE 'other' END AS reason, count(*) AS n FROM f GROUP BY 1""")
def _(t):
    slug = F.concat(F.regexp_replace("url", r"^([a-z]+://[^/]+).*$", "$1/a-long-statement-"), F.col("page_id").cast("string"))
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 6 == 0, slug).otherwise(F.col("url")).alias("url"))
    return lk.url_reject_report(rows, "example.org", ["/fr/", "/de/"])


@query("job_discover", f"""WITH all_links AS (SELECT page_id, source_key, url AS base, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (SELECT page_id, source_key, url, {q.hrefs('html')} AS h FROM fx_pages)),
    k AS (SELECT page_id, source_key, base, pos, {q.canon_page(_ABS)} AS k FROM all_links WHERE NOT starts_with(href, 'mailto:')),
    f AS (SELECT page_id, source_key, k, min(pos) AS pos FROM k WHERE {q.piece('k', 2)} = {q.piece('base', 2)} AND {q.piece('k', 3)} NOT IN ('', '/') AND NOT regexp_matches({q.piece('k', 3)}, '{q.MEDIA}') AND NOT regexp_matches({q.piece('k', 3)}, '(?i)^/(user|search)')
        AND (regexp_matches({q.piece('k', 3)}, '{q.HINT}') OR len(string_split(trim({q.piece('k', 3)}, '/'), '/')) >= 2) GROUP BY 1, 2, 3),
    r AS (SELECT * FROM f WHERE CASE source_key WHEN 'site0' THEN NOT starts_with({q.piece('k', 3)}, '/fr/') WHEN 'site1' THEN contains({q.piece('k', 3)}, '/en/') OR contains({q.piece('k', 3)}, '/es/') WHEN 'site2' THEN starts_with({q.piece('k', 3)}, '/en/') AND NOT starts_with({q.piece('k', 3)}, '/en/1') ELSE TRUE END),
    c AS (SELECT source_key, k AS url, min((page_id, pos)) AS o FROM r GROUP BY 1, 2), st AS (SELECT DISTINCT regexp_extract({q.canon_page('url')}, '^[a-z]+://[^/]+') || '/news/2024/1/1/story-' || page_id AS k FROM fx_pages WHERE contains(url, '.com/')),
    n AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY o) AS slot FROM c WHERE url NOT IN (SELECT k FROM st))
    SELECT source_key, url, slot FROM n WHERE slot <= 20""")
def _(t):
    from pressmill.operators import selection as se

    # Stored so far: the stories of the .com sites.
    site = F.regexp_extract(u.canonical_page(F.col("url")), "^[a-z]+://[^/]+", 0)
    stored = t.pages.where("url LIKE '%.com/%'").select(F.concat(site, F.lit("/news/2024/1/1/story-"), F.col("page_id").cast("string")).alias("url"))
    cands = lk.mark_stored(lk.discover_candidates(t.pages, source_rules(t)), stored)
    return se.select_feed_mode(cands, 20).select("source_key", "url", "slot")


@query("language_from_url", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/ar/') THEN 'ar' ELSE 'unknown' END AS language FROM fx_pages")
def _(t):
    return t.pages.select("page_id", u.language_from_url(F.col("url")).alias("language"))


@query("slug_title", f"""SELECT page_id, coalesce(nullif(trim(replace(regexp_extract(rtrim({q.piece('url', 3)}, '/'), '[^/]*$'), '-', ' ')), ''), url) AS title FROM fx_pages""")
def _(t):
    return t.pages.select("page_id", u.slug_title(F.col("url")).alias("title"))
