"""Landed-input queries. The landed texts are built from the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.operators import writes as w
from pressmill.plans import sqlbits as q
from pressmill.plans.registry import query
from pressmill.sources import config as cf, feeds as fd
from pressmill.sources.bind import AS_OF


@query("scan_resolved", "SELECT id, title, coalesce(published_at, created_at) AS ts, source_id AS source_ref FROM fx_articles")
def _(t):
    picked = fd.scan_resolved(t.articles, ["id", "title", "published_at", "created_at", "no_such_column"], {"source_ref": ["source_key", "source_id", "source"]})
    return picked.select("id", "title", F.coalesce("published_at", "created_at").alias("ts"), "source_ref")


def _sitemaps(t, dated: bool = False, index: bool = False):
    """One sitemap file per hundred pages."""
    entry = "concat('<url><loc> ', replace(url, '&', '&amp;'), ' </loc>'"
    entry += ", CASE WHEN page_id % 3 > 0 THEN concat('<lastmod>2024-01-', lpad(page_id % 28 + 1, 2, '0'), '</lastmod>') ELSE '' END" if dated else ""
    entry += ", '</url>')"
    rows = t.raw("pages").selectExpr("page_id div 100 AS doc_id", "page_id", f"{entry} AS e")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "e"))), lambda x: x["e"]), "")
    root = "sitemapindex" if index else "urlset"
    return rows.groupBy("doc_id").agg(body.alias("b")).select(
        "doc_id", F.concat(F.lit(f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "b", F.lit(f"</{root}>")).alias("xml"))


@query("scan_sitemap", """WITH p AS (SELECT page_id // 100 AS doc_id, url, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS pos, count(*) OVER (PARTITION BY page_id // 100) AS total FROM pages)
    SELECT doc_id, false AS is_index, CAST(total AS INT) AS total, CAST(pos AS INT) AS pos, url FROM p WHERE pos < 50
    UNION ALL SELECT doc_id, true, CAST(total AS INT), CAST(r - 1 AS INT), url FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM p WHERE contains(url, '/en/')) WHERE r <= 50""")
def _(t):
    sets = fd.scan_sitemap(_sitemaps(t), only=["/en/"], max_links=50)
    return sets.unionByName(fd.scan_sitemap(_sitemaps(t, index=True), only=["/en/"], max_links=50))


@query("scan_sitemap_recent", """WITH p AS (SELECT page_id // 100 AS doc_id, page_id, url, CASE WHEN page_id % 3 > 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS lastmod, count(*) OVER (PARTITION BY page_id // 100) AS total FROM pages)
    SELECT doc_id, CAST(total AS INT) AS total, CAST(r - 1 AS INT) AS pos, url, lastmod FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lastmod DESC, page_id) AS r FROM p WHERE lastmod IS NOT NULL) WHERE r <= 40""")
def _(t):
    return fd.scan_sitemap_recent(_sitemaps(t, dated=True), recent=40)


def _rss(t):
    item = ("concat('<item><title>', CASE WHEN id % 2 = 0 THEN concat('<![CDATA[', replace(title, ']]>', ''), ']]>') ELSE replace(replace(title, '&', '&amp;'), '<', '&lt;') END, '</title>',"
            " CASE WHEN is_deleted THEN '' ELSE concat('<link>', replace(url, '&', '&amp;'), '</link>') END,"
            " CASE WHEN published_at IS NULL THEN '<updated>later</updated>' ELSE concat('<pubDate>', CAST(published_at AS STRING), '</pubDate>') END,"
            " CASE WHEN id % 3 = 0 THEN concat('<guid isPermaLink=\"false\">g', id, '</guid>') ELSE '' END, '</item>')")
    rows = t.articles.selectExpr("id div 50 AS doc_id", "id", f"{item} AS e")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "e"))), lambda x: x["e"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<rss><channel>"), body, F.lit("</channel></rss>")).alias("xml"))


@query("scan_rss_items", f"""SELECT doc_id, link, title, published, external_id FROM (SELECT id // 50 AS doc_id, url AS link, {q.strip('title')} AS title,
      coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), 'later') AS published, CASE WHEN id % 3 = 0 THEN 'g' || id ELSE url END AS external_id FROM fx_articles WHERE NOT is_deleted)""")
def _(t):
    return fd.scan_rss_items(_rss(t)).select("doc_id", "link", "title", "published", "external_id")


@query("scan_robots_sitemaps", """SELECT page_id, 'http://x.org/' || page_id || '.xml' AS url FROM pages UNION ALL SELECT page_id, url || '/s.xml' FROM pages""")
def _(t):
    body = F.concat(F.lit("User-agent: *\nDisallow: /x\nSITEMAP: http://x.org/"), "page_id", F.lit(".xml \r\n# Sitemap: no\nSitemap:"), "url", F.lit("/s.xml"))
    return fd.scan_robots_sitemaps(t.raw("pages").select("page_id", body.alias("body"))).select("page_id", "url")


@query("scan_listing_fragments", """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || '/en/' || page_id AS link, 0 AS pos, 'Later title' AS title, 'Short & new' AS summary FROM pages""")
def _(t):
    frag = F.concat(
        F.lit('<article><h2><a class="t" href="/en/'), "page_id", F.lit('">First</a></h2></article><article><a href="/xx/no">No</a></article>'))
    again = F.concat(F.lit('<article><a href="/en/'), "page_id", F.lit('"> Later <b>title</b></a><div class="uw-listing-result__description">Short &amp; new</div></article>'))
    cmds = F.to_json(F.array(
        F.struct(F.lit("insert").alias("command"), frag.alias("data")), F.struct(F.lit("settings").alias("command"), F.lit(None).cast("string").alias("data")),
        F.struct(F.lit("insert").alias("command"), again.alias("data"))))
    return fd.scan_listing_fragments(t.raw("pages").select("page_id", "url", cmds.alias("body")), allow_prefixes=["/en/"])


@query("scan_html_table", """WITH o AS (SELECT o_orderkey AS page_id, ['USD','EUR','GBP','EGP','TND',NULL][(o_orderkey % 6 + 1)::INT] AS instrument, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS value, date_trunc('day', o_orderdate) AS as_of FROM orders)
    SELECT page_id, instrument, 'official' AS rate_type, 'LYD' AS quote_currency, value, as_of::TIMESTAMP AS as_of FROM o WHERE instrument IS NOT NULL""")
def _(t):
    name = "element_at(array('American Dollar','EURO','Pound','Egyptian  Pound','Tunisian Dinar','Yen'), CAST(o_orderkey % 6 + 1 AS INT))"
    html = (f"concat('<table id=\"other\"><tr><td>x</td></tr></table><table class=\"c\" id=\"currency-table\"><tr><th>Date</th></tr><tr><td>Date: ', date_format(o_orderdate, 'yyyy-MM-dd'),"
            f" '</td><td> Currency: <b>', {name}, '</b></td><td>1</td><td>', format_number(o_totalprice, 2), ' LYD</td><td></td><td></td></tr><tr><td>short</td></tr></table>') AS html")
    return fd.scan_html_table(t.raw("orders").selectExpr("o_orderkey AS page_id", html))


@query("scan_series_csv", """WITH v AS (SELECT 'S' || l_suppkey AS series, date_trunc('day', l_shipdate)::TIMESTAMP AS d, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS v FROM lineitem WHERE l_linenumber NOT IN (3, 5))
    SELECT series, max(d) AS as_of, (SELECT max(v) FROM v b WHERE b.series = v.series AND b.d = (SELECT max(d) FROM v c WHERE c.series = v.series)) AS value FROM v GROUP BY series""")
def _(t):
    line = "concat(date_format(l_shipdate, 'yyyy-MM-dd'), ',', CASE l_linenumber WHEN 3 THEN '.' WHEN 5 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END) AS line"
    return fd.scan_series_csv(t.raw("lineitem").selectExpr("concat('S', l_suppkey) AS series", line))


@query("scan_ohlc_csv", """SELECT o_custkey AS symbol, date_trunc('day', max(o_orderdate))::TIMESTAMP AS as_of, CAST(arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1""")
def _(t):
    price = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
    rows = t.raw("orders").selectExpr(
        "o_custkey AS symbol", "o_orderdate", "o_orderkey",
        f"CASE WHEN o_custkey % 2 = 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), ',1,2,3,', {price}, ',9') ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), ',', {price}, ',7,8,9,9') END AS line")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "line"))), lambda x: x["line"]), "\r\n")
    head = F.when(F.col("symbol") % 2 == 0, "Date,Open,High,Low,Price,Volume\r\n").otherwise("Date,Close,Open,High,Low,Volume\r\n")
    return fd.scan_ohlc_csv(rows.groupBy("symbol").agg(body.alias("b")).select("symbol", F.concat(head, "b").alias("body")))


@query("scan_manual_rates", """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS p, o_orderdate FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-31' ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS as_of, 'manual' AS source_url, 'USD' AS instrument, p AS value, 'parallel' AS rate_type, 'LYD' AS quote_currency, 'LYD per 1 USD' AS unit FROM o
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-31' ELSE date_trunc('day', o_orderdate)::TIMESTAMP END, 'manual', 'TND', 1.5, 'parallel', 'LYD', 'LYD per 1 TND' FROM o WHERE o_orderkey % 3 = 0""")
def _(t):
    body = ("concat('{\"as_of\": \"', CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END, '\", \"USD\": ', CAST(o_totalprice AS DECIMAL(18,2)),"
            " ', \"EUR\": 0, \"GBP\": \"n/a\", \"EGP\": -2', CASE WHEN o_orderkey % 3 = 0 THEN ', \"TND\": \"1.5\"' ELSE '' END, '}') AS body")
    return fd.scan_manual_rates(t.raw("orders").selectExpr("o_orderkey", body), AS_OF)


# ---- configuration ---------------------------------------------------------------------------

def _page_config(t):
    return t.raw("supplier").selectExpr(
        "concat('s', s_suppkey) AS id", "s_name AS name", "CASE WHEN s_suppkey % 5 = 0 THEN 'news' WHEN s_suppkey % 7 = 0 THEN 'facebook' END AS type",
        "concat('https://s', s_suppkey, '.example.org', CASE WHEN s_suppkey % 10 = 0 THEN '/f.xml' ELSE '' END) AS url",
        "CASE WHEN s_suppkey % 4 = 0 THEN concat('https://s', s_suppkey, '.example.org/rss') END AS rss", "s_suppkey % 3 <> 0 AS enabled",
        "CASE WHEN s_suppkey % 6 = 0 THEN true WHEN s_suppkey % 11 = 0 THEN false END AS is_active", "CASE WHEN s_suppkey % 4 = 1 THEN 'RSS' END AS ingest_method")


def _social_config(t):
    return t.raw("supplier").where("s_acctbal > 5000").selectExpr(
        "concat('s', s_suppkey) AS id", "concat('Page ', s_suppkey) AS name", "'facebook' AS type", "concat('https://social.example.org/', s_suppkey) AS page_url",
        "CAST(NULL AS STRING) AS rss", "s_suppkey % 2 = 0 AS enabled")


@query("scan_source_config", """SELECT 's' || s_suppkey AS source_key, CASE WHEN s_acctbal > 5000 THEN s_suppkey % 2 = 0 ELSE s_suppkey % 3 <> 0 END AS enabled,
    CASE WHEN s_acctbal > 5000 THEN 'social' WHEN s_suppkey % 4 = 1 THEN 'rss' ELSE 'page' END AS source_type FROM supplier""")
def _(t):
    return cf.source_config(_page_config(t), _social_config(t))


@query("config_union", """SELECT 's' || s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 'Page ' || s_suppkey ELSE s_name END AS name FROM supplier""")
def _(t):
    rows = _page_config(t).select("id", "name", F.lit(0).alias("rank")).unionByName(_social_config(t).select("id", "name", F.lit(1).alias("rank")))
    return cf.config_union(rows, "id", "rank").select("id", "name")


@query("active_sources", """SELECT 's' || s_suppkey AS id FROM supplier WHERE coalesce(CASE WHEN s_suppkey % 6 = 0 THEN true WHEN s_suppkey % 11 = 0 THEN false END, s_suppkey % 3 <> 0)""")
def _(t):
    return cf.active_sources(_page_config(t)).select("id")


@query("seed_sources", """WITH p AS (SELECT 's' || s_suppkey AS key, s_name AS name, 0 AS r, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 10 = 0 THEN 'rss' ELSE 'web' END
        WHEN s_suppkey % 4 IN (0, 1) THEN 'rss' ELSE 'web' END AS source_type,
        CASE WHEN s_suppkey % 4 = 0 THEN 'https://s' || s_suppkey || '.example.org/rss' ELSE 'https://s' || s_suppkey || '.example.org' || CASE WHEN s_suppkey % 10 = 0 THEN '/f.xml' ELSE '' END END AS url,
        s_suppkey % 3 <> 0 AS is_active FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 <> 0),
      s AS (SELECT 's' || s_suppkey AS key, 'Page ' || s_suppkey AS name, 1 AS r, 'social_inbox' AS source_type, 'https://social.example.org/' || s_suppkey AS url, s_suppkey % 2 = 0 AS is_active FROM supplier WHERE s_acctbal > 5000)
    , o AS (SELECT 's' || s_suppkey + 20 AS key, 'Old ' || s_suppkey AS name, 'old' AS source_type, 'https://old.example.org' AS url, false AS is_active FROM supplier)
    SELECT key, coalesce(p.name, s.name, o.name) AS name, coalesce(p.source_type, s.source_type, o.source_type) AS source_type, coalesce(p.url, s.url, o.url) AS url, coalesce(p.is_active, s.is_active, o.is_active) AS is_active
    FROM p FULL JOIN s USING (key) FULL JOIN o USING (key)""")
def _(t):
    social = cf.seed_rows(_page_config(t).limit(0), _social_config(t)).withColumn("rank", F.lit(0))
    page = cf.seed_rows(_page_config(t), _social_config(t).limit(0)).withColumn("rank", F.lit(1))
    stored = t.raw("supplier").selectExpr("concat('s', s_suppkey + 20) AS key", "concat('Old ', s_suppkey) AS name", "'old' AS source_type", "'https://old.example.org' AS url", "false AS is_active")
    return w.upsert(stored, social.unionByName(page), ["key"], "rank")


@query("expand_seeds", """SELECT 's' || s_suppkey AS source_key, p AS page, 'https://s' || s_suppkey || '.example.org/' || sec || '?page=' || p AS url FROM supplier, range(3) r(p), (VALUES ('news'), ('inbrief')) v(sec)""")
def _(t):
    conf = t.raw("supplier").selectExpr(
        "concat('s', s_suppkey) AS source_key", "array(concat('https://s', s_suppkey, '.example.org/news?page=%d'), concat('https://s', s_suppkey, '.example.org/inbrief?page=%d')) AS templates",
        "0 AS first_page", "2 AS last_page")
    return cf.expand_seeds(conf)


@query("seed_mode", """WITH s AS (SELECT source_key, url, pos, CASE WHEN contains(url, 'page=') THEN 0 WHEN contains(url, '.html') THEN 1 ELSE 2 END AS r FROM (SELECT source_key || '-' || bucket AS source_key, url, pos FROM fx_candidates))
    SELECT source_key, url, pos, ['sitemap','rss','category'][r + 1] AS mode FROM s WHERE r = (SELECT min(r) FROM s b WHERE b.source_key = s.source_key)""")
def _(t):
    rows = t.candidates.select(F.concat_ws("-", "source_key", "bucket").alias("source_key"), "url", "pos")
    paged, dated = F.contains("url", F.lit("page=")), F.contains("url", F.lit(".html"))
    return cf.seed_mode(rows.where(paged), rows.where(~paged & dated), rows.where(~paged & ~dated))


@query("scan_config_documents", """SELECT 's' || s_suppkey AS source_key, sha1('https://s' || s_suppkey || '.example.org/list.pdf') AS external_id, 'https://s' || s_suppkey || '.example.org/list.pdf' AS url,
    'document' AS source_type, CASE WHEN s_nationkey > 10 THEN 'ar' ELSE 'mixed' END AS language, TIMESTAMP '2024-01-31' AS published_at FROM supplier WHERE s_acctbal > 0""")
def _(t):
    conf = t.raw("supplier").selectExpr(
        "concat('s', s_suppkey) AS key", "CASE WHEN s_acctbal > 0 THEN 'pdf_listing' ELSE 'rss' END AS type", "concat('https://s', s_suppkey, '.example.org/list.pdf?sid=4') AS url",
        "array('sid') AS drop_params", "CASE WHEN s_nationkey > 10 THEN 'ar' END AS language")
    return cf.config_documents(conf, AS_OF)


# ---- inbox -----------------------------------------------------------------------------------

def _inbox_lines(t):
    rec = F.to_json(F.struct("source_id", "post_url", "captured_text", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at")))
    good = t.inbox.select(rec.alias("value"))
    return good.unionByName(t.inbox.select(F.lit("   ").alias("value"))).unionByName(t.inbox.where("captured_text = ''").select(F.concat(F.lit("{broken "), "post_url").alias("value")))


@query("scan_inbox", """SELECT source_id, post_url, captured_text, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, false AS broken FROM fx_inbox
    UNION ALL SELECT NULL, '{broken ' || post_url, NULL, NULL, true FROM fx_inbox WHERE captured_text = ''""")
def _(t):
    good, bad = fd.parse_inbox(_inbox_lines(t))
    none = F.lit(None).cast("string")
    return good.select("source_id", "post_url", "captured_text", "captured_at", F.lit(False).alias("broken")).unionByName(
        bad.select(none.alias("source_id"), F.col("line").alias("post_url"), none.alias("captured_text"), none.alias("captured_at"), F.lit(True).alias("broken")))


_BODY = q.strip("captured_text")


@query("social_items", f"""SELECT i.source_id, 'social' AS source_type, post_url AS external_id, post_url AS url, rtrim(left({q.squash('captured_text')}, 80)) AS title, nullif({_BODY}, '') AS content,
      CASE WHEN {_BODY} <> '' THEN CASE WHEN regexp_matches(captured_text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END END AS language, captured_at AS published_at, CASE WHEN CAST(substr(source_id, 4) AS INT) % 2 = 0 THEN 'west' ELSE 'national' END AS region
    FROM fx_inbox i WHERE CAST(substr(source_id, 4) AS INT) < 13 AND CAST(substr(source_id, 4) AS INT) % 3 <> 0""")
def _(t):
    return fd.social_items(t.inbox, t.social_sources).select(
        "source_id", "source_type", "external_id", "url", "title", "content", "language", "published_at", "region")


