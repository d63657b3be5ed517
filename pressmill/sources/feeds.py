"""Landed sitemap, RSS, robots, CSV, table and JSON texts to rows. Fetching is not done here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressmill.functions import html as h, urls
from pressmill.functions.text import any_of, blank, collapse, contains_any, strip
from pressmill.operators.fence import fence


def scan_resolved(df: DataFrame, wanted: Sequence[str], first_of: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Select the wanted columns that exist; ``first_of`` names an output and the candidates to take it from."""
    have = [c for c in wanted if c in df.columns]
    picks = [
        F.col(next(c for c in names if c in df.columns)).alias(out)
        for out, names in (first_of or {}).items() if any(c in df.columns for c in names)
    ]
    return df.select(*have, *picks)


# ---- XML -------------------------------------------------------------------------------------

def _xml_text(block: Column, tag: str) -> Column:
    raw = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{tag}>", 1)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        raw = F.replace(raw, F.lit(f"&{name};"), F.lit(char))
    return F.nullif(strip(raw), F.lit(""))


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(blank(xml), F.lit(rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>.*?</(?:\w+:)?{tag}>"), F.lit(0))


def scan_sitemap(docs: DataFrame, only: Sequence[str] = (), max_links: int = 50) -> DataFrame:
    """<loc> entries. An index keeps children that contain one of ``only``; ``total`` counts before the cap."""
    locs = F.filter(F.transform(_blocks(F.col("xml"), "loc"), lambda b: _xml_text(b, "loc")), lambda x: x.isNotNull())
    index = F.contains("xml", F.lit("<sitemapindex"))
    rows = fence(docs, locs=locs, is_index=index)
    kept = F.col("locs")
    if only:
        kept = F.when(F.col("is_index"), F.filter("locs", lambda u: contains_any(u, only))).otherwise(F.col("locs"))
    return rows.select(*[c for c in docs.columns if c != "xml"], "is_index", F.size("locs").alias("total"),
                       F.posexplode(F.slice(kept, 1, max_links)).alias("pos", "url"))


def scan_sitemap_recent(docs: DataFrame, recent: int = 300) -> DataFrame:
    """Newest dated entries of a URL set; without any date the document order. Dates sort as text."""
    entries = F.transform(_blocks(F.col("xml"), "url"), lambda b, i: F.struct(
        _xml_text(b, "loc").alias("url"), _xml_text(b, "lastmod").alias("lastmod"), i.alias("at")))
    rows = fence(docs.where(F.contains("xml", F.lit("<urlset"))), entries=F.filter(entries, lambda e: e["url"].isNotNull()))
    dated = F.filter("entries", lambda e: e["lastmod"].isNotNull())

    def newest_first(a: Column, b: Column) -> Column:
        return F.when(a["lastmod"] > b["lastmod"], -1).when(a["lastmod"] < b["lastmod"], 1).otherwise(a["at"] - b["at"])

    chosen = F.when(F.size(dated) > 0, F.array_sort(dated, newest_first)).otherwise(F.col("entries"))
    return rows.select(*[c for c in docs.columns if c != "xml"], F.size("entries").alias("total"),
                       F.posexplode(F.slice(chosen, 1, recent)).alias("pos", "e")).select("*", "e.url", "e.lastmod").drop("e")


def scan_rss_items(docs: DataFrame) -> DataFrame:
    """Feed items with a link: published else updated, id else guid else link."""
    items = docs.select(*[c for c in docs.columns if c != "xml"], F.posexplode(_blocks(F.col("xml"), "item")).alias("pos", "b"))
    b = F.col("b")
    parsed = fence(items, link=_xml_text(b, "link"), title=_xml_text(b, "title"),
                   published=F.coalesce(_xml_text(b, "pubDate"), _xml_text(b, "published"), _xml_text(b, "updated")),
                   entry_id=F.coalesce(_xml_text(b, "id"), _xml_text(b, "guid")))
    return parsed.where("link IS NOT NULL").withColumn("external_id", F.coalesce("entry_id", "link")).drop("b", "entry_id")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS files item by item with the built-in XML reader."""
    schema = "title STRING, link STRING, pubDate STRING, updated STRING, guid STRING"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def scan_robots_sitemaps(docs: DataFrame) -> DataFrame:
    lines = docs.select(*[c for c in docs.columns if c != "body"], F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("pos", "line"))
    hit = F.startswith(F.lower("line"), F.lit("sitemap:"))
    return lines.where(hit).withColumn("url", strip(F.regexp_replace("line", r"^[^:]*:", ""))).drop("line")


# ---- fragments and tables --------------------------------------------------------------------

def scan_listing_fragments(docs: DataFrame, allow_prefixes: Sequence[str] = ()) -> DataFrame:
    """JSON array of page commands: the text chunks are joined, each <article> gives link, title and teaser.
    A link that occurs again keeps its place and takes the later texts."""
    chunks = F.transform(F.from_json("body", "array<struct<data:string>>"), lambda x: x["data"])
    page = F.array_join(F.filter(chunks, lambda x: x.isNotNull()), "\n")
    based = fence(docs, b=urls.base_parts(F.col("url")), page=page)
    arts = based.select("page_id", "b", F.posexplode(F.regexp_extract_all(F.col("page"), F.lit(r"(?is)<article\b.*?</article\s*>"), F.lit(0))).alias("pos", "a"))
    a = F.col("a")
    href = strip(F.replace(F.regexp_extract(a, r"(?is)<a\s[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("&amp;"), F.lit("&")))
    text = lambda pattern: collapse(h.unescape(h.strip_tags(F.regexp_extract(a, pattern, 1))))
    rows = fence(
        arts, href=href, title=text(r"(?is)<a\s[^>]*\bhref[^>]*>(.*?)</a\s*>"),
        summary=text(r"(?is)class=[\"'][^\"']*uw-listing-result__description[^\"']*[\"'][^>]*>(.*?)</(?:div|p|span)"),
    ).where("href <> ''")
    linked = fence(rows, link=urls.resolve_in(F.col("b"), F.col("href")))
    if allow_prefixes:
        linked = linked.where(any_of(F.startswith(urls.path(F.col("link")), F.lit(p)) for p in allow_prefixes))
    return linked.groupBy("page_id", "link").agg(
        F.min("pos").alias("pos"), F.max_by("title", "pos").alias("title"), F.max_by("summary", "pos").alias("summary"))


# Currency names of the official table.
CURRENCY_NAMES = {"american dollar": "USD", "euro": "EUR", "pound": "GBP", "egyptian pound": "EGP", "tunisian dinar": "TND"}


def scan_html_table(pages: DataFrame, table_id: str = "currency-table") -> DataFrame:
    """Rate rows: date, currency name, unit, average. Names outside the known list are left out."""
    table = F.regexp_extract("html", rf"(?is)<table\b[^>]*\bid=[\"']{table_id}[\"'][^>]*>(.*?)</table\s*>", 1)
    rows = pages.select("page_id", F.explode(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b.*?</tr\s*>"), F.lit(0))).alias("tr"))
    cells = F.transform(
        F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1)), lambda c: collapse(h.strip_tags(c)))
    parsed = fence(rows, cells=cells).where(F.size("cells") >= 6)
    cell = lambda i: F.get(F.col("cells"), i)
    name = F.regexp_replace(F.lower(cell(1)), r"^currency:\s*", "")
    codes = F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv])
    number = F.regexp_extract(F.replace(cell(3), F.lit(","), F.lit("")), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    day = F.try_to_date(F.regexp_replace(cell(0), r"(?i)^date:\s*", ""), "yyyy-MM-dd")
    return parsed.select(
        "page_id", F.try_element_at(codes, name).alias("instrument"), F.lit("official").alias("rate_type"), F.lit("LYD").alias("quote_currency"),
        number.alias("value"), day.cast("timestamp_ntz").alias("as_of"),
    ).where("instrument IS NOT NULL AND value IS NOT NULL")


# ---- series ----------------------------------------------------------------------------------

def scan_series_csv(lines: DataFrame, series: str = "series") -> DataFrame:
    """Latest value of each ``date,value`` series; "." and blanks are missing."""
    parsed = fence(lines, r=F.from_csv("line", F.lit("date STRING, value STRING"), {"nullValue": ".", "mode": "PERMISSIVE"}))
    value = F.trim("r.value").try_cast("double")
    rows = parsed.select(series, F.try_to_date(F.trim("r.date"), "yyyy-MM-dd").alias("d"), value.alias("v")).where("d IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy(series).agg(F.max(F.struct("d", "v")).alias("m")).select(
        series, F.col("m.d").cast("timestamp_ntz").alias("as_of"), F.col("m.v").alias("value"))


def scan_ohlc_csv(docs: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Close of the last line of each landed daily file; the column is found by its header name, else the fifth."""
    lines = F.filter(F.transform(F.split("body", r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    rows = fence(docs, lines=lines).where(F.size("lines") >= 2)
    at = F.array_position(F.split(F.get(F.col("lines"), 0), ","), "Close")
    last = F.split(F.element_at("lines", -1), ",")
    return rows.select(
        symbol, F.try_to_date(F.get(last, 0), "yyyy-MM-dd").cast("timestamp_ntz").alias("as_of"),
        F.get(last, F.when(at > 0, at - 1).otherwise(4).cast("int")).try_cast("double").alias("value"),
    ).where("value IS NOT NULL")


def scan_manual_rates(docs: DataFrame, as_of, currencies: Sequence[str] = ("USD", "EUR", "GBP", "EGP", "TND")) -> DataFrame:
    """One JSON object of hand-kept rates per document; placeholders (not a number, zero, negative) are left out."""
    from pressmill.functions.times import day_start

    schema = "as_of STRING, source_url STRING, " + ", ".join(f"{c} STRING" for c in currencies)
    rows = fence(docs, r=F.from_json("body", schema))
    pairs = F.array(*[F.struct(F.lit(c).alias("instrument"), F.col(f"r.{c}").try_cast("double").alias("value")) for c in currencies])
    day = F.coalesce(F.try_to_timestamp(F.trim("r.as_of")).cast("timestamp_ntz"), day_start(as_of))
    out = rows.select(*[c for c in docs.columns if c != "body"], day.alias("as_of"),
                      F.coalesce(F.nullif(F.trim("r.source_url"), F.lit("")), F.lit("manual")).alias("source_url"), F.explode(pairs).alias("q"))
    return out.select("*", "q.instrument", "q.value").drop("q").where("value > 0").withColumns({
        "rate_type": F.lit("parallel"), "quote_currency": F.lit("LYD"), "unit": F.concat(F.lit("LYD per 1 "), "instrument")})


# ---- inbox -----------------------------------------------------------------------------------

INBOX = ("source_id STRING, post_url STRING, captured_text STRING, captured_at STRING, published_at STRING, title STRING,"
         "external_id STRING, _corrupt_record STRING")


def parse_inbox(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSONL text lines to records and a quarantine of the lines that are not JSON objects. Blank lines are skipped."""
    filled = lines.where(strip(F.col(line)) != "")
    parsed = fence(filled, r=F.from_json(line, INBOX, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.where(~bad).select("r.*").drop("_corrupt_record")
    return good, parsed.where(bad).select(F.col(line).alias("line"))


def social_items(inbox: DataFrame, sources: DataFrame) -> DataFrame:
    """Posts of known, enabled accounts as feed items."""
    from pressmill.functions import summaries as sm
    from pressmill.functions.text import script_language

    text = strip(blank(F.col("captured_text")))
    rows = fence(inbox.where("coalesce(source_id, '') <> '' AND coalesce(post_url, '') <> ''"), body=text)
    dim = sources.where("enabled").select(F.col("id").alias("source_id"), "page_url", "page_handle", "region_coverage")
    optional = lambda c: F.col(c) if c in inbox.columns else F.lit(None).cast("string")
    body = F.nullif(F.col("body"), F.lit(""))
    return rows.join(dim, "source_id").select(
        "source_id", F.lit("social").alias("source_type"), F.coalesce(F.nullif(optional("external_id"), F.lit("")), "post_url").alias("external_id"),
        F.col("post_url").alias("url"), F.coalesce(F.nullif(optional("title"), F.lit("")), sm.short_title(F.col("body"))).alias("title"),
        body.alias("summary"), body.alias("content"), F.when(body.isNotNull(), script_language(F.col("body"))).alias("language"),
        F.coalesce("captured_at", optional("published_at")).alias("published_at"),
        F.coalesce(F.get("region_coverage", 0), F.lit("national")).alias("region"), "page_url", "page_handle",
    )
