"""Link discovery and URL rules.

Work that only looks at one page stays inside that page's row (array functions, no shuffle).
Rule tables are joined by source; Spark broadcasts them when their measured size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressmill.functions import html as h, urls
from pressmill.functions.text import blank, collapse, contains_any, contains_any_of, let, starts_with_any_of
from pressmill.operators.fence import fence
from pressmill.operators.ordered import first_per_key, top_k, with_index
from pressmill.session import settle

# Path words of article pages, used when a source has no allow list.
LINK_KEYWORDS = ["news", "press", "release", "statement", "announcements", "media", "update", "blog", "article", "post"]


# ---- identity and duplicates -----------------------------------------------------------------

def canonical_forms(df: DataFrame, url: str = "url") -> DataFrame:
    c = F.col(url)
    feed = urls.canonical_feed(c)
    return df.withColumns({
        "alert_key": urls.canonical_alert(c), "feed_key": feed, "page_key": urls.canonical_page(c),
        "domain": urls.domain(c), "external_id": F.sha1(feed),
    })


def dedupe_url(items: DataFrame, order: Sequence[str], url: str = "url", extra_drop: Column | None = None) -> DataFrame:
    """First item per canonical URL in run order, with the number of items dropped for it."""
    keyed = items.withColumn("canonical", urls.canonical_feed(F.col(url), extra_drop)).where("canonical IS NOT NULL AND canonical <> ''")
    rest = [c for c in keyed.columns if c != "canonical"]
    best = keyed.groupBy("canonical").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count(F.lit(1)) - 1).alias("dropped")
    )
    return best.select("canonical", "r.*", "dropped")


def stored_keys(articles: DataFrame) -> DataFrame:
    """Crawl keys of both URL columns of the store."""
    cols = [c for c in ("url", "canonical_url") if c in articles.columns]
    return (
        articles.select(F.explode(F.array(*cols)).alias("u")).where("u IS NOT NULL AND u <> ''")
        .select(urls.canonical_page(F.col("u")).alias("page_key")).distinct()
    )


def dedupe_against_store(candidates: DataFrame, articles: DataFrame, url: str = "url") -> DataFrame:
    keyed = candidates.withColumn("page_key", urls.canonical_page(F.col(url)))
    return keyed.join(stored_keys(articles), "page_key", "left_anti")


# ---- links of a page -------------------------------------------------------------------------

def usable_hrefs(html: Column) -> Column:
    bad = lambda x: F.startswith(x, F.lit("mailto:")) | F.startswith(x, F.lit("javascript:"))
    return F.filter(h.hrefs(html), lambda x: ~bad(x))


def _rooted(base: Column, href: Column) -> Column:
    """Listing-page rule: a link without scheme and host becomes a path of the page's host."""
    return F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")), href).otherwise(
        F.concat(base["root"], F.when(F.startswith(href, F.lit("/")), "").otherwise("/"), href)
    )


def extract_links(pages: DataFrame, keep: Sequence[str] = ("page_id", "source_key")) -> DataFrame:
    based = fence(pages.select(*keep, "url", "html"), b=urls.base_parts(F.col("url")))
    rows = based.select(*keep, "b", F.posexplode(usable_hrefs(F.col("html"))).alias("pos", "href"))
    return fence(rows, link=_rooted(F.col("b"), F.col("href"))).drop("b")


def _is_article_path(p: Column) -> Column:
    return (
        ~F.startswith(p, F.lit("/cdn-cgi/")) & ~F.rlike(p, F.lit(urls.MEDIA_EXT)) & ~p.isin("", "/")
        & ~F.startswith(F.lower(p), F.lit("/user")) & ~F.startswith(F.lower(p), F.lit("/search"))
        & (F.rlike(p, F.lit(urls.ARTICLE_HINT)) | (F.size(F.split(F.trim(p, F.lit("/")), "/")) >= 2))
    )


def discover_article_links(pages: DataFrame, max_links: int = 30) -> DataFrame:
    """Article-shaped links per page, in order, with the anchor count."""
    based = fence(pages.select("page_id", "source_key", "url", "html"), b=urls.base_parts(F.col("url")), found=h.hrefs(F.col("html")))
    hrefs = F.filter(F.col("found"), lambda x: ~F.startswith(x, F.lit("javascript:")))
    keyed = fence(based, absolute=F.transform(hrefs, lambda x: urls.canonical_page(urls.resolve_in(F.col("b"), x))))

    def fits(u: Column) -> Column:
        return let(urls.parts(u), lambda p: p["scheme"].isin("http", "https") & ((p["netloc"] == "") | (p["netloc"] == F.col("b.netloc"))) & _is_article_path(p["path"]))

    links = F.slice(F.array_distinct(F.filter(F.col("absolute"), fits)), 1, max_links)
    return keyed.select(
        "page_id", "source_key", "url", F.size("found").alias("a_count"), links.alias("links"),
        F.size(F.array_distinct("absolute")).alias("unique_links"),
    )


def extract_internal_links(pages: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = urls.DENY_PARTS, limit: int = 20) -> DataFrame:
    based = fence(
        pages.select("page_id", "url", "html"), b=urls.base_parts(F.col("url")),
        own=F.rtrim(urls.canonical_page(F.col("url")), F.lit("/")),
    )
    hrefs = F.filter(usable_hrefs(F.col("html")), lambda x: ~F.startswith(x, F.lit("#")))
    absolute = F.transform(hrefs, lambda x: urls.resolve_in(F.col("b"), x))

    def same_host(u: Column) -> Column:
        return F.lower(F.regexp_extract(u, urls.SYNTAX, 1)).isin("http", "https") & (F.regexp_extract(u, urls.SYNTAX, 2) == F.col("b.netloc"))

    def wanted(u: Column) -> Column:
        right = contains_any(F.lower(u), [a.lower() for a in allow]) if allow else contains_any(F.lower(urls.path(u)), LINK_KEYWORDS)
        return (F.rtrim(u, F.lit("/")) != F.col("own")) & ~urls.looks_like_index(u, [d.lower() for d in deny]) & right

    keys = F.transform(F.filter(absolute, same_host), urls.canonical_page)
    return based.select("page_id", "url", F.slice(F.array_distinct(F.filter(keys, wanted)), 1, limit).alias("links"))


def harvest_urls(pages: DataFrame, max_links: int = 50) -> DataFrame:
    """Absolute URLs of the page's own host anywhere in its raw text, media left out."""
    based = fence(pages.select("page_id", "url", "html"), own=urls.host(F.col("url")))
    found = F.regexp_extract_all(blank(F.col("html")), F.lit(r"(?i)https?://[^\s\"'<>]+"), F.lit(0))
    kept = F.filter(found, lambda u: (urls.host(u) == F.col("own")) & ~F.rlike(urls.path(u), F.lit(urls.MEDIA_EXT)))
    return based.select("page_id", "url", F.slice(F.array_distinct(F.transform(kept, urls.canonical_page)), 1, max_links).alias("links"))


def attachments(pages: DataFrame, base: str = "url", html: str = "html") -> DataFrame:
    based = fence(pages, _b=urls.base_parts(F.col(base)))
    found = F.regexp_extract_all(blank(F.col(html)), F.lit(r"(?i)href=\"([^\"]+\.(?:pdf|docx?|jpg|jpeg|png))\""), F.lit(1))
    links = F.array_distinct(F.transform(found, lambda x: urls.resolve_in(F.col("_b"), x)))
    return fence(based, attachments=links).drop("_b").withColumn("attachments_count", F.size("attachments"))


def doc_link_prefixes(pages: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent path prefixes (first three folders) of document links."""
    anchors = F.regexp_extract_all(h.visible(F.col("html")), F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))
    based = fence(pages.select("url", "html"), b=urls.base_parts(F.col("url")))
    rows = based.select("b", F.explode(anchors).alias("a")).select(
        "b", "a", F.regexp_extract("a", r"(?is)\shref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
    ).where(contains_any(F.lower(F.col("href")), [".pdf", ".doc"]))
    prefix = F.array_join(F.slice(F.split(urls.path(_rooted(F.col("b"), F.col("href"))), "/"), 1, 4), "/")
    text = collapse(h.unescape(h.strip_tags(F.col("a"))))
    return (
        rows.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("sample_text"))
        .orderBy(F.desc("n"), "prefix").limit(top)
    )


# ---- rule filters on link rows ----------------------------------------------------------------
# Rule columns are arrays (NULL or empty: no rule). ``link`` is the column tested.

def _given(rule: Column) -> Column:
    return F.coalesce(F.size(rule), F.lit(0)) > 0


def allow_deny(test, allow: Column, deny: Column) -> Column:
    """Deny wins over allow; no allow list allows everything."""
    return ~(_given(deny) & F.coalesce(test(deny), F.lit(False))) & (~_given(allow) | F.coalesce(test(allow), F.lit(False)))


def filter_link_prefix(links: DataFrame, link: str = "link") -> DataFrame:
    keyed = fence(links, **{link: urls.canonical_feed(F.col(link), F.col("drop_params"))}).where(F.col(link) != "")
    return keyed.where(allow_deny(lambda r: starts_with_any_of(F.col(link), r), F.col("allow_prefixes"), F.col("deny_prefixes")))


def filter_link_contains(links: DataFrame, link: str = "link") -> DataFrame:
    low = F.lower(F.col(link))
    return links.where(allow_deny(lambda r: contains_any_of(low, r), F.col("allow_contains"), F.col("deny_contains")))


def filter_link_regex(links: DataFrame, link: str = "link") -> DataFrame:
    return links.where(allow_deny(
        lambda r: F.exists(r, lambda p: F.rlike(F.col(link), p)), F.col("allow_regex"), F.col("deny_regex")))


def filter_link_pdf(links: DataFrame, link: str = "link") -> DataFrame:
    low = F.lower(F.col(link))
    rule = allow_deny(lambda r: contains_any_of(low, r), F.col("pdf_allow"), F.col("pdf_deny"))
    return links.where(F.when(F.contains(low, F.lit(".pdf")), rule).otherwise(True))


def filter_must_contain(rows: DataFrame, text: Column, tokens: Column) -> DataFrame:
    return rows.where(~_given(tokens) | contains_any_of(F.lower(blank(text)), tokens))


def filter_by_source_rules(candidates: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Prefix, token and language-section rules of each source, over the URL path."""
    joined = fence(candidates.join(rules, "source_key", "left"), _path=urls.path(F.col(url)))
    p = F.col("_path")
    included = starts_with_any_of(p, F.col("include_prefixes")) | (
        F.coalesce(F.col("include_non_en"), F.lit(False)) & ~F.startswith(p, F.lit("/en/")))
    keep = (
        (~_given(F.col("include_prefixes")) | included)
        & ~(_given(F.col("exclude_prefixes")) & starts_with_any_of(p, F.col("exclude_prefixes")))
        & (~_given(F.col("link_allow")) | contains_any_of(p, F.col("link_allow")))
        & ~(_given(F.col("link_deny")) & contains_any_of(p, F.col("link_deny")))
    )
    return joined.where(F.coalesce(keep, F.lit(True))).select(*candidates.columns)


def filter_sitemap_candidates(entries: DataFrame, rules: DataFrame, max_links: int) -> DataFrame:
    """Sitemap entries (source_key, pos, url): include substrings, exclude prefixes, first of each URL, cap; raw total kept."""
    joined = entries.join(rules.select("source_key", "include", "exclude_prefixes"), "source_key", "left")
    ok = (~_given(F.col("include")) | contains_any_of(F.col("url"), F.col("include"))) & ~(
        _given(F.col("exclude_prefixes")) & starts_with_any_of(urls.path(F.col("url")), F.col("exclude_prefixes")))
    firsts = joined.where(F.coalesce(ok, F.lit(True))).groupBy("source_key", "url").agg(F.min("pos").alias("pos"))
    kept = top_k(firsts, ["source_key"], [F.col("pos")], max_links, F.col("url"))
    totals = entries.groupBy("source_key").agg(F.count(F.lit(1)).alias("raw_total"))
    return kept.join(totals, "source_key")


def url_reject_report(candidates: DataFrame, host_suffix: str, static_prefixes: Sequence[str], url: str = "url") -> DataFrame:
    """How many sitemap URLs are taken, and why the others are not."""
    reason = F.coalesce(urls.reject_reason(F.col(url), host_suffix, static_prefixes), F.lit("other"))
    verdict = F.when(urls.is_statement_page(F.col(url), static_prefixes), "accepted").otherwise(reason)
    return candidates.groupBy(verdict.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def apply_link_rules(links: DataFrame, rules: DataFrame) -> DataFrame:
    """All procurement link rules in their order."""
    rows = links.join(rules, "source_key")
    rows = filter_link_regex(filter_link_contains(filter_link_prefix(rows)))
    listing = F.when(F.coalesce(F.col("filter_stage"), F.lit("")) != "detail", F.col("must_contain"))
    return filter_link_pdf(filter_must_contain(rows, F.col("link"), listing))


def probe_candidates(links: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """Matched link count per candidate source; a probe tests the words on every candidate."""
    rows = filter_link_regex(filter_link_contains(filter_link_prefix(links.join(rules.where("candidate"), "source_key"))))
    matched = filter_link_pdf(filter_must_contain(rows, F.col("link"), F.col("must_contain")))
    counts = matched.groupBy("source_key").agg(F.count(F.lit(1)).alias("matched"))
    return rules.where("candidate").select("source_key").join(counts, "source_key", "left").select(
        "source_key", F.coalesce("matched", F.lit(0)).alias("matched")
    ).orderBy(F.desc("matched"), "source_key").limit(n)


def source_budget(items: DataFrame, caps: DataFrame, total: int) -> DataFrame:
    """First ``max_items`` links of a source, of these the first ``max_inserts`` that no earlier source took, then the run's
    budget in source order. ``items``: source_key, pos, link; ``caps``: source_key, source_order, max_items, max_inserts (0 = none).

    A link belongs to the first source that has it; what a source has no room for is released to the next one, until nothing
    is over. A released link only moves a later source's other links back, so each round's verdicts hold."""
    items = settle(items)  # read several times below, and usually the product of page parsing
    capped = (
        with_index(items.join(caps, "source_key"), ["source_key"], "pos", "i")
        .where((F.col("max_items") == 0) | (F.col("i") <= F.col("max_items"))).drop("i")
    )
    held = settle(capped)
    while True:
        firsts = first_per_key(held, ["link"], [F.col("source_order"), F.col("pos")])
        ranked = settle(with_index(firsts, ["source_key"], "pos", "i"))
        over = ranked.where((F.col("max_inserts") > 0) & (F.col("i") > F.col("max_inserts"))).select("source_key", "link")
        if not over.limit(1).count():
            break
        held = settle(held.join(over, ["source_key", "link"], "left_anti"))
    fresh = ranked
    before = Window.orderBy("source_order").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fresh.groupBy("source_key", "source_order").agg(F.count(F.lit(1)).alias("n")).select(
        "source_key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return fresh.join(sizes, "source_key").withColumn("slot", F.col("earlier") + F.col("i")).where(F.col("slot") <= total).select(
        "source_key", "pos", "link", "slot")


def discover_candidates(pages: DataFrame, rules: DataFrame, max_links: int = 30) -> DataFrame:
    """Links of all pages that pass their source's rules: one row per source and URL, in order of discovery."""
    found = discover_article_links(pages, max_links).select("source_key", "page_id", F.posexplode("links").alias("at", "url"))
    kept = filter_by_source_rules(found, rules)
    return kept.groupBy("source_key", "url").agg(F.min(F.struct("page_id", "at")).alias("first")).select(
        "source_key", "url", (F.col("first.page_id") * 1000 + F.col("first.at")).alias("pos"))


def mark_stored(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    known = stored_keys(articles).withColumnRenamed("page_key", "url").withColumn("stored", F.lit(True))
    return candidates.join(known, "url", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
