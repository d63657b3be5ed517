"""URL expressions: three canonical forms, domain, identity, resolution, reject rules.

The three canonical forms give different keys for one page. Use one form per key, never a mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pressmill.functions.text import any_of, blank, contains_any, let, strip

# Generic URL syntax: scheme, authority, path, query, fragment.
SYNTAX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Tracking parameters dropped besides utm_*.
DROP_ALERT = ["fbclid", "gclid"]
DROP_FEED = ["fbclid", "gclid", "mc_eid"]
DROP_PAGE = ["fbclid", "gclid", "yclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "amp"]

# Path shapes of articles, media extensions, index pages.
ARTICLE_HINT = r"(?i)(\d{4}/\d{1,2}/\d{1,2}|/news/|/press/|/article/|/post/|/blog/|/story/|/report/|/analysis/|/politic|/econom|/local/)"
MEDIA_EXT = r"(?i)\.(pdf|jpg|jpeg|png|gif|webp|svg|mp4|mp3|zip)$"
DENY_PARTS = [
    "/category/", "/tag/", "/author/", "/page/", "/wp-json", "/wp-admin", "/contact", "/privacy", "/terms",
    "/media-contacts", "/security-council-resolutions",
]
INDEX_ENDINGS = ["/blog", "/news", "/announcements", "/press-releases", "/press"]
INDEX_SECTIONS = ["news", "inbrief", "economy", "politics", "sports", "opinions"]


def parts(url: Column) -> Column:
    """struct(scheme, netloc, path, query); scheme and netloc in lower case, fragment dropped."""
    return F.struct(
        F.lower(F.regexp_extract(url, SYNTAX, 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, SYNTAX, 2)).alias("netloc"),
        F.regexp_extract(url, SYNTAX, 3).alias("path"),
        F.regexp_extract(url, SYNTAX, 4).alias("query"),
    )


def path(url: Column) -> Column:
    return F.regexp_extract(url, SYNTAX, 3)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SYNTAX, 2))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def sections(url_path: Column) -> Column:
    return F.filter(F.split(url_path, "/"), lambda s: s != "")


def _decode(text: Column) -> Column:
    """Form decoding; a stray % stays as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _dropped(key: Column, names: Sequence[str]) -> Column:
    lower = F.lower(key)
    return F.startswith(lower, F.lit("utm_")) | lower.isin(*names)


def _pairs(query: Column, drop: Sequence[str], extra: Column | None = None) -> Column:
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    split = F.transform(
        items,
        lambda x: F.struct(
            _decode(F.substring_index(x, "=", 1)).alias("k"),
            _decode(F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")).alias("v"),
        ),
    )

    def keep(p: Column) -> Column:
        gone = _dropped(p["k"], drop)
        if extra is not None:
            gone = gone | F.coalesce(F.array_contains(extra, F.lower(p["k"])), F.lit(False))
        return ~gone

    return F.filter(split, keep)


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def _rebuild(scheme: Column, netloc: Column, url_path: Column, query: Column) -> Column:
    rooted = F.when((url_path != "") & ~F.startswith(url_path, F.lit("/")), F.concat(F.lit("/"), url_path)).otherwise(url_path)
    bare = F.when((url_path == "") | F.startswith(url_path, F.lit("/")), F.concat(F.lit("//"), url_path)).otherwise(url_path)
    rest = F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted)).otherwise(bare)
    return F.concat(scheme, F.lit(":"), rest, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_alert(url: Column) -> Column:
    """Default port, trailing slashes, tracking and fragment removed; parameters sorted; www. kept."""

    def build(p: Column) -> Column:
        scheme = F.coalesce(F.nullif(p["scheme"], F.lit("")), F.lit("http"))
        netloc = (
            F.when((scheme == "http"), F.regexp_replace(p["netloc"], ":80$", ""))
            .when((scheme == "https"), F.regexp_replace(p["netloc"], ":443$", "")).otherwise(p["netloc"])
        )
        query = F.when(p["query"] == "", "").otherwise(_joined(F.array_sort(_pairs(p["query"], DROP_ALERT))))
        return _rebuild(scheme, netloc, F.rtrim(p["path"], F.lit("/")), query)

    return let(strip(blank(url)), lambda u: F.when(u == "", "").otherwise(let(parts(u), build)))


def canonical_feed(url: Column, extra_drop: Column | None = None) -> Column:
    """Tracking, fragment and path parameters removed; order kept; one final slash of the whole URL cut."""

    def build(p: Column) -> Column:
        scheme = F.coalesce(F.nullif(p["scheme"], F.lit("")), F.lit("https"))
        clean = F.regexp_replace(p["path"], ";[^/]*$", "")
        query = F.when(p["query"] == "", "").otherwise(_joined(_pairs(p["query"], DROP_FEED, extra_drop)))
        whole = _rebuild(scheme, p["netloc"], clean, query)
        return F.when(F.endswith(whole, F.lit("/")) & (clean != "/"), F.regexp_replace(whole, "/$", "")).otherwise(whole)

    return F.when(url.isNull() | (url == ""), url).otherwise(let(strip(url), lambda u: let(parts(u), build)))


def canonical_page(url: Column) -> Column:
    """Crawl form: www., /amp, trailing slashes and fragment removed; the query text itself is kept."""

    def build(p: Column) -> Column:
        scheme = F.coalesce(F.nullif(p["scheme"], F.lit("")), F.lit("https"))
        netloc = F.regexp_replace(p["netloc"], r"^www\.", "")
        raw = F.coalesce(F.nullif(F.regexp_replace(p["path"], ";[^/]*$", ""), F.lit("")), F.lit("/"))
        plain = F.coalesce(F.nullif(F.regexp_replace(raw, "/amp$", ""), F.lit("")), F.lit("/"))
        short = F.when(plain == "/", plain).otherwise(F.rtrim(plain, F.lit("/")))
        kept = F.filter(
            F.split(p["query"], "&"), lambda x: (x != "") & ~_dropped(F.substring_index(x, "=", 1), DROP_PAGE)
        )
        query = F.when(p["query"] == "", "").otherwise(F.array_join(kept, "&"))
        return F.concat(scheme, F.lit("://"), netloc, short, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

    return let(parts(url), build)


def external_id(url: Column) -> Column:
    return F.sha1(canonical_feed(url))


def _without_dots(url_path: Column) -> Column:
    """Remove . and .. segments."""

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    folded = F.aggregate(F.split(url_path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))
    tail = F.when(F.rlike(url_path, F.lit(r"/\.\.?$")) & ~F.endswith(folded, F.lit("/")), "/").otherwise("")
    return F.when(F.contains(url_path, F.lit("/.")), F.concat(folded, tail)).otherwise(url_path)


def base_parts(base: Column) -> Column:
    """What resolving needs of a page address, to be computed once per page."""
    base_path = F.regexp_extract(base, SYNTAX, 3)
    netloc = F.regexp_extract(base, SYNTAX, 2)
    scheme = F.regexp_extract(base, SYNTAX, 1)
    return F.struct(
        scheme.alias("scheme"), netloc.alias("netloc"), F.concat(scheme, F.lit("://"), netloc).alias("root"), base_path.alias("path"),
        F.coalesce(F.nullif(F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1), F.lit("")), F.lit("/")).alias("folder"),
        F.substring_index(base, "#", 1).alias("page"),
    )


def resolve_in(base: Column, href: Column) -> Column:
    """Absolute form of a link, given the page's ``base_parts``."""
    link_path, link_rest = F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 2)
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(base["scheme"], F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(base["root"], _without_dots(link_path), link_rest))
        .when(F.startswith(href, F.lit("?")), F.concat(base["root"], base["path"], href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), F.concat(base["page"], href))
        .otherwise(F.concat(base["root"], _without_dots(F.concat(base["folder"], link_path)), link_rest))
    )


def resolve(base: Column, href: Column) -> Column:
    return let(base_parts(base), lambda b: resolve_in(b, href))


def looks_like_index(url: Column, deny: Sequence[str] = DENY_PARTS) -> Column:
    lower = F.lower(url)
    short = F.rtrim(lower, F.lit("/"))
    return contains_any(lower, deny) | any_of(F.endswith(short, F.lit(e)) for e in INDEX_ENDINGS)


def is_single_section(url: Column) -> Column:
    segs = sections(path(url))
    return (F.size(segs) == 1) & F.coalesce(F.lower(F.get(segs, 0)).isin(*INDEX_SECTIONS), F.lit(False))


def language_from_url(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("/en/")), "en").when(F.contains(url, F.lit("/ar/")), "ar").otherwise("unknown")


def slug_title(url: Column) -> Column:
    slug = F.element_at(F.split(F.rtrim(path(url), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(strip(F.replace(slug, F.lit("-"), F.lit(" "))), F.lit("")), url)


def reject_reason(url: Column, host_suffix: str, static_prefixes: Sequence[str]) -> Column:
    """Why a sitemap URL of one institution is not an article; NULL when no rule speaks against it."""
    lower = F.lower(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")))
    starts = lambda prefixes: any_of(F.startswith(lower, F.lit(p)) for p in prefixes)
    return (
        F.when(~F.endswith(F.regexp_extract(url, SYNTAX, 2), F.lit(host_suffix)), "other_host")
        .when(F.regexp_extract(url, SYNTAX, 4) != "", "query")
        .when(contains_any(lower, ["/wp-content/", "/wp-json/", "/wp-admin/"]), "wp_internal")
        .when(starts(["/tag/", "/category/", "/author/", "/page/", "/feed/"]), "taxonomy")
        .when(F.rlike(lower, F.lit(MEDIA_EXT)), "extension")
        .when(starts(static_prefixes), "static_section")
    )


def is_statement_page(url: Column, static_prefixes: Sequence[str]) -> Column:
    """Article test of that institution's sitemap: an encoded slug, or one long slug outside the English section."""
    folder = F.concat(F.rtrim(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), F.lit("/")), F.lit("/"))
    banned = any_of(F.startswith(folder, F.lit(p)) for p in static_prefixes)
    banned = banned | contains_any(F.lower(folder), ["/wp-content/", "/wp-json/", "/wp-admin/", "/feed/"])
    slug = (F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) == 2) & (F.length(folder) >= 20) & ~F.startswith(folder, F.lit("/en/"))
    return ~banned & ~F.rlike(folder, F.lit(MEDIA_EXT)) & (F.startswith(folder, F.lit("/%")) | slug)
