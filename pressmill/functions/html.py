"""HTML expressions. Scripts, styles and comments go first, so markup inside them never counts."""

from __future__ import annotations

import html as stdlib_html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pressmill.functions.text import blank, collapse, let, strip

# Entities with a plain replacement; anything else takes the slower standard-library decoder.
_COMMON = {
    "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": "\u00a0", "copy": "©", "middot": "·",
    "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
    "laquo": "«", "raquo": "»",
}
_RARE = r"&(?!(?:amp|" + "|".join(_COMMON) + r");)[#A-Za-z]"


def _rare_decoder():
    """Built inside a function, so that it is shipped to executors by value."""

    def decode(text: pd.Series) -> pd.Series:
        return text.map(stdlib_html.unescape, na_action="ignore")

    return F.pandas_udf(decode, T.StringType())


def unescape(col: Column) -> Column:
    """Decode entities. Only texts with a rare entity travel to Python, the others are sent as NULL."""
    plain = col
    for name, char in _COMMON.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    rare = F.rlike(col, F.lit(_RARE))
    return F.coalesce(_rare_decoder()(F.when(rare, col)), plain)


def visible(html: Column, tags: tuple[str, ...] = ("script", "style", "noscript")) -> Column:
    """Markup without comments and the given elements."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return out


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def text_of(markup: Column) -> Column:
    """Text of markup that is already ``visible``."""
    return collapse(unescape(strip_tags(markup)))


def main_text(html: Column) -> Column:
    return text_of(visible(blank(html)))


def simple_text(html: Column) -> Column:
    """Detail-page variant: comments are tags, noscript stays."""
    return collapse(unescape(strip_tags(
        F.regexp_replace(F.regexp_replace(blank(html), r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    )))


def _inner(markup: Column, tag: str) -> Column:
    found = F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(strip(unescape(strip_tags(found))), F.lit(""))


def title_of(markup: Column) -> Column:
    return F.coalesce(_inner(markup, "title"), _inner(markup, "h1"))


def title(html: Column) -> Column:
    return title_of(visible(html))


def metas_of(markup: Column) -> Column:
    """Meta tags as struct(property, name, content)."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(*[_attr(t, a).alias(a) for a in ("property", "name", "content")]))


def _attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def _meta(metas: Column, attr: str, value: str) -> Column:
    """Content of the first meta tag with the attribute value; NULL without such a tag."""
    return F.get(F.filter(metas, lambda m: m[attr] == value), 0)["content"]


# Where a publication time may stand, in order.
PUBLISHED_KEYS = [
    ("property", "article:published_time"), ("property", "og:published_time"), ("name", "pubdate"),
    ("name", "publishdate"), ("name", "publish_date"), ("name", "date"), ("name", "dc.date"), ("name", "dc.date.issued"),
]


def published_of(markup: Column, metas: Column) -> Column:
    found = [F.nullif(_meta(metas, a, v), F.lit("")) for a, v in PUBLISHED_KEYS]
    time_tag = F.regexp_extract(markup, r"(?is)<time\b[^>]*>", 0)
    return strip(F.coalesce(*found, F.nullif(_attr(time_tag, "datetime"), F.lit(""))))


def published_at(html: Column) -> Column:
    return let(visible(html), lambda v: let(metas_of(v), lambda m: published_of(v, m)))


def article_meta_of(html: Column, metas: Column) -> Column:
    """og:type article, a published time, or an Article / NewsArticle in linked data."""
    raw = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    blocks = F.regexp_extract_all(
        raw, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"), F.lit(1)
    )
    kinds = F.flatten(F.transform(blocks, _ld_types))
    linked = F.exists(kinds, lambda k: F.lower(k).isin("article", "newsarticle"))
    og = F.lower(strip(blank(_meta(metas, "property", "og:type")))) == "article"
    timed = _meta(metas, "property", "article:published_time").isNotNull()
    # Most pages have no linked data at all.
    return og | timed | F.when(F.contains(html, F.lit("ld+json")), F.coalesce(linked, F.lit(False))).otherwise(False)


def has_article_meta(html: Column) -> Column:
    return let(metas_of(visible(html)), lambda m: article_meta_of(html, m))


def _ld_types(block: Column) -> Column:
    """Types of a linked-data object or list of objects; each type may itself be a list."""
    items = F.coalesce(F.from_json(block, "array<string>"), F.array(block))

    def types(item: Column) -> Column:
        raw = F.get_json_object(item, "$['@type']")
        return F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))

    return F.filter(F.flatten(F.transform(items, types)), lambda x: x.isNotNull())


def hrefs(html: Column) -> Column:
    """Trimmed, decoded href values of the anchors in document order."""
    tags = F.regexp_extract_all(visible(html), F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    values = F.transform(
        tags,
        lambda t: F.struct(
            F.regexp_extract(t, r"(?is)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1).alias("raw"),
        ),
    )
    quoted = F.transform(values, lambda v: F.regexp_replace(v["raw"], r"^[\"']|[\"']$", ""))
    decoded = F.transform(quoted, lambda v: F.replace(v, F.lit("&amp;"), F.lit("&")))
    return F.filter(F.transform(decoded, strip), lambda v: v != "")


def anchors_of(markup: Column) -> Column:
    return F.regexp_count(markup, F.lit(r"(?i)<a[\s>]"))


def anchor_count(html: Column) -> Column:
    return anchors_of(visible(html))


def link_density(html: Column, text: Column) -> Column:
    n = F.length(strip(blank(text)))
    return F.when(n == 0, F.lit(1.0)).otherwise(anchor_count(html) / F.greatest(n, F.lit(1)))


def item_block(html: Column) -> Column:
    """Item markup up to the first of the end markers that occurs, tried in order."""
    tail = F.regexp_extract(html, r"(?is)<div class=\"item-page\"[^>]*>(.*)", 1)
    # What follows the item, in order of preference.
    ends = ['<div class="bt-social-share"', '<ul class="pagenav"', '<div class="ja-moduletable']
    out = None
    for end in ends:
        cut = F.substring_index(tail, end, 1)
        out = F.when(F.contains(tail, F.lit(end)), cut) if out is None else out.when(F.contains(tail, F.lit(end)), cut)
    return out.otherwise(tail)
