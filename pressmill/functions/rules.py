"""Keyword rules. All are substring tests on lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressmill.functions.text import blank, contains_any, has_token, let

# Category labels and their keywords, first match wins.
CATEGORIES = {
    "Energy": ["oil", "gas", "energy", "power", "pipeline", "fuel"],
    "Finance": ["bank", "loan", "budget", "bond", "fund", "finance"],
    "Security": ["attack", "clash", "militia", "security", "armed"],
    "Governance": ["parliament", "cabinet", "minister", "election", "law"],
    "Trade": ["import", "export", "trade", "customs", "tariff"],
    "Migration": ["migrant", "migration", "border", "detention"],
}

# Activity flags.
FLAGS = {
    "tenders": ["tender", "procurement", "rfp", "bid", "auction"],
    "regulations": ["regulation", "regulatory", "law", "decree", "gazette", "policy"],
    "high_impact": ["sanction", "shutdown", "explosion", "attack", "strike", "ceasefire", "resignation"],
}

# Tender sectors, first match wins.
SECTORS = {
    "oil": ["rig", "pipeline", "well", "drilling", "compressor", "refinery"],
    "utilities": ["generator", "transformer", "substation", "grid", "switchgear"],
    "ports": ["port", "terminal", "berth", "dredging"],
    "telecom": ["fiber", "tower", "core network", "radio", "telecom"],
}

# Topic tags and their keywords.
TAGS = {
    "tenders": ["tender", "procurement", "bid", "rfp", "rfq", "eoi", "prequalification", "expression of interest"],
    "contracts": ["contract", "awarded", "award", "agreement", "mou", "memorandum", "signed", "deal"],
    "oil_gas": ["noc", "oil", "gas", "pipeline", "refinery", "production", "concession", "crude", "field"],
    "banking": ["central bank", "cbl", "dinar", "fx", "exchange rate", "reserves", "liquidity", "bank", "banking"],
    "regulation": ["decree", "law", "regulation", "circular", "policy", "budget", "licensing", "customs", "tax", "tariff"],
    "security": ["clashes", "blockade", "shutdown", "strike", "protest", "attack", "port closure", "pipeline shutdown"],
    "power": ["power", "electricity", "grid", "generation", "blackout", "load shedding"],
    "telecom": ["telecom", "mobile", "spectrum", "4g", "5g", "fiber", "regulator"],
    "projects": ["project", "investment", "infrastructure", "development", "approved", "planned"],
    "governance": ["appointed", "dismissed", "cabinet", "minister", "governor", "government formation"],
    "elections": ["election", "vote", "transition", "constitution", "referendum"],
    "macro": ["macro", "sovereign", "fiscal", "budget", "debt"],
}

# Signs of a bot wall in page text.
BLOCK_MARKERS = [
    "access denied", "request blocked", "enable javascript", "cloudflare", "captcha", "checking your browser",
    "bot detection", "incident id", "akamai", "incapsula", "perimeterx",
]

# Signs of a challenge page on a listing.
CHALLENGE_MARKERS = ["just a moment", "cf-browser-verification", "challenge-platform", "cloudflare"]

# Page furniture phrases.
BOILERPLATE = [
    "skip to main content", "main navigation", "menu", "search", "follow us", "print edition", "drupal",
    "just another", "category:", "news archive", "sitemap", "contact us", "careers", "login", "subscribe",
    "all rights reserved", "privacy policy", "terms of service", "cookie", "newsletter",
]

# Words that make a notice a tender (Arabic).
TENDER_WORDS = ["مناقصة", "عطاء", "توريد", "تأهيل", "إبداء الاهتمام", "لجنة العطاءات", "كراسة الشروط", "تقديم العروض"]

# Social hosts that are never news items.
SOCIAL_DOMAINS = ["facebook.com", "twitter.com", "x.com", "youtube.com", "t.me", "telegram.me", "instagram.com"]

# Path parts of short-news sections.
BRIEF_PATHS = ["/inbrief/", "/brief/", "/short/", "/newsbrief/", "/bulletin/"]

# Default place names of a topic without its own.
LOCATION_TERMS = ["libya", "libyan", "tripoli", "benghazi", "misrata"]

# Words that hint at a footer or consent text.
CONSENT_WORDS = ["cookie", "privacy", "subscribe", "newsletter"]


def first_label(text: Column, labels: dict[str, list[str]], default: str) -> Column:
    def pick(t: Column) -> Column:
        out = None
        for label, keys in labels.items():
            hit = has_token(t, keys)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(default)

    return let(text, pick)


def headline_text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat_ws(" ", blank(title), blank(summary)))


def category(title: Column, summary: Column) -> Column:
    return first_label(headline_text(title, summary), CATEGORIES, "General")


def keyword_flags(title: Column, summary: Column) -> dict[str, Column]:
    text = headline_text(title, summary)
    return {name: contains_any(text, keys) for name, keys in FLAGS.items()}


def sector(text: Column) -> Column:
    return first_label(F.lower(blank(text)), SECTORS, "unknown")


def tag_hits(text: Column) -> Column:
    """Array of the tags whose keywords occur."""
    def hits(t: Column) -> Column:
        return F.array_compact(F.array(*[F.when(has_token(t, keys), F.lit(tag)) for tag, keys in TAGS.items()]))

    return let(F.lower(blank(text)), hits)


def blocked_text(text: Column) -> Column:
    return contains_any(F.lower(blank(text)), BLOCK_MARKERS)


def challenge_page(html: Column) -> Column:
    return contains_any(F.lower(blank(html)), CHALLENGE_MARKERS)


def quality_rank(kind: Column) -> Column:
    """full 3, teaser 2, title_only 1, anything else 0; NULL counts as full."""
    lower = F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("full")))
    return F.when(lower == "full", 3).when(lower == "teaser", 2).when(lower == "title_only", 1).otherwise(0)


def credibility(source_type: Column) -> Column:
    return F.when(source_type == "official", 9).when(source_type == "institutional", 8).otherwise(5)


def error_class(error: Column) -> Column:
    """Fetch error text to a counter name."""
    code = F.lower(F.element_at(F.split(error, ":", 2), 2))
    blocked = F.when(code.isin("403", "429"), F.concat(F.lit("err_http_"), code)).otherwise("err_blocked")
    request = (
        F.when(code == "dns", "err_dns").when(F.contains(code, F.lit("timeout")), "err_timeout")
        .when(F.contains(code, F.lit("ssl")) | F.contains(code, F.lit("tls")), "err_tls")
        .when(F.contains(code, F.lit("connect")), "err_connect")
        .when(F.startswith(code, F.lit("http")), "err_http").otherwise("err_other")
    )
    return (
        F.when(error.isNull() | (error == ""), None)
        .when(F.startswith(error, F.lit("blocked:")), blocked)
        .when(F.startswith(error, F.lit("request_error:")), request).otherwise("err_other")
    )


def giveup_class(error: Column) -> Column:
    """Class of a delivery error: the exception type, or the text before the first colon."""
    first = F.regexp_extract(error, r"(?s)send_exception=(.*)$", 1)
    head = F.when(F.contains(error, F.lit("send_exception=")), F.coalesce(F.nullif(F.substring_index(first, ":", 1), F.lit("")), F.lit("exception")))
    return F.when(error.isNull() | (error == ""), "unknown").otherwise(
        F.trim(F.coalesce(head, F.nullif(F.substring_index(error, ":", 1), F.lit("")), F.lit("error")))
    )
