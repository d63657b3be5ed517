"""Text cleaning, junk tests and rule-based summaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressmill.functions.html import unescape
from pressmill.functions.rules import BOILERPLATE, CONSENT_WORDS
from pressmill.functions.text import WS, blank, collapse, contains_any, let, strip, words

SENTENCE_END = r"(?U)(?<=[.!?؟])\s+"
#: The display cleaner knows no Arabic question mark.
DISPLAY_END = r"(?U)(?<=[.!?])\s+"
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"

# Closing lines of the rule-based summary.
CLOSING = {
    "en": "Why it matters: it may affect Libya’s political, economic, or security situation.",
    "ar": "الأهمية: قد يؤثر ذلك على الوضع السياسي أو الاقتصادي أو الأمني في ليبيا.",
}


def plain_text(text: Column) -> Column:
    """Tags out when both angle brackets occur, whitespace collapsed."""
    raw = strip(blank(text))
    tagged = F.contains(raw, F.lit("<")) & F.contains(raw, F.lit(">"))
    return collapse(F.when(tagged, F.regexp_replace(raw, r"<[^>]+>", " ")).otherwise(raw))


def clean_text(text: Column, allow_html: bool = False) -> Column:
    """Display form: line ends kept, blank runs reduced; NULL when nothing is left."""
    out = text
    if allow_html:
        out = F.regexp_replace(out, r"(?i)<\s*br\s*/?>", "\n")
        out = F.regexp_replace(out, r"(?i)</\s*p\s*>", "\n")
        out = unescape(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.regexp_replace(out, r"(?U)\s+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.nullif(strip(F.regexp_replace(out, r"[ \t]+", " ")), F.lit(""))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def drop_boilerplate(text: Column, max_chars: int = 4000) -> Column:
    """Lines (or sentences of a text with at most two lines) without page furniture and long enough."""

    def good(min_len: int):
        return lambda s: ~contains_any(F.lower(s), BOILERPLATE) & (F.length(s) > min_len)

    kept = let(_pieces(text, r"\n+"), lambda lines: F.when(
        F.size(lines) <= 2, F.filter(_pieces(text, DISPLAY_END), good(40))).otherwise(F.filter(lines, good(25))))
    return F.nullif(F.left(F.array_join(kept, "\n\n"), F.lit(max_chars)), F.lit(""))


def all_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END)


def filled_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda s: s != "")


def is_junk(text: Column) -> Column:
    """Nothing there, mostly repeated lines, or a short consent text. Takes raw text with its line ends."""

    def by_lines(lines: Column) -> Column:
        n, unique = F.size(lines), F.size(F.array_distinct(lines))
        return (n == 0) | ((n >= 5) & (F.lit(1.0) - unique / n > 0.5))

    consent = (F.length(text) < 1200) & contains_any(F.lower(text), CONSENT_WORDS)
    return let(filled_lines(blank(text)), by_lines) | F.coalesce(consent, F.lit(False))


def junk_reason(text: Column) -> Column:
    few = F.size(F.array_distinct(filled_lines(text))) < F.greatest(F.lit(1), F.floor(F.size(all_lines(text)) * 0.5))
    return (
        F.when(contains_any(F.lower(text), ["cookie", "privacy"]), "JUNK_COOKIE")
        .when(few, "JUNK_REPEATED_LINES").otherwise("JUNK_OTHER")
    )


def fast_summary(text: Column, max_chars: int = 320, sentences: int = 2) -> Column:
    lead = strip(F.array_join(F.slice(F.split(text, SENTENCE_END), 1, sentences), " "))
    return strip(F.left(F.coalesce(F.nullif(lead, F.lit("")), text), F.lit(max_chars)))


def extractive_summary(text: Column, title: Column) -> Column:
    t = collapse(blank(text))
    lead = strip(F.left(strip(F.array_join(F.slice(F.split(t, SENTENCE_END), 1, 3), " ")), F.lit(800)))
    closing = F.when(F.rlike(t, F.lit("[؀-ۿ]")), CLOSING["ar"]).otherwise(CLOSING["en"])
    body = F.concat(F.lit("- "), lead, F.lit("\n\n"), closing)
    headed = F.when(blank(title) != "", F.concat(strip(title), F.lit("\n\n"), body)).otherwise(body)
    return F.when(t == "", strip(blank(title))).otherwise(headed)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def truncate_words(text: Column, n: int) -> Column:
    return let(words(text), lambda w: F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, 1, n), " ")))


def short_title(text: Column, limit: int = 80) -> Column:
    return F.regexp_replace(F.left(collapse(blank(text)), F.lit(limit)), r"(?U)\s+$", "")


def clean_entity_list(names: Column, limit: int = 15) -> Column:
    tidy = F.filter(F.transform(names, lambda x: strip(F.regexp_replace(x, WS, " "))), lambda x: x != "")
    return F.slice(F.array_distinct(tidy), 1, limit)
