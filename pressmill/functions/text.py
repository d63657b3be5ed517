"""String expressions with Unicode whitespace and substring rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

WS = r"(?U)\s+"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse(col: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(col, WS, " "))


def blank(col: Column) -> Column:
    """NULL counts as the empty string."""
    return F.coalesce(col, F.lit(""))


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``. Conditional branches are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_token(bound: Column, tokens: Iterable[str]) -> Column:
    """Substring tests on a value that is already computed (a column, or bound by ``let``)."""
    return any_of(F.contains(bound, F.lit(t)) for t in tokens)


def contains_any(col: Column, tokens: Iterable[str]) -> Column:
    """Substring test, not a word test: "oil" is found in "soil". NULL text gives NULL."""
    return let(col, lambda t: has_token(t, tokens))


def contains_any_of(col: Column, tokens: Column) -> Column:
    """Substring test against an array column."""
    return F.exists(tokens, lambda t: F.contains(col, t))


def starts_with_any_of(col: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(col, p))


def words(col: Column) -> Column:
    return F.filter(F.split(col, WS), lambda w: w != "")


def lead_words(col: Column, n: int) -> Column:
    """The first ``n`` words. The text is split no further: after them (and an empty piece before the first) comes the rest in one piece."""
    first = F.slice(F.split(col, WS, n + 2), 1, n + 1)
    return F.array_join(F.slice(F.filter(first, lambda w: w != ""), 1, n), " ")


def clamp(col: Column, n: int = 280) -> Column:
    """Collapsed text, cut to ``n`` characters with an ellipsis."""
    text = collapse(blank(col))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(strip(F.left(text, F.lit(n))), F.lit("…")))


def tokens(col: Column) -> Column:
    """Lower-cased letter and digit runs, in order."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normalize_title(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(col)), r"[^\p{L}\p{N}]+", " "))


def normalize_name(col: Column) -> Column:
    """Letters and digits outside parentheses, nested to any depth; an unclosed "(" drops the rest, a spare ")" nothing."""
    pieces = F.regexp_extract_all(blank(col), F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def read(state: Column, piece: Column) -> Column:
        depth = F.when(piece == "(", state["depth"] + 1).when(piece == ")", F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        kept = (state["depth"] == 0) & ~piece.isin("(", ")")
        return F.struct(depth.alias("depth"), F.when(kept, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    out = F.aggregate(pieces, start, read, lambda state: state["out"])
    return F.lower(F.regexp_replace(out, r"[^\p{L}\p{N}]+", ""))


def normalize_entity(col: Column) -> Column:
    return F.lower(collapse(blank(col)))


def arabic_digits_to_ascii(col: Column) -> Column:
    return F.translate(col, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def script_language(col: Column) -> Column:
    """"ar" when any Arabic block character occurs, else "en"."""
    return F.when(F.rlike(col, F.lit("[؀-ۿݐ-ݿࢠ-ࣿ]")), "ar").otherwise("en")


def ilike_any(cols: Iterable[Column], pattern: Column) -> Column:
    return any_of(F.coalesce(F.ilike(c, pattern), F.lit(False)) for c in cols)


def json_in_text(col: Column) -> Column:
    """The JSON of a noisy text: the whole text when it parses, else what lies from the first ``{`` to the last ``}``; NULL when
    that does not parse either."""
    whole = strip(blank(col))
    part = F.regexp_substr(whole, F.lit(r"(?s)\{.*\}"))
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(valid(whole), whole).when(valid(part), part)


def json_string(col: Column) -> Column:
    """A JSON string literal of the value, ``null`` for NULL, control escapes in lower case."""
    wrapped = F.to_json(F.struct(col.alias("x")))

    def lower_escapes(quoted: Column) -> Column:
        out = quoted
        for upper in "ABCDEF":
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00([01]){upper}", rf"$1\\u00$2{upper.lower()}")
        return F.when(F.contains(quoted, F.lit("\\u00")), out).otherwise(quoted)

    text = let(wrapped, lambda w: let(F.substring(w, F.lit(6), F.length(w) - 6), lower_escapes))
    return F.when(col.isNull(), F.lit("null")).otherwise(text)
