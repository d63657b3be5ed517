"""Personal data, and words that give it away: spans by pattern, and terms whose co-occurrence with a protected value discloses it.

Only column expressions, joins and aggregates. A protected value e (an address, a number) has the information ln(N / n(e)) when it
stands in n(e) of N documents. A term t near it takes ln(N n(e,t) / (n(e) n(t))) of that away, its pointwise mutual information. The share is
the term's disclosure: 1 if the term stands nowhere but near e, 0 if it stands there by chance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions.text import let
from pressmill.session import settle

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS[-1]
#: Patterns of the values, by kind, in this order. A possessive quantifier stands where nothing can be given back, and a run of characters is
#: entered at its first one only (or where the last match ended), so that no text takes quadratic time or deep recursion. They find what the
#: plain patterns find.
_NAME = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these characters has no match.
MARKS = {"email": "@", "ip": ".", "phone": "+"}
#: Characters on each side of a value in which terms are counted with it.
REACH = 100
#: A value in more than one of COMMON documents identifies nobody.
COMMON = 32
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Bits by which the words of all texts are sifted before they are counted: 64 in each of SIFT rows, whatever the input.
SIFT = 1 << 16
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CHUNK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it. Chunk by chunk: an array that grows is copied at each step."""
    def grow(chunk: Column, base: Column) -> Column:
        zero = F.struct(F.array().cast("array<bigint>").alias("out"), base.cast("bigint").alias("sum"))
        return F.aggregate(chunk, zero, lambda a, x: F.struct(F.concat(a.out, F.array(a.sum)).alias("out"), (a.sum + x).alias("sum")), lambda a: a.out)

    def all_of(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.flatten(F.zip_with(chunks, grow(totals, F.lit(0)), grow))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda k: F.slice(sizes, k * _CHUNK + 1, _CHUNK))
    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(let(chunks, all_of))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x).cast("bigint"))


def matches(text: Column, pattern: str, rank: int, sift: Callable[[Column], Column]) -> Column:
    """``array<struct<start, rank, end, value>>``: the matches of a pattern that pass ``sift``, leftmost first, with their places in code points."""
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, value: string>>")

    def placed(found: Column, gaps: Column, sizes: Column) -> Column:
        begins = sums_before(F.zip_with(gaps, sizes, lambda a, b: a + b))
        starts = F.zip_with(begins, gaps, lambda a, b: a + b)
        return F.transform(F.arrays_zip(starts.alias("s"), found.alias("v")), lambda r: F.struct(
            r["s"].alias("start"), F.lit(rank).alias("rank"), (r["s"] + F.length(r["v"])).alias("end"), r["v"].alias("value")))

    def some(found: Column) -> Column:
        gaps = F.slice(_lengths(F.split(text, pattern, -1)), F.lit(1), F.size(found))
        return F.filter(let(gaps, lambda g: let(_lengths(found), lambda n: placed(found, g, n))), lambda s: sift(s["value"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.exists(found, sift), some(found)).otherwise(none))


def base_spans(text: Column) -> Column:
    """Values of all kinds but TERM, by start and kind. Leftmost matches of each kind by itself; a match that is not valid is not retried."""
    found = [matches(text, PATTERNS[kind], k, partial(_valid, kind)) for k, kind in enumerate(KINDS[:-1])]
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, value: string>>")
    found = [F.when(F.contains(text, F.lit(MARKS[kind])), x).otherwise(none) if kind in MARKS else x for kind, x in zip(KINDS, found, strict=False)]
    return F.array_sort(F.concat(*found))


def _entity(span: Column) -> Column:
    """The protected value of a span: its kind and spelling, digits alone for numbers with separators."""
    return F.concat(span["rank"].cast("string"), F.lit(":"), F.when(span["rank"] >= KINDS.index("card"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _contexts(text: Column, spans: Column) -> Column:
    """``array<struct<entity, near>>``: of every span its protected value and the text up to REACH characters on either side, without words that
    the reach cuts. The text is cut into pieces first, so that a far span does not count its characters from the text's start."""
    size = 40 * REACH

    def near(pieces: Column, span: Column) -> Column:
        k = F.floor(F.greatest(span["start"] - REACH, F.lit(0)) / size).cast("int")
        last = F.floor((span["end"] + REACH) / size).cast("int")
        own = F.array_join(F.slice(pieces, k + 1, last - k + 1), "")
        start, end = (span["start"] - k * size).cast("int"), (span["end"] - k * size).cast("int")
        left = F.substring(own, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH)))
        left = F.when(span["start"] > REACH, F.regexp_replace(left, "^" + _WORD, "")).otherwise(left)
        right = F.regexp_replace(F.substring(own, end + 1, F.lit(REACH)), _WORD + "$", "")
        return F.struct(_entity(span).alias("entity"), F.concat(left, F.lit("\n"), right).alias("near"))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0), lambda pieces: F.transform(spans, lambda s: near(pieces, s)))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _APART, -1)), lambda w: F.length(w) > 0)


def find_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, spans, text`` of every row, stored: a number for the row and its values; the text only where it holds any."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = rows.select("id", "text", F.explode(F.array(base_spans(F.col("text")))).alias("spans"))
    return settle(held.select(F.monotonically_increasing_id().alias("row"), "id", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))


def disclosures(docs: DataFrame, values: DataFrame, text_col: str = "text", common: int = COMMON, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """The terms that give protected values away, ``pair, term, share``, and the stored pairs of all rows, ``row, pair``.

    Counted in documents, copies included, but a pair must have been met in two different surroundings: what is only copied says
    nothing about a term. A value in more than one of ``common`` documents is not protected by hiding words. Of the words of all texts only
    those that stand near some value are counted; the others are sifted out before the shuffle by a bitmap of fixed size.
    """
    total = values.agg(F.count(F.lit(1)).alias("n")).first().n
    held = values.where(F.size("spans") > 0).select("row", F.explode(F.array(_contexts(F.col("text"), F.col("spans")))).alias("c"))
    pairs = F.array_distinct(F.flatten(F.transform("c", lambda c: F.transform(_terms(c["near"]), lambda t: F.concat(c["entity"], F.lit("\n"), t)))))
    near = settle(held.select("row", F.xxhash64(F.array_join("c.near", "\n")).alias("around"), F.explode(pairs).alias("pair")))
    entity, term = F.substring_index("pair", "\n", 1), F.substring_index("pair", "\n", -1)
    met = near.groupBy("pair").agg(F.count(F.lit(1)).alias("both"), F.min("around").alias("_a"), F.max("around").alias("_z")).where("_a <> _z")
    of = held.select(F.explode(F.array_distinct("c.entity")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("own"))
    asked = settle(met.select("pair", entity.alias("entity"), term.alias("term"), "both").join(of.where(F.col("own") * common <= total), "entity"))

    code = F.xxhash64("term")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(code, 40) & 63 as int))")
    sift = asked.select(code.alias("code")).select(F.pmod("code", F.lit(SIFT)).alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    words = docs.select(F.explode(_terms(F.col(text_col))).alias("term")).select("term", code.alias("code"))
    words = words.select("term", F.pmod("code", F.lit(SIFT)).alias("place"), bit.alias("bit"))
    # At most SIFT rows, whatever the input.
    sifted = words.join(F.broadcast(sift), "place").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    counts = sifted.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    every = F.greatest(F.coalesce("seen", F.lit(0)), F.col("both"))
    share = F.least(F.lit(1.0), F.log(total * F.col("both") / (F.col("own") * every)) / F.log(total / F.col("own")))
    found = asked.join(counts, "term", "left").select("pair", "term", share.alias("share")).where(F.col("share") >= least)
    return settle(found), near


def _replaced(text: Column, pattern: str, label: Callable[[Column], Column]) -> Column:
    """The text with each match of the pattern as ``label`` writes it."""
    def put(found: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, pattern, -1), F.transform(found, label), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), put)


def _clean(text: Column, general: Column, removed: Column) -> Column:
    """Values as their kind in brackets; general terms as what they are; removed terms left out."""
    def named(v: Column) -> Column:
        return F.when(v.rlike("^[0-9]+$"), "[NUMBER]").when(F.lower(v) != v, "[NAME]").otherwise("[TERM]")

    def word(v: Column) -> Column:
        own = v.isin(*(k.upper() for k in KINDS[:-1]))
        return F.when(own, v).when(F.array_contains(removed, F.lower(v)), "").when(F.array_contains(general, F.lower(v)), named(v)).otherwise(v)

    def masked(kind: str, t: Column) -> Column:
        return _replaced(t, PATTERNS[kind], lambda v: F.when(_valid(kind, v), f"[{kind.upper()}]").otherwise(v))

    out = text
    for kind in KINDS[:-1]:
        out = let(out, partial(masked, kind))
    return let(out, lambda t: F.when(F.size(general) + F.size(removed) > 0, _replaced(t, _WORD, word)).otherwise(t))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``id, base, spans, general, removed, text`` of every row.

    ``base``: values of whole texts, ``array<struct<start, rank, end, value>>`` by start and kind (``rank``: number in KINDS; code points, end exclusive);
    ``spans``: those and every place of a term that discloses a value of the same row near which it stands (outside the values);
    ``general, removed``: these terms with a disclosure from ``generalise`` and from ``remove`` on; ``text``: values as their kind, general terms as a
    name, number or term, the others left out; null where nothing changes.

    Values: ``email``; ``ip`` with parts up to 255; ``card``, 14 to 19 digits that pass the Luhn test; ``phone``, 10 to 15 digits after a plus.

    Cases: a null or empty text has no spans. Null ids stay null; repeated rows are documents of their own; an empty table gives no rows.
    Other columns are ignored. Texts without values have no terms either, so they never change.
    """
    values = find_values(docs, id_col, text_col)
    found, near = disclosures(docs, values, text_col, common, generalise)
    # Both sides are stored, so that a frequent pair is a split join.
    told = near.join(found, "pair").groupBy("row", "term").agg(F.max("share").alias("share"))
    told = settle(told.groupBy("row").agg(
        F.collect_list(F.when(F.col("share") < remove, F.col("term"))).alias("general"), F.collect_list(F.when(F.col("share") >= remove, F.col("term"))).alias("removed")))
    none = F.array().cast("array<string>")
    rows = values.join(told, "row", "left").withColumns({"general": F.coalesce("general", none), "removed": F.coalesce("removed", none)})
    every = F.concat("general", "removed")
    words = matches(F.col("text"), _WORD, KINDS.index(TERM), lambda v: F.array_contains(every, F.lower(v)))
    apart = F.filter(words, lambda w: ~F.exists(F.col("base"), lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    return rows.withColumnRenamed("spans", "base").select(
        "id", "base", F.when(F.size(every) > 0, F.array_sort(F.concat("base", apart))).otherwise(F.col("base")).alias("spans"), "general", "removed",
        F.when(F.size("base") > 0, _clean(F.col("text"), F.col("general"), F.col("removed"))).alias("text"))
