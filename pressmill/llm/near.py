"""Near duplicates: banded MinHash, odd sketches to verify candidates, full shingle sets to confirm links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pressmill.llm.blocks import Block, blocks, bounds, grams, hashes, mix, unused, words
from pressmill.llm.graph import components
from pressmill.session import settle

WIDTH = 5  # words of a shingle
SHARE = 75  # similarity in percent from which two texts are linked
#: 50 bands of 6 samples: a pair at 0.75 shares no band with probability 6e-5, at 0.8 with 3e-7.
BANDS, ROWS = 50, 6
#: Bits of an odd sketch, and standard deviations below the threshold from which a candidate is dropped unseen.
BITS, MARGIN = 1024, 4.5
#: Each round compares the members of a bucket with this many times as many leaders as the one before; the first with one.
GROWTH = 31

_RANDOM = np.random.Generator(np.random.PCG64(6))
_A = (_RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the block's texts, ordered by text and hash, and each one's text number."""
    start, end, doc = words(block)
    h = hashes(block, start, end)
    pos, g = grams(h, doc, width)
    doc_g = doc[pos]
    at = bounds(doc, len(block))
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < width))
    if len(short):
        extra = [mix(np.array([hash_short(h[at[i] : at[i + 1]])], np.uint64))[0] for i in short]
        g, doc_g = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([doc_g, short])
    order = np.lexsort((g, doc_g))
    g, doc_g = g[order], doc_g[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc_g[1:] != doc_g[:-1])
    return g[fresh], doc_g[fresh]


def hash_short(h: np.ndarray) -> int:
    """Hash of a text of fewer words than a shingle has: the whole sequence and its length."""
    total = len(h)
    for x in h.tolist():
        total = (total * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
    return total


def sketches(g: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts with shingles (numbers first): the band keys (texts x BANDS) and odd sketches (texts x BITS/64)."""
    some = np.flatnonzero(np.diff(bounds(doc, n)))
    k = BANDS * ROWS
    low = np.empty((len(some), k), np.uint32)
    if len(some):
        x, at = (g >> np.uint64(32)).astype(np.uint32), np.searchsorted(doc, some)
        v = np.empty_like(x)
        for i in range(k):
            np.multiply(x, _A[i], out=v)
            np.add(v, _B[i], out=v)
            low[:, i] = np.minimum.reduceat(v, at)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), 1))
    for r in range(ROWS):
        keys = mix(keys + low[:, r::ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    place = mix(low.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    place += (np.arange(len(some), dtype=np.uint64) * np.uint64(BITS))[:, None]
    odd = np.bincount(place.ravel().astype(np.int64), minlength=len(some) * BITS) & 1
    return some, keys, np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").reshape(len(some), BITS // 64)


def most_bits(share: int = SHARE) -> int:
    """Set bits of the XOR of two odd sketches up to which a pair may have the similarity ``share`` percent.

    Two texts differ in about 2k(1 - J) samples, which leave n/2 (1 - exp(-4k(1 - J)/n)) odd bits. MARGIN standard deviations
    of both the sampling and the folding are allowed for.
    """
    k, j = BANDS * ROWS, share / 100
    differ = k * (1 - j)
    mean = BITS / 2 * (1 - math.exp(-4 * differ / BITS))
    slope = 2 * math.exp(-4 * differ / BITS)
    spread = math.sqrt(k * j * (1 - j)) * slope
    fold = math.sqrt(BITS / 4 * (1 - math.exp(-8 * differ / BITS)) - 2 * differ * math.exp(-8 * differ / BITS))
    return math.ceil(mean + MARGIN * math.hypot(spread, fold))


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, key, bands, odd`` of every row: set size, hash of the set, band keys and odd sketch (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                g, doc = shingles(block)
                at = bounds(doc, len(block))
                n = np.diff(at)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g))])
                key = mix((total[at[1:]] - total[at[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)))
                some, keys, odd = sketches(g, doc, len(block))
                lists = [pa.array([None] * len(block), pa.list_(pa.int64()))] * 2
                if len(some):
                    empty = n == 0
                    lists = [_nullable(x.view(np.int64), empty) for x in (keys, odd)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.rows], pa.array(n), pa.array(key.view(np.int64)), *lists], ["id", "n", "key", "bands", "odd"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, key bigint, bands array<bigint>, odd array<bigint>")


def _nullable(rows: np.ndarray, empty: np.ndarray) -> pa.Array:
    """A list column with the rows of ``rows`` at the places that are not empty, null elsewhere."""
    at = np.concatenate([[0], np.cumsum(np.where(empty, 0, rows.shape[1]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()), mask=pa.array(empty))


def _apart(x: str, y: str):
    """Set bits of the XOR of two odd sketches. Written over arrays: spelled out for each element, it makes a method that the JVM only interprets."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, bits: total + bits)


def _first_common(x: str, y: str):
    """The first band key that two lists have at the same place."""
    same = F.zip_with(x, y, lambda a, b: a == b)
    return F.get(F.col(x), F.array_position(same, True).cast("int") - 1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sets: list[np.ndarray] = []
    for block in blocks(texts):
        g, doc = shingles(block)
        sets.extend(np.split(g, bounds(doc, len(block))[1:-1]))
    return sets


def confirmed(pairs: DataFrame, cards: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs ``u, v`` whose odd sketches allow the similarity and whose full shingle sets have it. ``cards``: ``id, odd, text``."""
    side = lambda *names: cards.select(*(F.col(c).alias(n) for c, n in zip(("id", "odd", "text"), names, strict=True)))
    first = pairs.join(side("v", "_y", "_tv"), "v").withColumnRenamed("u", "_u")
    likely = first.join(side("u", "_x", "_tu"), (F.col("_u") == F.col("u")) & (_apart("_x", "_y") <= most_bits(share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Each distinct text of the batch is cut once, whatever the number of its pairs.
            left, right = (batch.column(k).fill_null("").dictionary_encode() for k in (2, 3))
            xs, ys = shingle_sets(left.dictionary), shingle_sets(right.dictionary)
            linked = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True)):
                x, y = xs[a], ys[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * common >= share * (len(x) + len(y) - common)
            yield batch.filter(pa.array(linked)).select(["u", "v"])

    return likely.select("u", "v", "_tu", "_tv").mapInArrow(run, "u bigint, v bigint").distinct()


def shared_shingles(cards: DataFrame) -> DataFrame:
    """``id, alone``: the shingles of each text of ``cards`` that no other text there has; ids without any are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                g, doc = shingles(block)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0)[block.rows].take(pa.array(doc))], ["g", "id"])

    rows = cards.select("id", "text").mapInArrow(run, "g bigint, id bigint")
    single = rows.groupBy("g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k")).where("k = 1")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """``id, n, component_id, kept``: one row for every row of ``docs``; ``kept`` marks the smallest id of each component.

    Texts are linked when 100 * common shingles >= share * shingles in either. Equal sets are represented by their smallest id.
    A pair is a candidate when it shares a band bucket, when the shingles that each has in common with any candidate suffice
    (an exact bound), and when the odd sketches allow the similarity; then the full sets decide. Of every bucket all members are
    compared first with one leader, the text with the fewest shingles of its own, so that a large group of near copies costs
    one pair per member. Buckets that still hold several components go on with 31, 961, ... further leaders until every pair
    across components has been compared: no link that shares a bucket is lost, no bucket is capped.

    Cases: a null or empty text, or one of white space only, has n = 0 and is linked with nothing. A null id is linked with
    nothing, has a null component and stays. Rows that repeat an id are versions of one document: it is linked where one of
    them is. An empty table gives no rows. Other columns are ignored.
    """
    sketch = settle(sketch_table(docs, id_col, text_col))
    named = sketch.where("id IS NOT NULL AND n > 0")
    classes = settle(named.groupBy("key", "n").agg(F.min(F.struct("id", "bands", "odd")).alias("r")).select("key", "n", "r.*"))
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("bucket")
    live = settle(members.join(several, "bucket"))
    ids = settle(live.select("id").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cards = settle(texts.join(ids, "id", "left_semi").join(classes.select("id", "odd").join(ids, "id", "left_semi"), "id"))

    # A text can only be linked if enough of its shingles occur in another candidate.
    live = live.join(shared_shingles(cards), "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    live = settle(live.where(100 * F.col("common") >= share * F.col("n")).select("bucket", "id", "n", "common"))
    rank = F.struct(F.col("common") / F.col("n"), -F.col("id"), "id", "n", "common")
    lead = live.groupBy("bucket").agg(F.max(rank).alias("_l"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    lead = lead.select("bucket", F.col("_l.id").alias("u"), F.col("_l.n").alias("_n"), F.col("_l.common").alias("_common"))
    pairs = live.join(lead, "bucket").where((F.col("id") != F.col("u")) & _enough(share)).select("u", F.col("id").alias("v")).distinct()
    edges = settle(confirmed(pairs, cards, share))

    roots = components(edges)
    done, count = 1, GROWTH
    left = _mixed(live, roots, done).withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc(F.col("common") / F.col("n")), "id")) - 1)
    left = settle(left.join(classes.select("id", "n", "bands", "odd"), ["id", "n"]))
    while left.select("bucket").limit(1).count():
        first = left.where((F.col("pos") >= done) & (F.col("pos") < done + count)).select("bucket", *(
            F.col(c).alias("_" + c) for c in ("id", "n", "common", "pos", "root", "bands", "odd")))
        new = (F.col("pos") > F.col("_pos")) & (F.col("root") != F.col("_root")) & _enough(share)
        new = new & (_apart("odd", "_odd") <= most_bits(share)) & (_first_common("bands", "_bands") == F.col("_bucket"))  # only in their first common bucket
        pairs = left.join(first.withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & new)
        pairs = pairs.select(F.col("_id").alias("u"), F.col("id").alias("v")).distinct()
        more = settle(confirmed(pairs, cards, share))
        if more.limit(1).count():
            edges = edges.unionByName(more)
            roots = components(edges)
        done, count = done + count, count * GROWTH
        left = settle(_mixed(left.drop("root"), roots, done))

    whole = named.select("id", "key", "n").join(classes.select("key", "n", F.col("id").alias("rep")), ["key", "n"])
    versions = settle(whole.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")))
    if versions.where("u <> v").limit(1).count():
        roots = components(edges.unionByName(versions.where("u <> v").select("u", "v")))
    root = versions.join(roots.select(F.col("id").alias("u"), "root"), "u", "left").select("id", F.coalesce("root", "u").alias("root"))
    told = sketch.select("id", "n").join(root, "id", "left")
    return told.select("id", "n", F.coalesce("root", "id").alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _enough(share: int):
    """Whether two texts can have the similarity at all: neither brings more common shingles than it shares with any text."""
    return (100 + share) * F.least("common", "_common") >= share * (F.col("n") + F.col("_n"))


def _mixed(rows: DataFrame, roots: DataFrame, done: int) -> DataFrame:
    """The rows of buckets that hold several components and more than ``done`` + 1 members, with each id's ``root``."""
    rows = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("_k"))
    return rows.join(several.where((F.col("_a") != F.col("_b")) & (F.col("_k") > done + 1)).select("bucket"), "bucket", "left_semi")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one document of each group. Cases as in ``near_groups``."""
    name = unused(docs, "gone_id")
    gone = near_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
