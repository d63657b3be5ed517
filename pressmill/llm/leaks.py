"""Benchmark decontamination: rare words of the test items find passages, Smith-Waterman alignments score the copies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import Block, blocks, bounds, gather, hashes, unused, words

LEAST = 3  # words of an item; shorter ones are never found
SEEDS = 6  # seed words that any copy of an item holds, fewer for items of fewer words
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score, as a share of the item's score with itself, from which a passage is a copy.
SCORE = 0.5
#: Text bytes of the items of one pass over the documents. More items take more passes; broadcasts stay below a few times this.
PASS_BYTES = 8 << 20
_FILTER = 1 << 22


class Items:
    """Test items as word hashes, with their distinct words in a sorted table."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids, self.words = ids, []
        for block in blocks(texts):
            start, end, doc = words(block)
            h, at = hashes(block, start, end), bounds(doc, len(block))
            self.words += [h[at[i] : at[i + 1]] for i in range(len(block))]
        self.table = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))

    def seeds(self, counts: np.ndarray, share: float) -> Seeds:
        """The rarest words of every item, by the number of documents that hold them, as many as no copy can lack.

        A score of ``share`` takes ``need`` matched words, as a match adds MATCH and all else takes away. So at most
        ``n - need`` words of an item are not matched, and of any ``n - need + k`` at least ``k`` are, however the copy was edited."""
        key, item, least = [], [], np.ones(len(self.words), np.int64)
        for i, w in enumerate(self.words):
            if len(w) < LEAST:
                continue
            k, times = np.unique(np.searchsorted(self.table, w), return_counts=True)
            need = max(1, math.ceil(share * len(w) - 1e-9))
            least[i] = min(SEEDS, need)
            order = np.lexsort((k, counts[k]))
            some = order[: int(np.searchsorted(np.cumsum(times[order]), len(w) - need + least[i])) + 1]
            key.append(k[some])
            item.append(np.full(len(some), i))
        key, item = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (key, item))
        order = np.argsort(key, kind="stable")
        keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
        return Seeds(self.ids, self.words, self.table[keys], first, count, item[order], least, share)


class Seeds:
    """``keys``: seed words; word k belongs to the items ``item[first[k]:first[k] + count[k]]``. A copy of item i holds at least
    ``least[i]`` of its seeds within ``reach[i]`` words: a score of ``share`` leaves no room for more words between."""

    def __init__(self, ids, words_, keys, first, count, item, least, share):
        self.ids, self.words, self.keys, self.first, self.count, self.item, self.least, self.share = ids, words_, keys, first, count, item, least, share
        self.size = np.fromiter((len(w) for w in words_), np.int64, len(words_))
        self.reach = np.ceil(self.size * (1 + MATCH * (1 - share))).astype(np.int64)


class Lookup:
    """Finds 64-bit keys in a sorted table; most absent ones fall out at a table of bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, np.zeros(_FILTER, bool)
        self.bits[(keys % np.uint64(_FILTER)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``h`` that are in the table, and their numbers there."""
        at = np.flatnonzero(self.bits[(h % np.uint64(_FILTER)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best local score, and start and end of the aligned words in ``window``."""
    n = len(window)
    col = np.arange(n)
    h, s = np.zeros(n, np.int64), col.copy()
    best, span = 0, (0, 0)
    for word in item:
        down = np.where(word == window, MATCH, MISMATCH)
        open_ = np.concatenate([[True], h[:-1] == 0])
        diag = down + np.concatenate([[0], h[:-1]])
        start = np.where(open_, col, np.concatenate([[0], s[:-1]]))
        up = h + GAP
        start = np.where(up > diag, s, start)
        t = np.maximum(np.maximum(diag, up), 0)
        start = np.where(t == 0, col, start)
        c = t - GAP * col
        top = np.maximum.accumulate(c)
        source = np.maximum.accumulate(np.where(c == top, col, 0))
        h, s = top + GAP * col, start[source]
        k = int(np.argmax(h))
        if h[k] > best:
            best, span = int(h[k]), (int(s[k]), k + 1)
    return best, *span


def _copies(block: Block, lookup: Lookup, seeds: Seeds) -> Iterator[tuple[int, int, float, int, int]]:
    """Text number, item number, score, first and last byte of the best aligned passage of every text and item."""
    start, end, doc = words(block)
    h = hashes(block, start, end)
    place, key = lookup(h)
    n = seeds.count[key]
    item, place = seeds.item[gather(seeds.first[key], n)], np.repeat(place, n)
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    # Places from which on an item's text holds enough of its seeds near enough.
    last = np.arange(len(item)) + seeds.least[item] - 1
    inside = np.flatnonzero(last < len(item))
    last = last[inside]
    near = (item[last] == item[inside]) & (doc[place[last]] == doc[place[inside]]) & (place[last] - place[inside] < seeds.reach[item[inside]])
    item, place = item[inside[near]], place[inside[near]]
    if not len(item):
        return
    at, text = bounds(doc, len(block)), doc[place]
    cut = np.ones(len(item) + 1, bool)
    cut[1:-1] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(place) > seeds.reach[item[1:]])
    edges = np.flatnonzero(cut)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        i, t = int(item[a]), int(text[a])
        size, reach = int(seeds.size[i]), int(seeds.reach[i])
        lo, hi = max(int(at[t]), int(place[a]) - reach), min(int(at[t + 1]), int(place[b - 1]) + reach)
        window = h[lo:hi]
        least = seeds.share * MATCH * size
        if MATCH * int(np.isin(seeds.words[i], window).sum()) < least:  # more cannot match
            continue
        got, x, y = align(seeds.words[i], window)
        if got >= least and got / (MATCH * size) > best.get((t, i), (0.0, 0, 0))[0]:
            best[t, i] = (got / (MATCH * size), int(start[lo + x]), int(end[lo + y - 1]))
    for (t, i), found in best.items():
        yield t, i, *found


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[pa.Table]:
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // PASS_BYTES)
    for k in range(count):
        yield rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).toArrow()


def find_copies(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                share: float = SCORE) -> DataFrame:
    """``id, item_id, score, start, end``: every document that holds a copy of a test item, exact or edited.

    Words are lower-cased runs without white space. The words of an item that are in the fewest documents are its seeds, so many
    that every copy holds SEEDS of them; frequencies are counted over all documents. Where a document holds as many, the words around them are
    aligned with the item (match 2, mismatch and gap -1); ``score`` is the alignment's share of the item's own score, at
    least ``share``. The rows are those of aligning every document with every item. ``start`` and ``end`` are characters of the
    whole text. The best passage of a document and item counts.

    The items are a stated query set: they are broadcast in passes of at most PASS_BYTES of text, each over all documents.

    Cases: null texts hold no words; an item of fewer than LEAST words has no seed and is never found. Repeated item or
    document rows are each reported. A null document id stays null. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}"
    schema = f"{kinds}, score double, start bigint, end bigint"
    found = spark.createDataFrame([], schema)
    for table in _passes(items, item_id, item_text):
        told = Items(table["id"].to_pylist(), table["text"].combine_chunks())
        seen = spark.sparkContext.broadcast(told.table)

        def count(batches: Iterator[pa.RecordBatch], seen=seen) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(seen.value)
            total = np.zeros(len(seen.value), np.int64)
            for batch in batches:
                for block in blocks(batch.column(0)):
                    start, end, doc = words(block)
                    hit, key = lookup(hashes(block, start, end))
                    pairs = np.unique(doc[hit] * len(total) + key)
                    total += np.bincount(pairs % len(total), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

        counts = np.zeros(len(told.table), np.int64)
        if len(counts):
            df = rows.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
            counts[np.asarray(df["word"])] = np.asarray(df["n"])
        seeds = spark.sparkContext.broadcast(told.seeds(counts, share))

        def match(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(seeds.value.keys)
            for batch in batches:
                for block in blocks(batch.column(1)):
                    hits = list(_copies(block, lookup, seeds.value))
                    if not hits:
                        continue
                    chars = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
                    base = chars[block.at]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0)[block.rows].take(pa.array([t for t, *_ in hits], pa.int64())),
                        pa.array([seeds.value.ids[i] for _, i, *_ in hits], ids_type),
                        pa.array([s for _, _, s, _, _ in hits], pa.float64()),
                        pa.array([int(chars[a] - base[t]) for t, _, _, a, _ in hits], pa.int64()),
                        pa.array([int(chars[b] - base[t]) for t, _, _, _, b in hits], pa.int64())], ["id", "item_id", "score", "start", "end"])

        ids_type = table.schema.field("id").type
        found = found.unionByName(rows.mapInArrow(match, schema))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a copy of a test item, with their columns. Cases as in ``find_copies``; rows meet their verdict by
    id and text, so one with a null or repeated id goes only for its own text."""
    name = unused(docs, "gone_row")
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    gone = find_copies(docs.select(row.alias("row"), F.col(text_col).alias("text")), items, "row", "text").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(f"{name}.id")) & (F.xxhash64(text_col) == F.col(f"{name}.text")), "left_anti")
