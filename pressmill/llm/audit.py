"""How quality filters interact: what each removes in every order, what only it finds, and its share over all orders.

Texts are read by a byte transducer: a table of byte classes and a table of actions by state and class. It counts characters,
capitals and symbols and gives the spans of the words, which go into a hash table that compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.llm.blocks import Block, blocks, hashes, mix, sums
from pressmill.session import settle

SPACE, CAPITAL, SYMBOL, PLAIN, LEAD, INNER = range(6)
GAP, WORD = range(2)
BEGINS, ENDS, CHARACTER, IS_CAPITAL, IS_SYMBOL = (1 << k for k in range(5))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every byte; state after a byte of each class; actions in each state for a byte of each class.

    The state after a byte follows from its class alone, so a block's states come from one lookup and need no loop.
    """
    kind = np.full(256, PLAIN, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x41:0x5B] = CAPITAL
    kind[list(b"#$%&*|")] = SYMBOL
    kind[0x80:0xC0] = INNER
    kind[0xC0:] = LEAD
    after = np.full(6, WORD, np.uint8)
    after[SPACE] = GAP
    act = np.zeros((2, 6), np.uint8)
    act[WORD, SPACE] |= ENDS
    act[GAP, CAPITAL:] |= BEGINS
    act[:, [SPACE, CAPITAL, SYMBOL, PLAIN, LEAD]] |= CHARACTER
    act[:, CAPITAL] |= IS_CAPITAL
    act[:, SYMBOL] |= IS_SYMBOL
    return kind, after, act


KIND, AFTER, ACT = _tables()


class Pass:
    """One pass over a block: ``chars, capitals, symbols`` of every text, and ``start, end, doc`` of its words."""

    def __init__(self, block: Block):
        n, at = len(block.buf), block.at
        kind = KIND[block.buf]
        after = AFTER[kind]
        before = np.empty(n, np.uint8)
        before[1:] = after[:-1]
        filled = np.diff(at) > 0
        before[at[:-1][filled]] = GAP
        act = ACT[before, kind]
        self.chars, self.capitals, self.symbols = (sums(act & flag > 0, at) for flag in (CHARACTER, IS_CAPITAL, IS_SYMBOL))
        self.start = np.flatnonzero(act & BEGINS)
        last = at[1:][filled]
        self.end = np.sort(np.concatenate([np.flatnonzero(act & ENDS), last[after[last - 1] == WORD]]))
        self.doc = np.searchsorted(at, self.start, "right") - 1


def equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` are those at ``b``, eight at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    out, live, k = np.ones(len(a), bool), np.flatnonzero(a != b), 0
    while len(live):
        rest = np.minimum(size[live] - k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        out[live] = (eight[a[live] + k] ^ eight[b[live] + k]) & mask == 0
        k += 8
        live = live[out[live] & (size[live] > k)]
    return out


def distinct_words(block: Block, words: Pass) -> np.ndarray:
    """Number of different words of every text: all spans of the block are inserted at once into one table with open addresses.

    In each round the spans that wait look at their next slot. An empty slot takes one of them; whoever meets the same bytes of
    the same text is a repeat; the others go on.
    """
    start, end, doc = words.start, words.end, words.doc
    size = end - start
    key = mix(hashes(block, start, end, fold=None) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    slots = 1 << max(4, int(2 * len(start)).bit_length())
    table = np.full(slots, -1, np.int32)
    place = (key >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)
    wait, first = np.arange(len(start)), np.zeros(len(start), bool)
    while len(wait):
        at = place[wait]
        free = table[at] < 0
        table[at[free]] = wait[free]
        owner = table[at]
        first[wait[owner == wait]] = True
        done = (key[owner] == key[wait]) & (doc[owner] == doc[wait]) & (size[owner] == size[wait])
        like = np.flatnonzero(done)
        done[like] = equal(block.buf, start[wait[like]], start[owner[like]], size[wait[like]])
        wait = wait[~done]
        place[wait] = (place[wait] + 1) & (slots - 1)
    return np.bincount(doc[first], minlength=len(block))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, n_words, n_distinct, n_chars, n_capitals, n_symbols, digest`` of every whole text (null: empty).

    Words are runs of anything but ASCII white space, in their own case; characters are code points; ``digest`` is half of the
    text's SHA-256. Null ids and parts stay null; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                seen = Pass(block)
                words = np.bincount(seen.doc, minlength=len(block))
                digest = [hashlib.sha256(block.buf[a:b]).digest()[:16] for a, b in zip(block.at[:-1], block.at[1:], strict=True)]
                counts = (words, distinct_words(block, seen), seen.chars, seen.capitals, seen.symbols)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.rows], batch.column(1)[block.rows], *(pa.array(c.astype(np.int64)) for c in counts), pa.array(digest, pa.binary())],
                    ["id", "part", "n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("part").cast("string"), "text").mapInArrow(
        run, f"id {kind}, part string, n_words bigint, n_distinct bigint, n_chars bigint, n_capitals bigint, n_symbols bigint, digest binary")


#: Filters by letter, as SQL conditions on ``profile`` under which a text fails. A copy of a text with a smaller id fails COPY.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
}
COPY = "E"


def _flag(column: str) -> Column:
    return F.coalesce(F.max((F.col(column) == 1).cast("int")), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, copy: str = COPY, id_col: str = "doc_id",
             text_col: str = "text", part_col: str = "source", good_col: str = "quality", bad_col: str = "toxic") -> DataFrame:
    """``id, part, fails, good, bad`` of every row: a bit for each filter it fails (the order of ``filters``, then ``copy``) and its labels.

    Texts are read once; after that narrow rows travel. The rows meet their labels by id and the repeated digests by digest. Both
    other sides are stored, so that a frequent digest is a split join and no single task.
    """
    filters = FILTERS if filters is None else filters
    mask = sum((F.when(F.expr(c), 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    rows = settle(profile(docs, id_col, text_col, part_col).select("id", F.coalesce("part", F.lit("")).alias("part"), mask.alias("_mask"), "digest"))
    first = settle(rows.groupBy("digest").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "_first"))
    told = settle(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(_flag(good_col).alias("good"), _flag(bad_col).alias("bad")))
    again = F.coalesce(F.col("id") > F.col("_first"), F.lit(False))
    return rows.join(told, "id", "left").join(first, "digest", "left").select(
        "id", "part", (F.col("_mask") + F.when(again, 1 << len(filters)).otherwise(0)).alias("fails"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))


def interactions(rows: DataFrame, letters: Sequence[str]) -> DataFrame:
    """What each filter does at each step of every order of the filters, from ``failures``: one row per part, order and step.

    ``kept, removed``: after and in this step; ``redundant``: fail this filter but were removed before; ``unique_fails``: fail this filter
    alone; ``good_lost, bad_lost``: removed here with that label; ``shapley``: removed by this filter, summed over all orders.
    What a step does depends on its filter and the set of those before it, so the rows are counted by part and set of failures
    first; all the rest works on at most 2**filters counts per part. A filter is first among its k fellows in 1/k of all orders.
    """
    n = len(letters)
    orders = [(order, k + 1, 1 << letters.index(x), sum(1 << letters.index(y) for y in order[:k]))
              for order in map("".join, permutations(letters)) for k, x in enumerate(order)]
    every = len(orders) // n
    counts = rows.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    steps = F.array(*(F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in sorted({x[2:] for x in orders})))
    step = counts.select("*", F.explode(steps).alias("_s")).select("part", "fails", "n", "good", "bad", "_s.own", "_s.before")
    own, earlier = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0

    def total(value: Column | str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long")

    share = F.col("n") * (F.lit(every) / F.bit_count("fails")).cast("long")
    done = step.groupBy("part", "own", "before").agg(
        total("n", ~own & ~earlier).alias("kept"), total("n", own & ~earlier).alias("removed"), total("n", own & earlier).alias("redundant"),
        total("n", F.col("fails") == F.col("own")).alias("unique_fails"), total("good", own & ~earlier).alias("good_lost"),
        total("bad", own & ~earlier).alias("bad_lost"), total(share, own).alias("shapley"))
    # n * n! rows, whatever the input.
    table = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, own int, before int")
    return done.join(F.broadcast(table), ["own", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "bad_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, copy: str = COPY, **columns: str) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, bad_lost, shapley``: see ``interactions``.

    ``filters``: SQL condition under which a text fails, by one letter, on the columns of ``profile``; ``copy``: the letter of the filter that a text
    fails if it equals the whole text of any row with a smaller id.

    Cases: null text = empty text, null part = empty part. A null id has no smaller id and is none; rows that repeat an id and text do
    not count as copies of each other. A label is set if any row of the id sets it; ids without labels have none. Every part has all
    rows, zeros included; an empty table gives no rows. Other columns are ignored.
    """
    filters = FILTERS if filters is None else filters
    return interactions(failures(docs, labels, filters, copy, **columns), [*filters, copy])
