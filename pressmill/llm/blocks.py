"""Texts of an Arrow batch as one byte buffer, with words, hashes and n-grams as numpy arrays.

A block holds whole texts: some MB of them, or one longer text. All functions work on the block at once, so that no Python
loop runs over words. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = 2 << 20

_SPACES = [0x20, *range(0x09, 0x0E)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words are runs of anything but ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[_SPACES] = True
#: Words are runs of letters, digits and bytes beyond ASCII.
MARKS = np.zeros(256, bool)
MARKS[:0x30] = MARKS[0x3A:0x41] = MARKS[0x5B:0x61] = MARKS[0x7B:0x80] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def tune(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that a task's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def sampled(rows: DataFrame, label: str, n: int) -> DataFrame:
    """About ``n`` rows of each label, all where it has fewer: those whose ``id`` hashes below n / rows of the label. Counts by label
    are all that is shuffled, and the choice does not depend on partitions or order."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(counts, label).where(share * F.col("_rows") < n).drop("_rows")


class Block:
    """``buf``: bytes of all texts, text i at ``at[i]:at[i + 1]``; ``rows``: the slice of the batch; ``null``: texts that are null."""

    def __init__(self, rows: slice, buf: np.ndarray, at: np.ndarray, null: np.ndarray):
        self.rows, self.buf, self.at, self.null = rows, buf, at, null

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.at[i] : self.at[i + 1]].tobytes()


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Cuts a string column into blocks of about ``limit`` bytes, never inside a text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    null = np.asarray(texts.is_null())
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Block(slice(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i], null[i:j])
        i = j


def words(block: Block, apart: np.ndarray = SPACE, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; ``apart`` marks the bytes between words. A word never spans two texts."""
    if not len(block.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~(apart[fold] if fold is not None else apart)[block.buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = block.at[1:-1]
    cuts = cuts[cuts < len(inside)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(block.at, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = got = np.multiply.accumulate(steps)
    return got[:n]


def hashes(block: Block, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit hash of the bytes of each span, from prefix sums of a polynomial in the position."""
    n = len(block.buf)
    table = _BYTES[fold] if fold is not None else _BYTES
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[block.buf] * _power("up", _BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", _INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word and hash of every run of ``n`` words inside one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = (total + h[k : k + m]) * _BASE
    pos = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return pos, mix(total[pos] + np.uint64(n))


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Start of every text's rows in an array sorted by text number, and the end of the last."""
    return np.searchsorted(doc, np.arange(n + 1))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[at[i]:at[i + 1]]`` for each i; 0 where that is empty."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ``[starts[i], starts[i] + lengths[i])``."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(n)


def list_parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null lists are empty."""
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size)])
