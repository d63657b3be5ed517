"""Periodic runs of words: a few words repeated back to back, found in the tree of LCP intervals of a text's suffixes.

A run with first word s, length L and smallest period q is a maximal pair (s, s + q): the suffixes there share L - q words and no
more, and the words on their left differ. Going up the tree, the positions of child intervals are merged in the order of the text;
where a position of one child is next to one of another, with a different word on its left and no further away than the shared words
allow, the pair is a run, extended by construction. A pair further apart than the period has the same ends and gives way to it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import blocks, bounds, gather, hashes, mix, words

#: A run has at least so many words, and so many times its period.
LENGTH, TIMES = 6, 4
BLOCK = 1 << 20
#: Bytes of kept words that are put together at once.
JOINED = 1 << 18
_TEXT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _extended(code: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
    """Codes of stretches of words from those of their first k words and of the stretch ``by`` after them."""
    ahead = np.zeros_like(code)
    ahead[:-k] = by[k:]
    return mix(code * _STEP + ahead)


def hopeful(h: np.ndarray, doc: np.ndarray, texts: int, length: int = LENGTH, times: int = TIMES) -> np.ndarray:
    """Which texts may hold a run. ``h``: hashes of the words, text by text; ``doc``: the text of each.

    A run's pair shares k to 2 k - 1 words for some k = shared, 2 * shared, 4 * shared ..., and is no further apart than that allows. A text is
    left out when no stretch of k words comes again so near, for every k at which any comes again at all.
    """
    k, n = min(max(length, times * q) - q for q in range(1, length + 1)), len(h)
    found = np.zeros(texts, bool)
    if n < k:
        return found
    last = np.searchsorted(doc, doc, "right")
    code = h
    for j in range(1, k):
        code = _extended(code, h, j)
    at = np.flatnonzero(np.arange(n) + k <= last)
    while len(at):
        key = mix(code[at] + doc[at].astype(np.uint64) * _TEXT)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twin = np.zeros(len(at), bool)
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        at, key = at[twin], key[twin]
        order = np.lexsort((at, key))
        gap = np.diff(at[order])
        near = (key[order][1:] == key[order][:-1]) & (gap * (times - 1) < 2 * k)
        found[doc[at[order[1:]][near]]] = True
        again = np.zeros(n, bool)
        again[at] = True
        at = at[~found[doc[at]] & (at + 2 * k <= last[at])]
        at = at[again[at + k]]
        if len(at):
            code, k = _extended(code, code, k), 2 * k
    return found


def suffixes(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, words that each shares with the one before it (0 across texts), and a number for each word.

    Suffixes are sorted by their first 1, 2, 4, ... words; only those that are still equal are sorted again. The ranks of all rounds
    give the shared words from the longest stretch to the shortest.
    """
    n = len(h)
    last = np.searchsorted(doc, doc, "right")
    order = np.lexsort((h, doc))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        at = np.flatnonzero(size[rank] > 1)
        if not len(at):
            break
        ahead = np.where(at + k < last[at], rank[np.minimum(at + k, n - 1)], -1)
        order = np.lexsort((ahead, rank[at]))
        at, ahead, group = at[order], ahead[order], rank[at][order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        new = first | np.concatenate([[True], ahead[1:] != ahead[:-1]])
        place = np.arange(len(at))
        slot = group + place - np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[at] = slot[np.maximum.accumulate(np.where(new, place, 0))]
        levels.append(rank)
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    shared = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + shared[1:], b + shared[1:]
        inside = (x < last[a]) & (y < last[b])
        shared[1:] += np.where(inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)]), 1 << level, 0)
    shared[1:][doc[a] != doc[b]] = 0
    return order, shared, levels[0]


class Interval:
    """Positions of an LCP interval in the order of the text; ``word``: the class of all of them by the word on their left, None if mixed."""

    __slots__ = ("at", "word", "depth")

    def __init__(self, at: int, word: int, depth: int):
        self.at, self.word, self.depth = [at], word, depth

    def merge(self, other: Interval, depth: int, left: list[int], length: int, times: int, out: list[tuple[int, int, int]]) -> None:
        """Takes in the positions of another child of the interval with ``depth`` shared words, and the pairs between the two."""
        large, small = (self.at, other.at) if len(self.at) >= len(other.at) else (other.at, self.at)
        if self.word is None or other.word is None or self.word != other.word:
            limit, least = depth // (times - 1), length - depth
            for p in small:
                k = bisect_left(large, p)
                if k < len(large) and least <= large[k] - p <= limit and left[p] != left[large[k]]:
                    out.append((p, large[k] - p, depth))
                if k and least <= p - large[k - 1] <= limit and left[p] != left[large[k - 1]]:
                    out.append((large[k - 1], p - large[k - 1], depth))
            self.word = None
        if len(small) * 8 < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
        self.at = large


def _maximal_pairs(order: np.ndarray, shared: np.ndarray, left: list[int], length: int, times: int) -> list[tuple[int, int, int]]:
    """(first position, distance, shared words) of the pairs of one interval tree; ``shared[0]`` is not read."""
    stack: list[Interval] = []
    out: list[tuple[int, int, int]] = []

    def close(depth: int) -> None:
        while len(stack) > 1 and stack[-1].depth >= depth:
            top = stack.pop()
            stack[-1].merge(top, top.depth, left, length, times, out)

    for p, depth in zip(order.tolist(), shared.tolist(), strict=True):
        close(depth)
        stack.append(Interval(p, left[p], depth))
    stack[0].depth = 0
    close(1)
    return out


def find_runs(h: np.ndarray, doc: np.ndarray, length: int = LENGTH, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and smallest period of every run, by first word and period. Words are equal when their hashes are."""
    none = np.zeros(0, np.int64)
    texts = int(doc[-1]) + 1 if len(doc) else 0
    some = np.flatnonzero(hopeful(h, doc, texts, length, times)[doc]) if texts else none
    if not len(some):
        return none, none, none
    own, owner = h[some], doc[some]
    order, shared, word = suffixes(own, owner)
    begins = np.concatenate([[True], owner[1:] != owner[:-1]])
    left = np.concatenate([[0], word[:-1]]).astype(np.int64)
    left[begins] = -1 - np.flatnonzero(begins)
    # Trees of at least so many shared words in which two positions are near enough.
    least = min(max(length, times * q) - q for q in range(1, length + 1))
    tree = np.cumsum(shared < least) - 1
    at = np.lexsort((order, tree))
    gap = np.where(tree[at][1:] == tree[at][:-1], np.diff(order[at]), len(own) + 1)
    first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    edge = np.append(first[1:], len(order))
    nearest = np.minimum.reduceat(np.append(gap, len(own) + 1), first)
    deepest = np.maximum.reduceat(np.where(np.isin(np.arange(len(order)), first), 0, shared), first)
    names = left.tolist()
    pairs: list[tuple[int, int, int]] = []
    for k in np.flatnonzero((edge - first > 1) & (nearest * (times - 1) <= deepest)):
        a, b = first[k], edge[k]
        pairs += _maximal_pairs(order[a:b], shared[a:b], names, length, times)
    if not pairs:
        return none, none, none
    start, period, common = np.array(pairs, np.int64).T
    size = common + period
    order = np.lexsort((period, size, start))
    start, period, size = start[order], period[order], size[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (size[1:] != size[:-1])])
    start, period, size = start[keep], period[keep], size[keep]
    order = np.lexsort((period, start))
    return some[start[order]], size[order], period[order]


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> bytes:
    """The words, with a blank after those that ``more`` follow."""
    size, out = end - start + more, []
    cut = np.searchsorted(np.cumsum(size), np.arange(JOINED, int(size.sum()) + JOINED, JOINED), "right")
    padded = np.append(buf, np.uint8(0x20))
    for a, b in zip(np.concatenate([[0], cut[:-1]]).tolist(), cut.tolist(), strict=True):
        b = max(a, b)
        part = padded[gather(start[a:b], size[a:b])]
        part[(np.cumsum(size[a:b]) - 1)[more[a:b]]] = 0x20
        out.append(part.tobytes())
    return b"".join(out)


def collapse_runs(docs: DataFrame, length: int = LENGTH, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, text`` of every whole text.

    ``runs array<struct<start, length, period>>``: every stretch of at least ``length`` words and ``times`` its smallest period that no
    neighbouring word extends, by first word (from 0) and period. ``text``: the words joined by single blanks, without those that
    any run repeats, that is those in it after its first period. Words are runs of anything but ASCII white space, in their own case.
    A text is judged in one task by itself; nothing is shuffled.

    Cases: a null or empty text has no words, no runs and an empty text. Null ids stay null, repeated rows stay, an empty table
    gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                start, end, doc = words(block, fold=None)
                at = bounds(doc, len(block))
                first, size, period = find_runs(hashes(block, start, end, fold=None), doc, length, times)
                step = np.zeros(len(start) + 1, np.int64)
                np.add.at(step, first + period, 1)
                np.add.at(step, first + size, -1)
                keep = np.flatnonzero(np.cumsum(step)[:-1] == 0)
                more = np.concatenate([doc[keep][1:] == doc[keep][:-1], np.zeros(min(1, len(keep)), bool)])
                data = _joined(block.buf, start[keep], end[keep], more)
                upto = np.concatenate([[0], np.cumsum(end[keep] - start[keep] + more)])
                ends = upto[np.searchsorted(doc[keep], np.arange(len(block) + 1))]
                text = pa.Array.from_buffers(pa.string(), len(block), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                owner = doc[first]
                cut = np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(first - at[owner]), pa.array(size), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.rows], pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(cut), found), text], ["id", "n_words", "runs", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")
