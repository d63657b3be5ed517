"""Substring deduplication over sliding runs of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import MARKS, Block, blocks, bounds, hashes, mix, words
from pressmill.session import settle

#: A run is the shortest one from its sentence on, or up to its sentence, with so many sentences and words.
SENTENCES, WORDS = 2, 25
#: Of any CUT neighbouring words inside a sentence it is cut after the one with the smallest hash, whatever surrounds them. So the first
#: cut of a passage's copies is at most CUT words from its start, and cuts are alike from there to CUT words before its end: any
#: passage of WORDS + 3 * CUT - 1 words, wherever it begins, holds a run.
CUT = 8
#: Words of a stretch that is removed, at least. Repeated runs cover all but 2 * CUT words of a passage, so one of LEAST + 2 * CUT words always goes.
LEAST = 35

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


class Sentences:
    """Sentences of a block's texts: ``start`` (byte of the first word), ``doc``, ``first``/``last`` (words), in the texts' order.

    Words are letters and digits, in lower case; ASCII marks between them do not count. A sentence ends at a word that one ``.``, ``!``
    or ``?`` follows (marks set twice, as ornaments are, end none), at a line end and at the end of its text; CUT divides it further.
    """

    def __init__(self, block: Block):
        start, end, doc = words(block, apart=MARKS)
        self.hash = hashes(block, start, end)
        if not len(start):
            self.start = self.doc = self.first = self.last = np.zeros(0, np.int64)
            return
        lines = np.concatenate([[0], np.cumsum(block.buf == 0x0A)])
        mark = np.concatenate([block.buf, np.zeros(2, np.uint8)])
        stop = _STOP[mark[end]] & (mark[end] != mark[end + 1]) & (end < block.at[doc + 1])
        stop[:-1] |= (doc[1:] != doc[:-1]) | (lines[start[1:]] > lines[end[:-1]])
        stop[-1] = True
        if len(stop) >= CUT:
            ends = np.concatenate([[0], np.cumsum(stop)])
            inside = np.flatnonzero(ends[CUT - 1 : -1] == ends[: -CUT])
            stop[inside + np.lib.stride_tricks.sliding_window_view(self.hash, CUT)[inside].argmin(1)] = True
        self.last = np.flatnonzero(stop) + 1
        self.first = np.concatenate([[0], self.last[:-1]])
        self.start, self.doc = start[self.first], doc[self.first]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, sentences and hash of the words of every run: the shortest from each sentence on and the shortest up to each."""
        n = len(self.first)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        k = np.arange(n)
        end = np.maximum(k + SENTENCES, np.searchsorted(self.last, self.first + WORDS) + 1)
        limit = np.searchsorted(self.doc, self.doc, "right")
        at = np.flatnonzero(end <= limit)
        end = end[at]
        # Up to a sentence where the shortest run from none ends: from the last sentence whose own run ends before, in the same text.
        bare = np.ones(n + 1, bool)
        bare[end] = False
        bare = np.flatnonzero(bare)
        source = np.searchsorted(end, bare) - 1
        bare, source = bare[source >= 0], source[source >= 0]
        same = self.doc[at[source]] == self.doc[bare - 1]
        at, end = np.concatenate([at, at[source[same]]]), np.concatenate([end, bare[same]])
        up = np.full(len(self.hash) + 1, _BASE, np.uint64)
        down = np.full(len(self.hash) + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * np.multiply.accumulate(up)[:-1])])
        a, b = self.first[at], self.last[end - 1]
        h = mix((total[b] - total[a]) * np.multiply.accumulate(down)[a] + (b - a).astype(np.uint64))
        return at, end - at, h


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, key``: with the id, the text's hash tells one document from another."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, pos, n, first_id``: every run of sentences (from number ``pos``, ``n`` sentences) that is not the first with its words,
    and the document of the first one, the smallest by id, text (``key``: its hash) and position."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                s = Sentences(block)
                at, n, h = s.runs()
                doc = s.doc[at]
                pos = at - bounds(s.doc, len(block))[doc]
                # A run has at most WORDS + SENTENCES sentences, because each has a word.
                place = pos * (WORDS + SENTENCES + 1) + n
                owner = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column(0)[block.rows].take(owner), batch.column(2)[block.rows].take(owner), pa.array(place)], ["h", "id", "key", "place"])

    spans = rows.mapInArrow(run, f"h bigint, id {kind}, key bigint, place bigint")
    who = F.struct("id", "key", "place")
    # Stored, so that both sides of the join are plain shuffles and a frequent run can be split.
    first = settle(spans.groupBy("h").agg(F.min(who).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "first"))
    base = WORDS + SENTENCES + 1
    return spans.join(first, "h").where(~who.eqNullSafe(F.col("first"))).select(
        "id", "key", F.floor(F.col("place") / base).cast("int").alias("pos"), (F.col("place") % base).cast("int").alias("n"), F.col("first.id").alias("first_id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, removed, n_words, first_ids``: the documents that lose text. ``text``: without the sentences that any repeated run covers
    but for its first occurrence in the corpus, where they cover LEAST words on end; ``removed``: character spans of the whole text;
    ``first_ids``: where the document's repeated runs stay.

    The shortest run of sentences (at least SENTENCES of them and WORDS words) from every sentence on and up to every sentence is hashed:
    together they cover each longer run that is repeated, to its last word. The hashes meet in one aggregate
    with partial sums (smallest id and position of each), and runs join the repeated ones. Words are compared in lower case;
    white space and ASCII marks do not count.

    Cases: texts that are null, empty or shorter than a run lose nothing and are not returned. A text may lose all. Those with null ids are
    documents that come first. Rows that repeat an id and text are one document, rows that repeat an id with other texts are documents
    of their own. An empty table gives no rows. Other columns are ignored.
    """
    gone = repeated_runs(docs, id_col, text_col).groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("pos", "n")).alias("runs"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    hit = rows.join(gone, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select("id", "text", "runs.pos", "runs.n", "first_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                s = Sentences(block)
                at = bounds(s.doc, len(block))
                edge = np.append(s.start, len(block.buf))
                chars = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
                part = batch.slice(block.rows.start, len(block))
                out: tuple[list, ...] = ([], [], [], [])
                for i in range(len(block)):
                    lo, hi = at[i], at[i + 1]
                    cover = np.zeros(hi - lo + 1, np.int64)
                    pos, n = np.array(part.column(2)[i].as_py(), np.int64), np.array(part.column(3)[i].as_py(), np.int64)
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + n, -1)
                    off = np.cumsum(cover)[:-1] > 0
                    step = np.flatnonzero(np.diff(np.concatenate([[0], off.astype(np.int8), [0]])))
                    for a, b in zip(step[::2], step[1::2], strict=True):
                        off[a:b] = s.last[lo + b - 1] - s.first[lo + a] >= LEAST
                    ends = np.append(edge[lo + 1 : hi], block.at[i + 1])
                    step = np.flatnonzero(np.diff(np.concatenate([[0], off.astype(np.int8), [0]])))
                    spans = [(int(edge[lo + a]), int(ends[b - 1])) for a, b in zip(step[::2], step[1::2], strict=True)]
                    kept, last = [], int(block.at[i])
                    for a, b in spans:
                        kept.append(block.buf[last:a].tobytes())
                        last = b
                    kept.append(block.buf[last : block.at[i + 1]].tobytes())
                    base = int(chars[block.at[i]])
                    out[0].append(b"".join(kept).decode())
                    out[1].append([int(chars[a]) - base for a, _ in spans])
                    out[2].append([int(chars[b]) - base for _, b in spans])
                    out[3].append(int((s.last[lo:hi] - s.first[lo:hi])[off].sum()))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out[0], pa.string()), pa.array(out[1], lists), pa.array(out[2], lists), pa.array(out[3], pa.int64()), part.column(4)],
                    ["id", "text", "starts", "ends", "n_words", "first_ids"])

    done = hit.mapInArrow(run, f"id {kind}, text string, starts array<bigint>, ends array<bigint>, n_words bigint, first_ids array<{kind}>")
    return done.where("n_words > 0").select("id", "text", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("removed"), "n_words", "first_ids")
