"""Language-model scores from quantised counts in a log-frequency Bloom filter."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import Block, blocks, bounds, hashes, mix, sums, words
from pressmill.session import LONG_ROWS, settle

#: The filter has segments of 2**SEGMENT_BITS bits, SEGMENTS of them or twice as many until all memberships fit: the data alone decide. An
#: n-gram's bits lie in one segment. GROUPED neighbouring segments are built and asked together.
SEGMENTS, SEGMENT_BITS, GROUPED = 256, 16, 64
#: A filter of at most so many bytes is broadcast. A larger one stays a table, which the texts' n-grams meet in a shuffle, with the same answers.
BROADCAST = 128 << 20
KEPT = 48  # bits of an n-gram's hash that the filter keeps; two n-grams that share them are far rarer than a wrong membership
PROBES = 5  # bits of one membership
LEVELS = 48  # largest quantised count
#: Words whose exact counts are broadcast; the counts of all others are met through a shuffled join.
HEAD = 1 << 17
#: Bytes of text whose pairs are counted together, and pairs of a group that wait before they are summed.
COUNTED, SUMMED = 4 << 20, 1 << 20
#: One in SIZING pairs of words, by hash, is counted beforehand to choose the filter's size.
SIZING = 64
PRIOR = 5.0  # weight of the one-word model against the counts of a pair's first word
FLOOR = 0.1  # added to every count of the one-word model
END, BEGIN = np.uint64(0x9D5C1F0A6E3B7281), np.uint64(0x51E77A3C9B2D4F16)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, each text followed by END, and where each text's tokens begin (with the end)."""
    start, end, doc = words(block)
    h = hashes(block, start, end)
    at = bounds(doc, len(block)) + np.arange(len(block) + 1)
    out = np.full(at[-1], END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, at


def pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it (BEGIN before the first)."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = BEGIN
    return mix(before * _PAIR + h)


class Quantiser:
    """Counts in powers of two: level 1 from 1 on, level 2 from 2, level 3 from 4, ... Level 0: never seen."""

    value = np.concatenate([[0.0], (3 * 2.0 ** np.arange(LEVELS) - 1) / 2])  # the middle of a level

    @staticmethod
    def level(count: np.ndarray) -> np.ndarray:
        count = np.maximum(np.asarray(count, np.int64), 0)
        return np.where(count > 0, np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS), 0)


def segments_for(memberships: float) -> int:
    """Smallest SEGMENTS * 2**k parts that the memberships fit, half of their bits set."""
    n = SEGMENTS
    while memberships > n * (1 << SEGMENT_BITS) * math.log(2) / PROBES:
        n *= 2
    return n


def segment_of(gram: np.ndarray, segments: int) -> np.ndarray:
    return (gram >> np.uint64(64 - (segments.bit_length() - 1))).astype(np.int64)


def sliced(gram: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of segments that sorted n-grams lie in, and where each begins (with the end)."""
    group = segment_of(gram, segments) // GROUPED
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
    return group[first], np.append(first, len(group))


def packed(gram: np.ndarray, count: np.ndarray | None = None) -> bytes:
    """Sorted n-grams as differences, byte by byte: the even ones as they are, the high ones and the counts compressed."""
    step = np.diff(gram >> np.uint64(64 - KEPT), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    times = b"" if count is None else count.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<q", len(gram)) + step[:, :4].T.tobytes() + zlib.compress(step[:, 4:].T.tobytes() + times, 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and their counts (none: an empty array)."""
    (n,) = struct.unpack_from("<q", data)
    rest = np.frombuffer(zlib.decompress(data[8 + 4 * n :]), np.uint8)
    step = np.concatenate([np.frombuffer(data, np.uint8, 4 * n, 8).reshape(4, n), rest[: 4 * n].reshape(4, n)])
    count = np.ascontiguousarray(rest[4 * n :].reshape(8, n).T).view("<i8").reshape(-1) if len(rest) > 4 * n else np.zeros(0, np.int64)
    return np.cumsum(np.ascontiguousarray(step.T).view("<u8").reshape(-1), dtype=np.uint64) << np.uint64(64 - KEPT), count


def known_by(gram: np.ndarray) -> np.ndarray:
    """What the filter knows an n-gram by: the first KEPT bits of its hash."""
    return gram & np.uint64((1 << 64) - (1 << (64 - KEPT)))


def places(gram: np.ndarray, level: int, probe: int) -> np.ndarray:
    """Bit of a membership inside its segment."""
    return (mix(gram + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)


class Filter:
    """``bits``: parts of 2**SEGMENT_BITS bits, packed. A level is stored as membership in all levels up to it."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.segments = bits.reshape(-1), len(bits)

    def level(self, gram: np.ndarray, segments: int = 0) -> np.ndarray:
        """Probes level after level until one is absent. Never below the stored level. ``segments``: of the whole filter, where this is one group."""
        gram = known_by(gram)
        out, live = np.zeros(len(gram), np.int64), np.arange(len(gram))
        base = segment_of(gram, segments or self.segments) % self.segments << SEGMENT_BITS
        for level in range(1, LEVELS + 1):
            for probe in range(PROBES):
                bit = base[live] + places(gram[live], level, probe)
                live = live[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                if not len(live):
                    return out
            out[live] = level
        return out


class Model:
    """``filter``: None where it is a table (``parts``) of ``segments`` segments."""

    def __init__(self, words_: int, distinct: int, texts: int, filter_: Filter | None, head: np.ndarray, head_counts: np.ndarray,
                 segments: int = 0, parts: DataFrame | None = None):
        self.words, self.distinct, self.texts = words_, distinct, texts
        self.filter, self.head, self.head_counts = filter_, head, head_counts
        self.segments, self.parts = segments, parts
        self.total = words_ + FLOOR * (distinct + 1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "parts": None}

    def count(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of the words in the head, END included; -1 for others."""
        out = np.full(len(h), -1, np.int64)
        if len(self.head):
            k = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            out = np.where(self.head[k] == h, self.head_counts[k], out)
        out[h == END] = self.texts
        return out

    def probed(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Every n-gram, once and sorted, whose level ``score`` asks for."""
        distinct = np.unique(h)
        return np.union1d(known_by(distinct[self.count(distinct) < 0]), known_by(pairs(h, at)))

    def score(self, h: np.ndarray, at: np.ndarray, level: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 probability of every text: of each token after the one before it, with the one-word model as a prior."""
        distinct, back = np.unique(h, return_inverse=True)
        exact = self.count(distinct)
        seen = np.where(exact >= 0, exact, Quantiser.value[level(distinct)])
        alone = ((seen + FLOOR) / self.total)[back]
        before = np.empty(len(h))
        before[1:] = seen[back][:-1]
        before[at[:-1]] = self.texts
        gram = pairs(h, at)
        distinct, back = np.unique(gram, return_inverse=True)
        both = np.minimum(Quantiser.value[level(distinct)][back], before)
        return sums(np.log10((both + PRIOR * alone) / (before + PRIOR)), at)


def _whole(texts: pa.Array) -> Block:
    """All texts as one block."""
    return next(blocks(texts, 1 << 62))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def fit(training: DataFrame, text_col: str = "text", head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of all whole texts of ``training`` (null: empty), and the exact counts ``h, c`` of all its words.

    Words and pairs are counted in the tasks batch by batch. Words are summed after a shuffle by their hash; the pairs of a batch go out as one packed
    row for each group of segments, whose task sums them and sets the bits. Only a filter of at most BROADCAST bytes, the sums of the sizing
    sample by level and the ``head`` most frequent words reach the driver. The filter has room for all words and pairs, whatever their
    counts; a larger one is written as a table and never gathered.
    """
    spark = training.sparkSession
    texts = training.select(F.col(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), COUNTED):
                h, at = tokens(block)
                gram = pairs(h, at)
                gram = gram[mix(gram) % np.uint64(SIZING) == 0]
                for kind, (keys, n) in enumerate((_counted(h), _counted(gram))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "h", "c"])

    counted = settle(texts.mapInArrow(count_words, "kind int, h bigint, c bigint").groupBy("kind", "h").agg(F.sum("c").alias("c")))
    vocabulary = counted.where(F.col("kind") == 0).select("h", "c")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = vocabulary.where(F.col("h") == int(END.view(np.int64))).first()
    # Number of n-grams by the length of their count in binary; words are stored by the same filter.
    length = F.floor(F.log2(F.col("c").cast("double") + 0.5)).cast("int") + 1
    sizes = {(r.kind, r.bits): r.n for r in counted.groupBy("kind", length.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = segments_for(sum(k * bits * (SIZING if kind else 1) for (kind, bits), k in sizes.items()))
    top = vocabulary.orderBy(F.desc("c"), "h").limit(head).toArrow()
    keys, counts = np.asarray(top["h"]).view(np.uint64), np.asarray(top["c"])
    order = np.argsort(keys)

    def rows_of(gram: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        group, at = sliced(gram, segments)
        data = [packed(gram[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(data, pa.binary())], ["part", "grams"])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), COUNTED):
                yield rows_of(*_counted(known_by(pairs(*tokens(block)))))

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            gram = known_by(rows["h"].to_numpy().view(np.uint64))
            order = np.argsort(gram, kind="stable")
            return rows_of(gram[order], rows["c"].to_numpy()[order])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 1 << 19:
                yield flush()
        if waiting:
            yield flush()

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group, the words of the vocabulary and the pairs apart; counts are summed from time to time."""
        now, bits = -1, None
        held: dict[int, list] = {0: [], 1: []}
        waiting = {0: 0, 1: 0}

        def summed(kind: int) -> tuple[np.ndarray, np.ndarray]:
            gram, count = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            order = np.argsort(gram, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) > 0])[: len(gram)])
            held[kind] = [(gram[order][first], np.add.reduceat(count[order], first))] if len(gram) else []
            waiting[kind] = 0
            return held[kind][0] if held[kind] else (gram, count)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal bits
            if now < 0:
                return
            low = now * GROUPED
            bits = np.zeros((min(GROUPED, segments - low), 1 << SEGMENT_BITS), bool)
            flat = bits.reshape(-1)
            for kind in held:
                if held[kind]:
                    gram, count = summed(kind)
                    level, base = Quantiser.level(count), (segment_of(gram, segments) - low) << SEGMENT_BITS
                    for q in range(1, int(level.max(initial=0)) + 1):
                        some = np.flatnonzero(level >= q)
                        for probe in range(PROBES):
                            flat[base[some] + places(gram[some], q, probe)] = True
                held[kind], waiting[kind] = [], 0
            data = [np.packbits(row, bitorder="little").tobytes() for row in bits]
            yield pa.RecordBatch.from_arrays([pa.array(low + np.arange(len(data), dtype=np.int32)), pa.array(data, pa.binary())], ["segment", "bits"])

        for batch in batches:
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    yield from done()
                    now = part
                gram, count = unpacked(data.as_py())
                waiting[kind] += len(gram) if held[kind] else 0
                held[kind].append((gram, count))
                if waiting[kind] > max(SUMMED, len(held[kind][0][0])):
                    summed(kind)
        yield from done()

    single = vocabulary.select("h", "c").mapInArrow(pack_words, "part int, grams binary").select("part", F.lit(0).alias("kind"), "grams")
    double = texts.mapInArrow(count_pairs, "part int, grams binary").select("part", F.lit(1).alias("kind"), "grams")
    grouped = single.unionByName(double).repartition("part").sortWithinPartitions("part")
    parts = grouped.select("part", "kind", "grams").mapInArrow(set_bits, "segment int, bits binary")
    told = int(n), int(v), int(ends.c) if ends else 0
    if segments << SEGMENT_BITS > 8 * BROADCAST:
        return Model(*told, None, keys[order], counts[order], segments, settle(parts)), vocabulary
    bits = np.zeros((segments, (1 << SEGMENT_BITS) // 8), np.uint8)
    for batch in parts.toArrow().to_batches():
        for s, data in zip(batch["segment"].to_pylist(), batch["bits"], strict=True):
            bits[s] = np.frombuffer(data.as_buffer(), np.uint8)
    return Model(*told, Filter(bits), keys[order], counts[order], segments), vocabulary


def _levels(packed_: DataFrame, parts: DataFrame, known) -> DataFrame:
    """``block, part, levels`` of the n-grams of stored blocks: a block asks each group of segments once, with all its n-grams there, and gets
    one level for each of them in the same order. A task holds one group at a time."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gram = model.probed(*tokens(_whole(texts.values)))
                group, at = sliced(gram, model.segments)
                data = [packed(gram[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(np.full(len(group), block)), pa.array(data, pa.binary())], ["part", "block", "grams"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a group that are in one batch are asked together, so that many small ones cost no more than a large one."""
        now, held, bits = -1, np.zeros((GROUPED, (1 << SEGMENT_BITS) // 8), np.uint8), None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            asking: list[tuple[int, np.ndarray]] = []

            def answer() -> None:
                nonlocal bits
                if asking:
                    bits = bits or Filter(held)
                    level = bits.level(np.concatenate([gram for _, gram in asking]), known.value.segments).astype(np.uint8)
                    for (block, _), own in zip(asking, np.split(level, np.cumsum([len(gram) for _, gram in asking])[:-1]), strict=True):
                        for column, value in zip(out, (block, now, zlib.compress(own.tobytes(), 1)), strict=True):
                            column.append(value)
                asking.clear()

            for part, segment, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if part != now:
                    answer()
                    now, bits = part, None
                    held[:] = 0
                if segment is not None:
                    held[segment % GROUPED], bits = np.frombuffer(data.as_buffer(), np.uint8), None
                    continue
                asking.append((block, unpacked(data.as_py())[0]))
            answer()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["block", "part", "levels"])

    asked = packed_.select("block", "texts").mapInArrow(ask, "part int, block bigint, grams binary").select("part", F.lit(None).cast("int").alias("segment"), "block", "grams")
    held = parts.select(F.floor(F.col("segment") / GROUPED).cast("int").alias("part"), "segment", F.lit(None).cast("bigint").alias("block"), F.col("bits").alias("grams"))
    met = asked.unionByName(held).repartition("part").sortWithinPartitions("part", F.col("segment").isNull())
    return met.mapInArrow(probe, "block bigint, part int, levels binary")


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` of every whole text.

    ``score``: the model's log10 probability; ``base_score``: the one-word model with exact counts; ``n_known``: tokens met in
    training. The frequent words are summed in the map tasks; the others, once for each text, meet the vocabulary in a shuffled join
    (each holds at most 1/HEAD of all tokens).

    Cases: a null or empty text is the end token alone. Null ids stay null, repeated rows are scored alike, an empty table
    gives no rows, an empty training set gives every token the same probability. Other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def judge(ids: pa.Array, row: int, h: np.ndarray, at: np.ndarray, level: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        model, n = known.value, len(at) - 1
        count = model.count(h)
        log = np.where(count >= 0, np.log10((np.maximum(count, 0) + FLOOR) / model.total), 0.0)
        doc = np.repeat(np.arange(n), np.diff(at))
        rare = np.flatnonzero(count < 0)
        order = rare[np.lexsort((h[rare], doc[rare]))]
        new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])[: len(order)])
        cut = np.searchsorted(doc[order[new]], np.arange(n + 1)).astype(np.int32)
        times = np.diff(np.concatenate([new, [len(order)]])).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            ids, pa.array(row + np.arange(n)), pa.array(np.diff(at)), pa.array(sums(count > 0, at)),
            pa.array(sums(log, at)), pa.array(model.score(h, at, level)),
            pa.ListArray.from_arrays(pa.array(cut), pa.array(h[order[new]].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(times))],
            ["id", "row", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield judge(batch.column(0)[block.rows], row, *tokens(block), known.value.filter.level)
                row += len(block)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for block in blocks(batch.column(1), COUNTED):
                ids, texts = (pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), batch.column(k)[block.rows]) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array([row]), ids, texts], ["block", "ids", "texts"])
                row += len(block)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["part"].to_numpy())
        found = left["levels"].combine_chunks()
        found = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zlib.decompress(found[k].as_py()), np.uint8) for k in order.tolist())]).astype(np.int64)
        h, at = tokens(_whole(right["texts"].combine_chunks().flatten()))
        gram = known.value.probed(h, at)
        return pa.Table.from_batches([judge(right["ids"].combine_chunks().flatten(), right["block"][0].as_py(), h, at, lambda wanted: found[np.minimum(np.searchsorted(gram, known_by(wanted)), len(found) - 1)])])

    schema = f"id {kind}, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, times array<int>"
    if model.parts is None:
        told = settle(rows.mapInArrow(run, schema))
    else:
        held = settle(rows.mapInArrow(pack, f"block bigint, ids array<{kind}>, texts array<string>"), **LONG_ROWS)
        told = settle(_levels(held, model.parts, known).groupBy("block").cogroup(held.groupBy("block")).applyInArrow(meet, schema))
    rare = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("_r")).select("row", F.col("_r.rare").alias("h"), F.col("_r.times").alias("times"))
    met = rare.join(vocabulary, "h", "left")
    c = F.coalesce("c", F.lit(0))
    more = met.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10((c + FLOOR) / model.total)).alias("_base"))
    return told.drop("rare", "times").join(more, "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score")
