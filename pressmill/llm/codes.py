"""Directly addressable codes for token ids, and a table of such segments.

An id is split into chunks of 8 bits, the low chunk first. Level k holds chunk k of every id that has one, and a bitmap that
says which of them go on. A directory holds the number of set bits before every 512 bits, so that the place of an id's next
chunk is one directory entry and the set bits of at most 64 bytes: any id is read without decoding its neighbours.

Segment: magic, number of ids, number of levels; for each level the number of chunks, the chunks, and (but for the last) the
bitmap and its directory. Numbers are little-endian and 64 bits wide, directories 32 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pressmill.llm.blocks import blocks
from pressmill.llm.tokens import BLOCK_IDS, FOLD, Encoder, cached, shared
from pressmill.session import scratch_path

MAGIC = b"DACSEG01"
SUPER = 512
#: Ids after which a segment ends (with the text at hand): bounds the memory of a reader.
SEGMENT = 1 << 19
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The segment of some ids below 2**32."""
    ids = np.asarray(ids, np.uint32)
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        if not more.any():
            levels.append(struct.pack("<q", len(rest)) + chunks)
            break
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (SUPER // 8), np.uint8)])
        ones = _ONES[bitmap].reshape(-1, SUPER // 8).sum(1, dtype=np.int64)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<q", len(rest)) + chunks + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<qq", len(ids), len(levels)) + b"".join(levels)


class Segment:
    """A packed segment, read in place."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a segment")
        self.n, count = struct.unpack_from("<qq", data, 8)
        self.levels, k = [], 24
        for level in range(count):
            (n,) = struct.unpack_from("<q", data, k)
            chunks = np.frombuffer(data, np.uint8, n, k + 8)
            k += 8 + n
            if level == count - 1:
                self.levels.append((chunks, None, None))
                break
            blocks_ = -(-n // SUPER)
            bitmap = np.frombuffer(data, np.uint8, blocks_ * SUPER // 8, k)
            k += len(bitmap)
            self.levels.append((chunks, bitmap, np.frombuffer(data, "<u4", blocks_, k)))
            k += 4 * blocks_

    def __getitem__(self, i: int) -> int:
        """Id number ``i``, without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // SUPER
            before = bitmap[block * SUPER // 8 : i >> 3]
            i = int(directory[block]) + int(_ONES[before].sum()) + int(_ONES[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            low = chunks.astype(np.uint32)
            if bitmap is not None:
                low[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = low
        return value


_SCHEMA = "part int, seq int, first bigint, docs array<bigint>, sizes array<bigint>, n_tokens bigint, payload binary"


def write_codes(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Encodes every whole text and writes the ids, in ascending id of their texts, as a table of segments below ``path``.

    A row of the table is one segment: its part and number in it, the tokens of the part before it, the ids and token counts
    of its texts, and the packed tokens. The rows are dealt by ranges of the id, so part by part and segment by segment the texts ascend. ``end_id`` ends
    each text. A text is never split over segments.

    Cases: null text = empty text (only the end id). Null ids come first. Repeated ids stand beside each other, by text.
    An empty table writes no segment. Other columns are ignored. An id column that is not a number is an error.
    """
    with open(vocabulary, encoding="utf-8") as f:
        key, spec = shared(docs.sparkSession, f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        encoder = cached(f"word{key}", lambda: Encoder(spec.value, fold=FOLD, spaced=True))
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first
            data = pack(np.concatenate(held))
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([list(names)], pa.list_(pa.int64())),
                pa.array([list(sizes)], pa.list_(pa.int64())), pa.array([sum(sizes)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "seq", "first", "docs", "sizes", "n_tokens", "payload"])
            seq, first = seq + 1, first + sum(sizes)
            held.clear(), names.clear(), sizes.clear()
            return row

        full = 0
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK_IDS):
                ids, at = encoder(block)
                for i, name in enumerate(batch.column(0)[block.rows].to_pylist()):
                    held += [ids[at[i] : at[i + 1]], tail]
                    names.append(name)
                    sizes.append(int(at[i + 1] - at[i]) + len(tail))
                    full += sizes[-1]
                    if full >= segment:
                        yield flush()
                        full = 0
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Ranges of the id alone: equal ids stay together. The number of ranges is the session's number of shuffle partitions.
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(path)


#: What ``read_codes`` can return beside the id.
KINDS = {"start": "bigint", "ids": "array<int>", "n_tokens": "bigint", "ids_crc32": "bigint"}


def read_codes(spark, path: str, columns: Sequence[str] = ("start", "ids")) -> DataFrame:
    """``id`` and the asked ``columns``: the texts of a table of segments with the number of ids before each, in the order of the parts.

    A segment knows the tokens before it in its part. The sums over whole parts, one row for each range of the writer, are
    small whatever the input, and broadcast; so payloads are not shuffled. ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit integers) are taken where a segment is unpacked, for readers that need no ids.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    placed = files.join(F.broadcast(parts), "part").select("docs", "sizes", (F.col("_before") + F.col("first")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, sizes, start, payload = (batch.column(k)[r] for k in range(4))
                ids, ends = Segment(payload.as_buffer()).ids(), np.concatenate([[0], np.cumsum(sizes.as_py(), dtype=np.int64)])
                if ends[-1] != len(ids):
                    raise ValueError("a segment's token counts do not add up")
                for a in range(0, len(ends) - 1, 4096):
                    part = ends[a : a + 4097]
                    out = {"start": pa.array(part[:-1] + start.as_py()), "n_tokens": pa.array(np.diff(part))}
                    if "ids" in columns:
                        out["ids"] = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(ids[part[0] : part[-1]].astype(np.int32)))
                    if "ids_crc32" in columns:
                        out["ids_crc32"] = pa.array([zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(part[:-1], part[1:], strict=True)], pa.int64())
                    yield pa.RecordBatch.from_arrays([names.values[a : a + len(part) - 1], *(out[c] for c in columns)], ["id", *columns])

    return placed.mapInArrow(run, ", ".join(["id bigint", *(f"{c} {KINDS[c]}" for c in columns)]))


def token_codes(docs: DataFrame, vocabulary: str, end_id: int | None = 1, path: str | None = None, columns: Sequence[str] = ("start", "ids")) -> DataFrame:
    """Writes the table of segments (below the shared folder unless ``path`` is given) and reads it back. As above."""
    path = path or scratch_path(docs.sparkSession, "codes")
    write_codes(docs, vocabulary, path, end_id)
    return read_codes(docs.sparkSession, path, columns)
