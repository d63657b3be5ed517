"""Byte-level BPE encoding with character offsets, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import blocks, list_parts
from pressmill.llm.tokens import BLOCK, Decoder, Encoder, cached, rank_tokenizer, shared, spans


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, starts array<int>, ends array<int>``: token ids of every whole text and the characters each covers.

    ``ranks``: a file of byte-level ranks. Every match of the pattern is merged by itself, lowest rank first, without special
    tokens. A token that holds part of a character covers that whole character. Cases: null text = empty text = no ids; a
    null id stays null; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    name, spec = shared(docs.sparkSession, rank_tokenizer(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = cached(f"bpe{name}", lambda: (Encoder(spec.value), Decoder.of(spec.value)))
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                ids, at = encoder(block)
                start, end = spans(block, ids, at, decoder.size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.rows], _lists(ids, at), _lists(start, at), _lists(end, at)], ["id", "ids", "starts", "ends"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(coded: DataFrame, ranks: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, ids, bytes``: the bytes of every list of ids (a null list: none). UTF-8 of the text where ids came from a text."""
    name, spec = shared(coded.sparkSession, rank_tokenizer(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = cached(f"bytes{name}", lambda: Decoder.of(spec.value))
        for batch in batches:
            lists = batch.column(1)
            flat, at = list_parts(lists)
            data, ends = decoder(flat, at)
            out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, out], ["id", "ids", "bytes"])

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, bytes binary")


#: What ``round_trip`` can return beside the id.
KINDS = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "bytes": "binary", "exact": "boolean", "n_tokens": "bigint",
         "ids_sha256": "string", "bytes_sha256": "string"}
WHOLE = ("ids", "starts", "ends", "bytes", "exact")


def _digests(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lower-case hex SHA-256 of the bytes of each part."""
    return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = WHOLE) -> DataFrame:
    """``id`` and the asked ``columns`` in one pass: every text encoded with offsets (``ids, starts, ends``), its ids decoded again
    (``bytes``), and whether those are the text's bytes (``exact``). ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    integers) and ``bytes_sha256`` stand for lists and bytes that nobody needs outside: what is not asked for leaves no task. As ``encode``."""
    name, spec = shared(docs.sparkSession, rank_tokenizer(ranks))
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = cached(f"bpe{name}", lambda: (Encoder(spec.value), Decoder.of(spec.value)))
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                ids, at = encoder(block)
                out = {"n_tokens": pa.array(np.diff(at))}
                if "ids" in columns:
                    out["ids"] = _lists(ids, at)
                if "starts" in columns or "ends" in columns:
                    start, end = spans(block, ids, at, decoder.size)
                    out |= {"starts": _lists(start, at), "ends": _lists(end, at)}
                    del start, end
                if "ids_sha256" in columns:
                    out["ids_sha256"] = _digests(ids.astype("<u4"), at)
                if {"bytes", "exact", "bytes_sha256"} & {*columns}:
                    data, ends = decoder(ids, at)
                    if "exact" in columns:
                        out["exact"] = pa.array([np.array_equal(data[a:b], block.buf[x:y]) for a, b, x, y in zip(ends[:-1], ends[1:], block.at[:-1], block.at[1:], strict=True)])
                    if "bytes" in columns:
                        out["bytes"] = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                    if "bytes_sha256" in columns:
                        out["bytes_sha256"] = _digests(data, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0)[block.rows], *(out[c] for c in columns)], ["id", *columns])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {KINDS[c]}" for c in columns)]))
