"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import LOWER, Block, blocks, sampled, sums

ORDER = 4  # bytes of the longest context
#: Labelled rows per language that the statistics are taken from, about (whole texts, chosen by a hash of the id).
SAMPLE = 300
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def contexts(block: Block) -> list[np.ndarray]:
    """For every order k from 0 to ORDER, the k bytes before each byte and the byte itself, as one number. Bytes before the
    start of a text count as 0; ASCII letters are taken in lower case."""
    buf = LOWER[block.buf].astype(np.uint64)
    out, gram = [buf], buf
    for k in range(1, ORDER + 1):
        back = np.zeros_like(buf)
        back[k:] = buf[:-k] if k < len(buf) else buf[:0]
        for at in block.at[:-1]:
            back[at : at + k] = 0
        gram = gram | (back << np.uint64(8 * k))
        out.append(gram)
    return out


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


class Table:
    """Finds numbers in a sorted array: one probe of a hashed table, and a search only where two keys share a slot."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.keys = np.uint64(64 - bits), keys
        slot = self._slot(keys)
        self.at = np.full(1 << bits, -1, np.int32)
        self.at[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[self.at[slot] != np.arange(len(keys))]] = True
        self.probe = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))[self.at]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is absent."""
        slot = self._slot(keys)
        found = np.where(self.probe[slot] == keys, self.at[slot], -1)
        again = np.flatnonzero((found < 0) & self.crowded[slot])
        if len(again):
            k = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            found[again] = np.where(self.keys[k] == keys[again], k, -1)
        return found


class Trees:
    """The context trees of all languages with frozen statistics, flattened.

    In a context seen T times with D different next bytes, a byte seen c times costs -log2(c / (T + D)) bits and an escape to
    the next shorter context -log2(D / (T + D)); an unseen context escapes for nothing; below order 0 every byte costs 8.
    ``grams[k]`` holds the full cost per language of every context and byte that some language has seen at order k,
    ``escapes[k]`` the cost per language of leaving each context.
    """

    def __init__(self, languages: list[str], texts: list[pa.Array]):
        self.languages = languages
        counts = [[np.zeros(0, np.uint64)] * (ORDER + 1) for _ in languages]
        sizes = [[np.zeros(0, np.int64)] * (ORDER + 1) for _ in languages]
        for n, column in enumerate(texts):
            parts = [[] for _ in range(ORDER + 1)]
            for block in blocks(column):
                for k, gram in enumerate(contexts(block)):
                    parts[k].append(np.unique(gram, return_counts=True))
            for k, found in enumerate(parts):
                keys, back = np.unique(np.concatenate([x for x, _ in found] or [counts[n][k]]), return_inverse=True)
                counts[n][k] = keys
                sizes[n][k] = np.bincount(back, np.concatenate([c for _, c in found] or [sizes[n][k]]), len(keys)).astype(np.int64)
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        lower = np.full((1, len(languages)), 8.0)
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c[k] for c in counts)]))
            ctx = np.unique(keys >> np.uint64(8)) if k else np.zeros(1, np.uint64)
            escape = np.zeros((len(ctx), len(languages)))
            below = self._cost(keys & _mask(k), k - 1) if k else np.repeat(lower, len(keys), 0)
            cost = np.empty((len(keys), len(languages)))
            where = np.searchsorted(ctx, keys >> np.uint64(8) if k else np.zeros(len(keys), np.uint64))
            for n in range(len(languages)):
                place = np.searchsorted(keys, counts[n][k])
                total = np.bincount(where[place], sizes[n][k], len(ctx))
                kinds = np.bincount(where[place], minlength=len(ctx))
                seen = total > 0
                escape[seen, n] = -np.log2(kinds[seen] / (total + kinds)[seen])
                cost[:, n] = escape[where, n] + below[:, n]
                cost[place, n] = -np.log2(sizes[n][k] / (total + kinds)[where[place]])
            self.grams.append(Table(keys)), self.costs.append(cost.astype(np.float32))
            self.contexts.append(Table(ctx)), self.escapes.append(escape.astype(np.float32))

    def _cost(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Bits of each byte in every language, from order k down. ``gram``: k context bytes and the byte."""
        if k < 0:
            return np.full((len(gram), len(self.languages)), 8, np.float32)
        found = self.grams[k](gram)
        cost = self.costs[k][found] if len(self.costs[k]) else np.zeros((len(gram), len(self.languages)), np.float32)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            rest = gram[lost]
            where = self.contexts[k](rest >> np.uint64(8))
            escape = np.where((where >= 0)[:, None], self.escapes[k][where], np.float32(0))
            cost[lost] = escape + self._cost(rest & _mask(k), k - 1)
        return cost

    def lengths(self, block: Block) -> np.ndarray:
        """Code length in bits of every text of the block in every language."""
        total = np.zeros((len(block), len(self.languages)))
        some = np.flatnonzero(np.diff(block.at))
        if len(some):
            cost = self._cost(contexts(block)[ORDER], ORDER)
            total[some] = np.add.reduceat(cost, block.at[:-1][some], axis=0, dtype=np.float64)
        return total


def has_letter(block: Block) -> np.ndarray:
    """Texts with a letter of any script."""
    found = sums(_ASCII_LETTER[block.buf], block.at) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in block.text(i).decode())
    return found


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Trees:
    """Context trees from about ``sample`` labelled rows of each language. Rows with a null id, text or language are left out."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    chosen = sampled(rows.select("id", "lang"), "lang", sample).distinct()
    got = rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text").toArrow()
    lang, text = np.array(got["lang"].to_pylist(), object), got["text"].combine_chunks()
    names = sorted(set(lang.tolist()))
    return Trees(names, [text.filter(pa.array(lang == name)) for name in names])


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, bits``: the language whose tree codes the whole text in the fewest bits (ties: first by name),
    its share of the probability under equal priors, and the code length.

    Cases: a text that is null or has no letter is ``und`` with score 0, as is every text when no language was learned. A null
    id stays null. An empty table gives no rows. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                known = has_letter(block) & bool(trees.languages)
                name, score, bits = np.full(len(block), UNKNOWN, object), np.zeros(len(block)), np.zeros(len(block))
                if known.any():
                    length = trees.lengths(block)
                    best = length.argmin(1)
                    bits = length.min(1)
                    share = 1 / np.exp2(np.maximum(bits[:, None] - length, -1000)).sum(1)
                    name = np.where(known, np.array(trees.languages, object)[best], UNKNOWN)
                    score, bits = np.where(known, share, 0.0), np.where(known, bits, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[block.rows], pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(bits)], ["id", "lang_pred", "score", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, bits double")
