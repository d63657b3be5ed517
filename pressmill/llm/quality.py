"""Quality classification by attention-based multiple-instance learning: a document is a bag of passages, labels are the document's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import Block, blocks, bounds, hashes, sampled, sums, words

PASSAGE = 50  # words of a passage
LEXICAL, SHAPES, STATS = 256, 128, 10
WIDTH = LEXICAL + SHAPES + STATS
CODE, GATE = 24, 16  # encoder and attention dimensions
#: Labelled documents of each class that the model is fitted on, about (whole texts, chosen by a hash of the id).
SAMPLE = 1500
EPOCHS, BATCH, RATE, SHRINK = 14, 48, 0.004, 1e-4
KEEP = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = ord("A"), ord("a"), ord("0"), 0x80


def _set(*ranges: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[r.start : r.stop] = True
    return out


_UPPER, _LOWERS, _DIGIT, _FAR = _set(range(0x41, 0x5B)), _set(range(0x61, 0x7B)), _set(range(0x30, 0x3A)), _set(range(0x80, 0x100))
_PUNCT = _set(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F))


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the first passage of each text (with the end). A text without words has one empty passage."""
    start, end, doc = words(block)
    at = bounds(doc, len(block))
    count = np.maximum(1, -(-np.diff(at) // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    x = np.zeros((n, WIDTH), np.float32)
    if len(start):
        part = first[doc] + (np.arange(len(start)) - at[doc]) // PASSAGE
        h = hashes(block, start, end)
        shape = hashes(block, np.maximum(start, end - 4), end, _SHAPE)
        lex = np.bincount(part * LEXICAL + (h >> np.uint64(40)).astype(np.int64) % LEXICAL, minlength=n * LEXICAL).reshape(n, LEXICAL)
        form = np.bincount(part * SHAPES + (shape >> np.uint64(40)).astype(np.int64) % SHAPES, minlength=n * SHAPES).reshape(n, SHAPES)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        some, size = part[edge[:-1]], np.diff(edge).astype(np.float64)
        x[:, :LEXICAL] = np.sqrt(lex) / 4
        x[:, LEXICAL : LEXICAL + SHAPES] = np.sqrt(form) / 4
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (part[1:] == part[:-1])])
        order = np.lexsort((h, part))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (part[order][1:] != part[order][:-1])])
        span = np.stack([start[edge[:-1]], end[edge[1:] - 1]])
        bytes_ = (span[1] - span[0]).astype(np.float64)

        def share(of: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(of[block.buf])])
            return (total[span[1]] - total[span[0]]) / bytes_

        stats = [
            size / PASSAGE, (sums(end - start, edge) / size) / 10, sums(again, edge) / size, np.bincount(part[order][new], minlength=n)[some] / size,
            share(_UPPER), share(_LOWERS), share(_DIGIT), share(_PUNCT) * 4, share(_FAR), share(_set(range(0x0A, 0x0B))) * 10]
        x[some, LEXICAL + SHAPES :] = np.stack(stats, 1)
    return x, first


def _segment(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1], axis=0)


class Model:
    """Encoder, gated attention and classifier of a bag of passages."""

    def __init__(self, seed: int = 4):
        r = np.random.Generator(np.random.PCG64(seed))
        self.w = {
            "W": r.normal(0, 0.1, (WIDTH, CODE)), "b": np.zeros(CODE), "V": r.normal(0, 0.3, (CODE, GATE)), "U": r.normal(0, 0.3, (CODE, GATE)),
            "a": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, CODE), "d": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, bag = self.w, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["a"]
        e = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
        weight = e / _segment(e, first)[bag]
        z = _segment(weight[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"bag": bag, "h": h, "t": t, "g": g, "weight": weight, "z": z, "p": p}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean weighted cross-entropy."""
        w, f = self.w, self.forward(x, first)
        bag, h, t, g, weight = f["bag"], f["h"], f["t"], f["g"], f["weight"]
        d = (f["p"] - y) * importance / len(y)
        dz = d[:, None] * w["c"]
        da = (h * dz[bag]).sum(1)
        ds = weight * (da - _segment(weight * da, first)[bag])
        dtg = ds[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (weight[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": f["z"].T @ d, "d": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 4) -> Model:
    """Adam over shuffled batches of bags; both classes weigh the same. Without both classes the model stays untrained."""
    model, r = Model(seed), np.random.Generator(np.random.PCG64(seed))
    if len(set(y.tolist())) < 2:
        return model
    importance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m, v, step = {k: 0 * a for k, a in model.w.items()}, {k: 0 * a for k, a in model.w.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = r.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])])
            grad, step = model.gradient(np.concatenate([bags[i] for i in part]), first, y[part], importance[part]), step + 1
            for name, g in grad.items():
                m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.99 * v[name] + 0.01 * g * g
                move = m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
                model.w[name] = (model.w[name] - rate * (move + SHRINK * model.w[name])).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each class. An id with several labels takes the larger; null ids and labels
    are left out, null texts are empty."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = rows.select("id").distinct().join(told, "id")
    chosen = sampled(known, "y", sample).select("id", "y")
    got = rows.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "text").toArrow()
    bags: list[np.ndarray] = []
    for block in blocks(got["text"].combine_chunks()):
        x, first = passages(block)
        bags += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return train(bags, np.array(got["y"].to_pylist(), np.float32))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``id, score, predicted, n_passages, top_passage, top_weight``: probability of label 1 of every whole text, whether it is at
    least ``keep``, and the passage with the most attention.

    Cases: null and empty texts are one passage without words and get its score. A null id stays null, repeated rows are
    scored alike, an empty table gives no rows, other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 20):
                x, first = passages(block)
                out = weights.value.forward(x, first)
                score = out["p"].astype(np.float64)
                order = np.lexsort((-out["weight"], out["bag"]))[first[:-1]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[block.rows], pa.array(score), pa.array((score >= keep).astype(np.int32)), pa.array(np.diff(first)),
                    pa.array(order - first[:-1]), pa.array(out["weight"][order].astype(np.float64))],
                    ["id", "score", "predicted", "n_passages", "top_passage", "top_weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, n_passages bigint, top_passage bigint, top_weight double")


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep``, with their columns. Rows go by themselves, whatever their id."""
    score = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        out = [score.value.forward(*passages(block))["p"] >= keep for block in blocks(texts, 1 << 20)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(good(F.col(text_col)))
