"""The registered queries and the pipeline over a whole small table, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pressmill.llm import leaks, licences, passages, quality, sanitise
from pressmill.llm.blocks import blocks, hashes, words
from pressmill.llm.tokens import read_ranks
from tests.llm.test_small import LOW, RANKS, WORDS, brute_components, split
from tests.oracle import compare, engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    return {r["doc_id"]: r for r in t}


def rows(spark, name: str) -> dict:
    out = entry.queries()[name](spark, SF).collect()
    got = {r.doc_id: r for r in out}
    assert len(got) == len(out)
    return got


def rest(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


def test_names():
    assert [n for n in entry.queries() if re.match(r"op\d+_", n)] and "pipeline" in entry.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in entry.queries() if re.match(r"op\d+_", n)} == {str(n) for n in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5


def test_exact(spark):
    ok, note = compare(engine("0.001"), entry.queries()["op10_exact_dedup"](spark, SF), entry.oracle_sql()["op10_exact_dedup"])
    assert ok, note


def test_near(spark, texts):
    want = brute_components([(i, r["text"]) for i, r in texts.items()])
    got = rows(spark, "op1_minhash_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_language(spark, texts):
    got = rows(spark, "op3_ppm_language")
    assert set(got) == set(texts) and all(r.held_out == (rest(i, 3) == 1) for i, r in got.items())
    held = [i for i in texts if got[i].held_out and texts[i]["lang"]]
    assert np.mean([got[i].lang_pred == texts[i]["lang"] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality(spark, texts):
    got = rows(spark, "op4_attention_quality")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert set(got) == set(texts) and all(r.held_out == (rest(i, 4) == 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    assert np.mean([got[i].predicted == q for i, q in labels.items() if i in got and got[i].held_out]) >= 0.8


def test_bytes(spark, texts):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    for i, r in rows(spark, "op5_byte_bpe").items():
        ids, data = own.encode_ordinary(texts[i]["text"] or ""), (texts[i]["text"] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest())


def test_licences(spark, texts):
    for i, r in rows(spark, "op6_licence_scan").items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[i]["text"] or "").translate(LOW))
        found = [(k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert {x for _, x in found} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_language_model(spark, texts):
    token = {i: [*split(r["text"]), None] for i, r in texts.items()}
    c = collections.Counter(w for i, t in token.items() if rest(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    got = rows(spark, "op7_bloom_language_model")
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token[i])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(token[i]), sum(c[w] > 0 for w in token[i]), n, rest(i, 10) == 0)
        assert abs(r.base_score - base) < 1e-8 * max(1, abs(base)) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_codes(spark, texts):
    whole, start = Tokenizer.from_file(WORDS), 0
    got = rows(spark, "op8_token_codes")
    for i in sorted(texts):
        ids = [*whole.encode(texts[i]["text"] or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_passages(spark, texts):
    """Every document that repeats 51 words of an earlier one loses text, and nothing shorter than LEAST words goes."""
    first, want = {}, set()
    for i in sorted(texts):
        w = re.findall(sanitise._WORD, (texts[i]["text"] or "").translate(LOW))
        for k in range(len(w) - 50):
            if first.setdefault(tuple(w[k : k + 51]), i) != i:
                want.add(i)
    got = rows(spark, "op9_sentence_spans")
    assert want <= set(got) and all(r.n_words >= passages.LEAST for r in got.values())


def copies(texts: dict) -> set:
    """(document, item) pairs whose alignment over the whole text reaches the score."""
    found = set()
    items = []
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        block = next(blocks(pa.array([r["text"]])))
        items.append((r["item_id"], hashes(block, *words(block)[:2])))
    for i, r in texts.items():
        block = next(blocks(pa.array([r["text"] or ""])))
        h = hashes(block, *words(block)[:2])
        for item, w in items:
            if len(h) and 2 * np.isin(w, h).sum() >= leaks.SCORE * 2 * len(w) and leaks.align(w, h)[0] >= leaks.SCORE * 2 * len(w):
                found.add((i, item))
    return found


def test_benchmark(spark, texts):
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op2_benchmark_decontamination"](spark, SF).collect()}
    assert got == copies(texts)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = quality.fit(docs, labels)
    left = {i: r for i, r in texts.items() if model.forward(*quality.passages(next(blocks(pa.array([r["text"] or ""])))))["p"][0] >= quality.KEEP}
    last = {r["text"]: i for i, r in sorted(left.items())}
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i, (_, c) in brute_components([(i, r["text"]) for i, r in left.items()]).items() if i == c}
    leaked = {i for i, _ in copies(left)}
    left = {i: r for i, r in left.items() if i not in leaked}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: own.encode_ordinary(r["text"]) for i, r in left.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got) and 0 < len(got) < len(texts)
