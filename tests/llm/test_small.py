"""Each operator against a brute-force version on small rows, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressmill import session
from pressmill.llm import bpe, codes, exact, langid, leaks, licences, lm, near, passages, quality
from pressmill.llm.blocks import blocks, grams, hashes, tune, words
from pressmill.llm.graph import components
from pressmill.llm.tokens import BLOCK, Decoder, Encoder, pieces, rank_tokenizer, read_ranks, spans

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def split(text: str | None) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if w]


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        word = "".join("aeioubcdfglmnprst"[int(c)] for c in str(r.randrange(vocabulary) * 7919 % 99991))
        out.append(word + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def edited(text: str, seed: int, every: int) -> str:
    parts = text.split(" ")
    for k in range(seed % every, len(parts), every):
        parts[k] = f"zz{seed}x{k}"
    return " ".join(parts)


LONG = prose(99, 30_000)
ODD = [None, "", "   \t\n", "one", "Two words", "ÄÖ　ñ\x85é 日本語", "a\x00b", "!!! ???", LONG, "x" * 50_000, "\x1c\x1f", "٣٤ ½ Ⅷ"]


@pytest.fixture(scope="module")
def rows():
    base = [prose(k, 40 + 13 * (k % 7)) for k in range(60)]
    texts = [*base, *base[:12], *(edited(t, k, 40) for k, t in enumerate(base[:20])), *(edited(t, k, 12) for k, t in enumerate(base[:20])), *ODD, *ODD]
    return [(k * 3 % 1009, t, ["en", "de", None][k % 3], "s", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    tune(spark)
    odd = [(None, "null id text one two three four five", "en", None, None), (None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame([*rows, *odd], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(docs):
    """Columns of other names, among them those that operators use inside."""
    names = ["id", "h", "n", "key", "bands", "odd", "gone_id", "_gone_id", "digest", "row", "label", "bucket"]
    return docs.select("*", *(F.lit(7).alias(c) for c in names))


# --- blocks


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_words_and_hashes(rows, limit):
    texts = [r[1] for r in rows]
    found, names = [], {}
    for block in blocks(pa.array(texts, pa.string()), limit):
        start, end, doc = words(block)
        h = hashes(block, start, end)
        got = [[] for _ in range(len(block))]
        for a, b, d, x in zip(start, end, doc, h, strict=True):
            word = block.buf[a:b].tobytes().decode().translate(LOW)
            assert names.setdefault(word, x) == x
            got[d].append(word)
        found += got
    assert found == [split(t) for t in texts]
    assert len(set(names.values())) == len(names)


def test_grams_stay_in_their_text():
    block = next(blocks(pa.array(["a b c d", "b c", "b c d a"])))
    start, end, doc = words(block)
    pos, g = grams(hashes(block, start, end), doc, 3)
    assert pos.tolist() == [0, 1, 6, 7] and g[1] == g[2] and len(set(g.tolist())) == 3


# --- exact


def test_exact_groups(docs):
    got = exact.exact_groups(clash(docs)).collect()
    want = collections.defaultdict(list)
    for r in docs.collect():
        want[r.text or ""].append(r.doc_id)
    assert len(got) == docs.count()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by_digest[r.digest]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.id == keep)


@pytest.mark.parametrize("share", [1 / 4, 1 / 256])
def test_exact_heavy_digests(spark, share):
    data = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('warm', id % 5) ELSE concat('t', id) END AS text")
    got = exact.exact_groups(data, share=share)
    want = data.groupBy("text").agg(F.max("doc_id").alias("k"), F.count("*").alias("g"))
    same = data.join(want, "text").join(got, F.col("doc_id") == F.col("id")).where("k = keep_id AND g = group_size AND kept = (doc_id = k)")
    assert same.count() == 4000 == got.count()


def test_dedup_keeps_columns(docs, empty):
    kept = exact.exact_dedup(clash(docs))
    assert kept.columns == clash(docs).columns
    text = F.coalesce("text", F.lit("")).alias("t")
    assert kept.select(text).distinct().count() == docs.select(text).distinct().count()
    for operator in (exact.exact_groups, exact.exact_dedup, near.near_groups, near.near_dedup):
        assert operator(empty).count() == 0


# --- near


def brute_components(rows) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t, *_ in rows:
        w = split(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(docs, rows):
    want = brute_components(rows)
    got = near.near_groups(clash(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n, r.component_id) == want[r.id] and r.kept == (r.id == r.component_id)
    assert any(i != c for i, (_, c) in want.items())
    left = near.near_dedup(clash(docs))
    assert left.columns == clash(docs).columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {None, *(i for i, (_, c) in want.items() if i == c)}


def test_near_mixed_buckets(spark):
    """Many texts share a passage, so that buckets mix components, and near copies link in chains through later leaders."""
    shared = prose(1, 60)
    data = []
    for g in range(25):
        base = shared + " " + prose(100 + g, 50)
        data += [(g * 10 + k, edited(base, g * 7 + k, 60) if k else base) for k in range(4)]
    data = [(i, t) for i, t in data]
    want = brute_components(data)
    got = near.near_groups(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.id: (r.n, r.component_id) for r in got} == want


def test_odd_sketch_bound():
    """Pairs at the threshold pass the sketch."""
    r = np.random.default_rng(5)
    for _ in range(20):
        common, a, b = r.integers(0, 1 << 63, 600, dtype=np.uint64), r.integers(0, 1 << 63, 100, dtype=np.uint64), r.integers(0, 1 << 63, 100, dtype=np.uint64)
        g, d = np.concatenate([common, a, common, b]), np.repeat([0, 1], 700)
        _, keys, odd = near.sketches(g, d, 2)
        apart = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        assert apart <= near.most_bits() and keys.shape == (2, near.BANDS)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- decontamination


def test_alignment_equals_the_full_table():
    r = random.Random(2)
    for _ in range(200):
        a, b = [[r.randrange(6) for _ in range(r.randint(1, n))] for n in (12, 20)]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        best, lo, hi = leaks.align(np.array(a), np.array(b))
        assert best == max(map(max, h))
        if best:
            assert best == leaks.align(np.array(a), np.array(b[lo:hi]))[0]


def test_find_copies(spark, docs, empty):
    items = [(k, prose(500 + k, 20 + k)) for k in range(12)] + [(90, None), (91, ""), (92, "too short"), (3, prose(503, 23))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plant = [(9000 + k, prose(k, 30) + " " + edited(items[k][1], k, 9) + " " + prose(k + 50, 30)) for k in range(12)]
    plant += [(9100, items[0][1].upper()), (9101, prose(7, 60) + " " + items[5][1] + " " + items[6][1]), (9102, " ".join(items[2][1].split(" ")[:8]))]
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame(plant, "doc_id bigint, text string"))
    got = leaks.find_copies(clash(own), bench).collect()
    assert {(r.id, r.item_id) for r in got} == {*((9000 + k, k) for k in range(12)), (9100, 0), (9101, 5), (9101, 6)}
    texts = dict(plant)
    for r in got:
        assert 0.5 <= r.score <= 1 and (r.id != 9101 or split(texts[r.id][r.start : r.end]) == split(items[r.item_id][1]))
    left = leaks.decontaminate(clash(own), bench)
    assert left.columns == clash(own).columns and left.count() == docs.count() + 1
    assert leaks.find_copies(empty, bench).count() == 0 and leaks.find_copies(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("every", [3, 4, 5, 6])
def test_copies_without_intact_runs(spark, every):
    items = [(k, prose(800 + k, 18 + 3 * k)) for k in range(12)]
    plant = [(k, prose(k, 200) + " " + edited(t, k, every) + " " + prose(k + 50, 200)) for k, t in items]
    plant += [(100 + k, prose(k, 30) + " " + " ".join(f"{w} zz{j}" for j, w in enumerate(t.split(" ")))) for k, t in items]
    got = leaks.find_copies(spark.createDataFrame(plant, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {}
    for i, text in plant:
        h = np.array([zlib.crc32(w.encode()) for w in split(text)])
        for k, item in items:
            w = np.array([zlib.crc32(x.encode()) for x in split(item)])
            score = leaks.align(w, h)[0] / (leaks.MATCH * len(w))
            if score >= leaks.SCORE:
                want[i, k] = score
    assert {(r.id, r.item_id): r.score for r in got} == want and len(want) >= 12


def test_copies_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PASS_BYTES", 300)
    items = [(k, prose(700 + k, 25)) for k in range(20)]
    own = spark.createDataFrame([(k, prose(k, 20) + " " + items[k][1]) for k in range(20)], "doc_id bigint, text string")
    got = leaks.find_copies(own, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.id, r.item_id) for r in got) == [(k, k) for k in range(20)]


# --- tokens


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def mixed_texts(n: int) -> list[str]:
    r = random.Random(8)
    alphabet = "ab'sreLl .,!\n\t 　é日1٣🙂́\x1c​_-\x85\x0b"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_byte_bpe(docs, empty, reference):
    got = bpe.round_trip(clash(docs), RANKS).collect()
    want = collections.Counter((r.doc_id, tuple(reference.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert collections.Counter((r.id, tuple(r.ids), bytes(r.bytes)) for r in got) == want and all(r.exact for r in got)
    some = bpe.round_trip(docs, RANKS, columns=("ids_sha256", "n_tokens", "bytes_sha256", "ids")).collect()
    assert collections.Counter((r.id, tuple(r.ids)) for r in some) == collections.Counter((i, x) for i, x, _ in want.elements())
    assert all((r.ids_sha256, r.n_tokens) == (hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), len(r.ids)) for r in some)
    assert collections.Counter(r.bytes_sha256 for r in some) == collections.Counter(hashlib.sha256(b).hexdigest() for _, _, b in want.elements())
    apart = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert collections.Counter(bytes(r.bytes) for r in apart.collect()) == collections.Counter(b for _, _, b in want.elements())
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_encoder_and_offsets(reference):
    spec = rank_tokenizer(RANKS)
    encoder, decoder = Encoder(spec), Decoder.of(spec)
    for block in blocks(pa.array(mixed_texts(1500)), BLOCK):
        ids, at = encoder(block)
        start, end = spans(block, ids, at, decoder.size)
        for i in range(len(block)):
            text = block.text(i).decode()
            assert ids[at[i] : at[i + 1]].tolist() == reference.encode_ordinary(text)
            own = encoder.tokenizer.encode(text, add_special_tokens=False).offsets
            assert list(zip(start[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist(), strict=True)) == own


def test_pieces_of_words(monkeypatch):
    monkeypatch.setattr("pressmill.llm.tokens.REMEMBERED", 9000)
    monkeypatch.setattr("pressmill.llm.tokens.LONGEST", 6)
    monkeypatch.setattr("pressmill.llm.tokens.AT_ONCE", 7)
    from pressmill.llm.tokens import FOLD

    with open(WORDS) as f:
        encoder = Encoder(f.read(), fold=FOLD)
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    texts = mixed_texts(1500) + ["It's WE'RE they'll", "= ̸", "Å b", "ΣΑΣ σας", "<|endoftext|> x"]
    for block in blocks(pa.array(texts), 2000):
        ids, at = encoder(block)
        assert pieces(block)[0][-1] == len(block.buf)
        for i in range(len(block)):
            assert ids[at[i] : at[i + 1]].tolist() == whole.encode(block.text(i).decode(), add_special_tokens=False).ids


# --- codes


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 60_000, 7)), [1] * 2000])
def test_segment(ids):
    segment = codes.Segment(codes.pack(np.array(ids, np.uint32)))
    assert segment.ids().tolist() == ids and segment.n == len(ids)
    for i in range(0, len(ids), 37):
        assert segment[i] == ids[i]
    with pytest.raises(IndexError):
        segment[len(ids)]


def test_token_codes(spark, docs, empty, tmp_path):
    whole = Tokenizer.from_file(WORDS)
    codes.write_codes(clash(docs), WORDS, str(tmp_path / "c"), segment=3000)
    got = codes.read_codes(spark, str(tmp_path / "c"), ("start", "n_tokens", "ids", "ids_crc32"))
    assert spark.read.parquet(str(tmp_path / "c")).count() > 3
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert codes.read_codes(spark, str(tmp_path / "c")).columns == ["id", "start", "ids"]
    start, want = 0, collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    texts = collections.defaultdict(list)
    for (i, t), n in want.items():
        texts[i] += [tuple(whole.encode(t, add_special_tokens=False).ids) + (1,)] * n
    assert [r.id for r in rows] == sorted((i for i, _ in want.elements()), key=lambda i: (i is not None, i))
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts[r.id].remove(tuple(r.ids))
        start += len(r.ids)
    codes.write_codes(empty, WORDS, str(tmp_path / "e"))
    assert codes.read_codes(spark, str(tmp_path / "e")).count() == 0


# --- language


def test_code_lengths_by_hand():
    texts = {"a": ["abab abba", "cab"], "b": ["xyz zyx", "aba"]}
    trees = langid.Trees(list(texts), [pa.array(t) for t in texts.values()])

    def bits(lang: str, text: str) -> float:
        seen = collections.defaultdict(collections.Counter)
        for t in texts[lang]:
            padded = "\0" * langid.ORDER + t
            for i in range(langid.ORDER, len(padded)):
                for k in range(langid.ORDER + 1):
                    seen[padded[i - k : i]][padded[i]] += 1
        total, padded = 0.0, "\0" * langid.ORDER + text
        for i in range(langid.ORDER, len(padded)):
            for k in range(langid.ORDER, -2, -1):
                if k < 0:
                    total += 8
                    break
                c = seen[padded[i - k : i]] if padded[i - k : i] in seen else None
                if c and padded[i] in c:
                    total -= math.log2(c[padded[i]] / (sum(c.values()) + len(c)))
                    break
                if c:
                    total -= math.log2(len(c) / (sum(c.values()) + len(c)))
        return total

    sample = ["abba", "zyx aba", "", "qqq", "a"]
    block = next(blocks(pa.array(sample)))
    assert np.allclose(trees.lengths(block), [[bits(lang, t) for lang in texts] for t in sample], rtol=1e-5)


def test_identify(spark, docs, empty):
    r = random.Random(4)
    say = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwölf", "jäger", "über", "straße"]}
    data = [(k, " ".join(r.choice(say[lang]) for _ in range(30)), lang) for k in range(80) for lang in [["aa", "bb"][k % 2]]]
    labelled = spark.createDataFrame([*data, (None, "x", "aa"), (900, None, "bb"), (901, "y", None)], "doc_id bigint, text string, lang string")
    trees = langid.fit(labelled.where("doc_id < 40 OR doc_id >= 900 OR doc_id IS NULL"), sample=10)
    assert trees.languages == ["aa", "bb"]
    got = {r.id: r for r in langid.identify(labelled.where("doc_id IS NOT NULL"), trees).collect()}
    assert all(got[k].lang_pred == lang and 0.9 < got[k].score <= 1 for k, _, lang in data)
    odd = langid.identify(clash(docs), trees)
    assert odd.count() == docs.count()
    blank = odd.join(docs.select("doc_id", "text"), F.col("id") == F.col("doc_id")).where("text IS NULL OR text RLIKE '^[^\\\\p{L}]*$'").select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in blank] == [("und", 0.0)]
    assert langid.identify(empty, trees).count() == 0
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


# --- quality


def test_gradient():
    r = np.random.default_rng(1)
    model = quality.Model()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, first, y, weight = r.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss() -> float:
        p = model.forward(x, first)["p"]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grad = model.gradient(x, first, y, weight)
    for name, w in model.w.items():
        flat = w.reshape(-1)
        for k in r.integers(0, len(flat), 4):
            old, step = flat[k], 1e-5
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - grad[name].reshape(-1)[k]) < 1e-5


def test_classify(spark, docs, empty):
    good = [(k, prose(k, 150), 1) for k in range(120)]
    bad = [(1000 + k, prose(k, 90) + " " + " ".join(w.upper() + "!!" for w in prose(k, 60).split(" ")), 0) for k in range(120)]
    data = spark.createDataFrame([*good, *bad], "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([*((i, y) for i, _, y in good + bad if i % 4), (None, 1), (1, None), (77777, 0)], "doc_id bigint, quality int")
    model = quality.fit(data, labels, sample=100)
    got = {r.id: r for r in quality.classify(data, model).collect()}
    held = [(i, y) for i, _, y in good + bad if i % 4 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert all(got[i].top_passage >= 1 for i, y in held if not y) and got[0].n_passages == 3
    odd = quality.classify(clash(docs), model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert len({r.score for r in odd if r.n_passages == 1 and r.id in {3 * k % 1009 for k in (112, 113, 114)}}) == 1  # null, empty, blank
    kept = quality.keep_good(clash(docs), model)
    assert kept.columns == clash(docs).columns and kept.count() == sum(r.predicted for r in odd)
    assert quality.classify(empty, model).count() == 0 and quality.fit(empty, labels).w is not None


# --- licences


def test_automaton_matching_statistics():
    r = random.Random(6)
    for _ in range(60):
        sequences = [[r.randrange(4) for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 5))]
        runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        auto, state, matched, read = licences.Automaton(sequences), 0, 0, []
        for _ in range(50):
            read.append(r.randrange(5))
            state, matched = auto.step(state, matched, read[-1])
            want = max((n for n in range(len(read) + 1) if tuple(read[len(read) - n :]) in runs), default=0)
            assert matched == want
            whole = {k for k, s in enumerate(sequences) if s and read[-len(s) :] == s}
            assert {k for k, n in auto.whole[state] if matched >= n} == whole
            if matched:
                held = {k for k, s in enumerate(sequences) if any(s[a : a + matched] == read[len(read) - matched :] for a in range(len(s)))}
                assert set(auto.ends[state]) == held
                for k, upto in auto.ends[state].items():
                    assert sequences[k][upto - matched : upto] == read[len(read) - matched :]


def test_scan(spark, docs, empty):
    phrases = [(p.split(), label) for p, label in licences.PHRASES]
    r = random.Random(9)
    pool = "under the mit license apache version 2 cc by nc x under-the license,".split(" ")
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(300)]
    mit = licences.TEMPLATES[0][1]
    texts += [prose(3, 40) + " " + mit + " " + prose(4, 40), mit.upper().replace("FREE OF CHARGE", "AT NO COST"), "Under the MIT\nLicense. CC-BY-NC"]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.id: x for x in licences.scan(clash(data)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        want = sorted((k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p)
        assert got[i].n_words == len(w) and sorted((p.word, p.label) for p in got[i].places) == want
    assert [(s.label, s.start, s.covered) for s in got[300].spans] == [("mit", 40, 1.0)] and "mit" in {s.label for s in got[301].spans} and got[301].score < 1
    odd = licences.scan(docs).collect()
    assert len(odd) == docs.count() and all(not x.places and x.score == 0 for x in odd)
    assert licences.scan(empty).count() == 0


# --- language model


def test_scores(docs, empty):
    rows = docs.collect()
    training = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10]
    tokens = lambda t: [*split(t), None]
    c = collections.Counter(w for r in training for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    pair = collections.Counter((a, b) for r in training for a, b in zip(["", *tokens(r.text)], tokens(r.text), strict=False))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(-1))
    model, vocabulary = lm.fit(docs.where(held != 0), head=40)
    assert (model.words, model.distinct, model.texts) == (n, v, len(training))
    assert sum(r.c for r in vocabulary.collect()) == n
    got = collections.defaultdict(list)
    for r in lm.score(clash(docs), model, vocabulary).collect():
        got[r.id].append(r)
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want = (len(t), sum(c[w] > 0 for w in t))
        assert any((x.n_tokens, x.n_known) == want and abs(x.base_score - base) < 1e-8 * max(1, abs(base)) for x in got[r.doc_id])
    block = next(blocks(pa.array(["zz yy"])))
    for r in rows[:20]:
        block = next(blocks(pa.array([r.text or ""])))
        h, at = lm.tokens(block)
        gram, t = lm.pairs(h, at), tokens(r.text)
        level = model.filter.level(gram)
        true = lm.Quantiser.level(np.array([pair[a, b] for a, b in zip(["", *t], t, strict=False)]))
        assert (level >= true).all() and (level == true).mean() > 0.9
    assert lm.score(empty, model, vocabulary).count() == 0
    blank, none = lm.fit(empty)
    assert blank.words == 0 and lm.score(docs, blank, none).count() == docs.count()


def test_scores_with_a_filter_in_parts(docs, empty, monkeypatch):
    """A filter that is not broadcast gives the same scores."""
    key = lambda rows: sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    model, vocabulary = lm.fit(docs, head=40)
    want, segments = key(lm.score(clash(docs), model, vocabulary).collect()), model.segments
    assert model.filter is not None
    monkeypatch.setattr(lm, "BROADCAST", 1)
    monkeypatch.setattr(lm, "COUNTED", 20_000)
    monkeypatch.setattr(lm, "SUMMED", 100)
    model, vocabulary = lm.fit(docs, head=40)
    assert model.filter is None and model.segments == segments
    assert key(lm.score(clash(docs), model, vocabulary).collect()) == want
    assert lm.score(empty, model, vocabulary).count() == 0


def test_stored_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """Blocks of texts are long rows: a page of a hundred of them, as by default, is held whole by its writer and its reader."""
    import pyarrow.parquet as pq

    kept = []
    monkeypatch.setattr(lm, "settle", lambda df, **options: kept.append(session.settle(df, **options)) or kept[-1])
    monkeypatch.setattr(lm, "BROADCAST", 1)
    monkeypatch.setattr(lm, "COUNTED", 1 << 16)
    monkeypatch.setattr(lm, "LONG_ROWS", lm.LONG_ROWS | {"parquet.block.size": str(1 << 19)})
    r = np.random.default_rng(5)
    words = ["".join(map(chr, w)) for w in r.integers(97, 123, (5000, 6))]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words, 9000))) for i in range(60)], "doc_id long, text string").coalesce(1)
    model, vocabulary = lm.fit(docs)
    assert lm.score(docs, model, vocabulary).count() == 60
    files = [f.removeprefix("file:") for df in kept if "texts" in df.columns for f in df.inputFiles()]
    groups = [g.row_group(k) for g in (pq.ParquetFile(f).metadata for f in files) for k in range(g.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 60 and max(g.total_byte_size for g in groups) <= 1 << 20


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_grams(n):
    r = np.random.default_rng(n)
    gram, count = np.unique(lm.known_by(r.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))), r.integers(1, 1 << 40, n)
    got = lm.unpacked(lm.packed(gram, count))
    assert got[0].tolist() == gram.tolist() and got[1].tolist() == count.tolist()
    assert lm.unpacked(lm.packed(gram))[0].tolist() == gram.tolist()
    group, at = lm.sliced(gram, 256)
    assert sum(np.diff(at)) == n and all((lm.segment_of(gram[a:b], 256) // lm.GROUPED == g).all() for g, a, b in zip(group, at[:-1], at[1:], strict=True))


def test_quantiser():
    assert lm.Quantiser.level(np.array([0, 1, 2, 3, 4, 8])).tolist() == [0, 1, 2, 2, 3, 4]
    assert lm.Quantiser.value[0] == 0 and all(a < b for a, b in zip(lm.Quantiser.value[:-1], lm.Quantiser.value[1:], strict=True))


# --- passages


def test_remove_repeats(spark, docs, empty):
    passage = prose(800, 70)
    alone = " ".join(f"w{k}x{k * k}" for k in range(70))
    data = [(k, prose(900 + k, 54) + "\n" + passage + "\n" + prose(950 + k, 54)) for k in range(5)]
    data += [(20 + k, prose(970 + k, 45) + "\n" + alone + "\n" + prose(980 + k, 45)) for k in range(3)] + [(40, prose(990, 200))]
    own = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r.id: r for r in passages.remove_repeats(clash(own)).collect()}
    assert set(got) == {1, 2, 3, 4, 21, 22}
    for i, r in got.items():
        text = dict(data)[i]
        cut = "".join(text[a:b] for a, b in [(0, r.removed[0].start), *((x.end, y.start) for x, y in zip(r.removed[:-1], r.removed[1:], strict=True)), (r.removed[-1].end, len(text))])
        assert r.text == cut and list(r.first_ids) == [0 if i < 20 else 20]
        inside = " ".join(text[s.start : s.end] for s in r.removed)
        assert len(set(split(inside)) & set(split(passage if i < 20 else alone))) > 40 and r.n_words == len(split(inside)) <= 75
    assert {r.id for r in passages.remove_repeats(docs).collect() if r.id is None} == set()
    assert passages.remove_repeats(empty).count() == 0


def sentences(r: random.Random, sizes) -> list[str]:
    return [" ".join(f"w{r.randrange(10**9)}" for _ in range(n)) + "." for n in sizes]


def test_whole_passages_go(spark):
    """Planted twice, whole sentences go to the last word; a passage from any word on but for less than a cut at each end."""
    r = random.Random(5)
    rows, want = [], {}
    for k in range(300):
        own = [sentences(r, [r.randrange(3, 40) for _ in range(8)]) for _ in range(2)]
        if k % 3:
            passage = sentences(r, [18, 18, 18, 5] if k == 1 else [r.randrange(3, 30) for _ in range(9)])
            while k > 1 and len(split(" ".join(passage[:-1]))) > 50:
                passage.pop()
            planted, slack = " ".join(passage), 0
        else:
            source = split(" ".join(sentences(r, [r.randrange(3, 40) for _ in range(12)])))
            at = r.randrange(20)
            planted, slack = " ".join(source[at : at + 51 + k % 30]), 2 * passages.CUT
        for j in range(2):
            lead = own[j][:4] if not slack else [*own[j][:4], own[j][6].rstrip(".")]
            rows.append((2 * k + j, " ".join([*lead, planted, *own[j][4:6]])))
        want[2 * k + 1] = (planted, slack)
    got = {x.id: x for x in passages.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    for i, (planted, slack) in want.items():
        n = len(split(planted))
        gone = split(" ".join(texts[i][s.start : s.end] for s in got[i].removed))
        assert n > 50 and set(gone) <= set(split(planted)) and n - slack <= len(gone) <= n
    assert set(got) == set(want)


def test_runs_equal_brute_force():
    texts = [prose(k % 3, 80) for k in range(6)] + ["A b. C d! E?", "", "x. " * 60]
    block = next(blocks(pa.array(texts)))
    s = passages.Sentences(block)
    at, n, h = s.runs()
    names = {}
    for a, k, x in zip(at, n, h, strict=True):
        run = tuple(s.hash[s.first[a] : s.last[a + k - 1]].tolist())
        assert names.setdefault(run, x) == x and len(run) >= passages.WORDS and k >= passages.SENTENCES and s.doc[a] == s.doc[a + k - 1]
    assert len(set(names.values())) == len(names)
