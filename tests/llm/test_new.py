"""Filter audit, periodic runs and sanitising against plain versions, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from pressmill.llm import audit, passages, periods, sanitise
from pressmill.llm.blocks import blocks, hashes, mix, tune
from tests.oracle import compare, engine

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", "   \t\n", "one", "ÄÖ　ñ\x85é 日本語 🙂", "a\x00b", "!!! ???", "x" * 300_000, "9" * 200_000, "\x1c\x1f", "٣٤ ½ Ⅷ", "É# É", "a b " * 5000]


@pytest.fixture(scope="module")
def given():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in t}


def clash(df):
    """Columns of other names, among them those that operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(7).alias(c) for c in ("id", "part", "digest", "fails", "own", "before", "runs", "row", "pair", "term", "spans", "base", "share", "n")))


# --- filter audit


def test_transducer():
    r = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(r.choice("aB# \n\tüé日🙂") for _ in range(r.randint(0, 40))) for _ in range(800)]
    for block in blocks(pa.array(texts), 3000):
        seen = audit.Pass(block)
        distinct = audit.distinct_words(block, seen)
        for i in range(len(block)):
            text, own = block.text(i).decode(), seen.doc == i
            found = [block.buf[a:b].tobytes().decode() for a, b in zip(seen.start[own], seen.end[own], strict=True)]
            assert found == WORD.findall(text) and distinct[i] == len({*found})
            assert (seen.chars[i], seen.capitals[i], seen.symbols[i]) == (len(text), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)))


def test_word_table_compares_bytes(monkeypatch):
    """All hashes alike: only the bytes tell words apart."""
    monkeypatch.setattr(audit, "hashes", lambda block, start, end, fold: np.zeros(len(start), np.uint64))
    block = next(blocks(pa.array(["aa ab aa " + "long" * 9 + " " + "long" * 8 + "lonk aa", "aa aa"])))
    assert audit.distinct_words(block, audit.Pass(block)).tolist() == [4, 1]


def plain_audit(rows, labels):
    fails = []
    for k, (i, text, source) in enumerate(rows):
        text, w = text or "", WORD.findall(text or "")
        f = {"A": len(w) < 200, "B": 100 * len({*w}) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
             "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        fails.append((source or "", "".join(c for c in f if f[c]), *labels.get(i, (0, 0))))
    want = {}
    for part in {p for p, *_ in fails}:
        own, shapley = [x[1:] for x in fails if x[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                here = [x for x in own if not set(x[0]) & set(order[:k])]
                out = [x for x in here if c in x[0]]
                shapley[c] += len(out)
                want[part, order, k + 1] = [len(here) - len(out), len(out), sum(c in x[0] for x in own) - len(out), sum(x[0] == c for x in own),
                                            sum(x[1] for x in out), sum(x[2] for x in out)]
        for (p, order, k), row in want.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return want


def test_audit(spark):
    tune(spark)
    r = random.Random(5)
    texts = [" ".join(r.choice(["Word", "Wörd", "the", "X", "#a", f"w{k}"]) for k in range(r.choice([3, 190, 230]))) for _ in range(30)]
    rows = [(k, t, ["s", "t", None, ""][k % 4]) for k, t in enumerate([*texts, *texts[:9], *ODD, *ODD])]
    rows += [(None, texts[0], "s"), (None, None, None), rows[0], rows[3], (3, texts[0], "t")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, 0, 1), (35, 1, 1), (None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(clash(docs), told).collect()
    want = plain_audit(rows, {0: (1, 0), 1: (1, 1), 2: (0, 1), 35: (1, 1)})
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.bad_lost, x.shapley] for x in got} == want
    assert len(got) == len(want)
    assert audit.audit(docs.limit(0), told).count() == 0 and audit.audit(docs, told.limit(0)).count() == len(want)


def test_audit_query(spark):
    ok, note = compare(engine("0.001"), entry.queries()["op11_filter_audit"](spark, SF), entry.oracle_sql()["op11_filter_audit"])
    assert ok, note


# --- periodic runs


def plain_runs(w, length=6, times=4):
    """(start, length, period) of every run, by comparing the words with those of each distance."""
    names: dict = {}
    w, out, seen = np.array([names.setdefault(x, len(names)) for x in w], np.int64), [], set()
    for q in range(1, len(w) // times + 1):
        step = np.flatnonzero(np.diff(np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(int)))
        for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
            if b - a + q >= max(length, times * q) and (a, b - a + q) not in seen:
                seen.add((a, b - a + q))
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize(("length", "times"), [(6, 4), (2, 2), (9, 3)])
def test_find_runs(length, times):
    r = random.Random(length)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            w: list[int] = []
            while len(w) < r.randint(0, 50):
                w += [r.randint(0, r.choice([1, 3, 9])) for _ in range(r.randint(1, 7))] * r.choice([1, 1, 2, 5, 9])
            texts.append(w)
        at = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        h, doc = mix(np.array([x for w in texts for x in w], np.uint64)), np.repeat(np.arange(len(texts)), np.diff(at))
        got = list(zip(*(x.tolist() for x in periods.find_runs(h, doc, length, times)), strict=True))
        assert got == [(s + int(at[k]), n, q) for k, w in enumerate(texts) for s, n, q in plain_runs(w, length, times)]


def test_collapse(spark):
    tune(spark)
    texts = [*ODD, "a b c " * 3 + "a b", "x a b c a b c a b c a b c a y", "é\té\n" * 6, "go " * 5, "go " * 6 + "on", "b " + "a " * 40 + "b " + "a " * 40]
    rows = [(k % 7 if k % 5 else None, t) for k, t in enumerate([*texts, *texts])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = collections.Counter((r.id, r.n_words, tuple(map(tuple, r.runs)), r.text) for r in periods.collapse_runs(clash(docs)).collect())
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = plain_runs(w)
        want[i, len(w), tuple(runs), collapsed(w, runs)] += 1
    assert got == want
    assert periods.collapse_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, given):
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(given)
    for i, r in given.items():
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        lines, text = "".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(w, runs)
        o = got[i]
        assert (o.n_runs, o.runs_sha256, o.collapsed_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (o.start, o.length, o.period, o.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert sum(r.n_runs for r in got.values()) > 10


# --- sanitising


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
]


def plain_values(text):
    return sorted((m.start(), k, m.end(), m[0]) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))


def plain_sanitised(texts):
    """Spans of every text by the definition, counted in plain loops."""
    word, reach = re.compile(sanitise._WORD), sanitise.REACH
    values, near, words, around = [plain_values(t) for t in texts], [], collections.Counter(), []
    for t, v in zip(texts, values, strict=True):
        words.update({m[0].lower() for m in word.finditer(t)})
        pairs, seen = set(), []
        for s, k, e, x in v:
            name = f"{k}:{digits(x) if k > 1 else x.lower()}"
            left, right = t[max(0, s - reach) : s], t[e : e + reach]
            left = re.sub("^" + sanitise._WORD, "", left) if s > reach else left
            right = re.sub(sanitise._WORD + r"\Z", "", right)
            seen.append(left + "\n" + right)
            pairs |= {(name, w.lower()) for w in word.findall(seen[-1])}
        near.append(pairs)
        around.append(tuple(seen))
    both, places = collections.Counter(p for x in near for p in x), collections.defaultdict(set)
    own = collections.Counter(n for v in values for n in {f"{k}:{digits(x) if k > 1 else x.lower()}" for _, k, _, x in v})
    for x, a in zip(near, around, strict=True):
        for p in x:
            places[p].add(a)
    n, out = len(texts), []
    for t, v, x in zip(texts, values, near, strict=True):
        give = {}
        for name, w in x:
            if own[name] * sanitise.COMMON <= n and len(places[name, w]) > 1:
                share = min(1, math.log(n * both[name, w] / (own[name] * max(words[w], both[name, w]))) / math.log(n / own[name]))
                if share >= sanitise.GENERALISE:
                    give[w] = max(share, give.get(w, 0))
        terms = [(m.start(), 4, m.end(), m[0]) for m in word.finditer(t) if m[0].lower() in give]
        out.append((v, sorted([*v, *(a for a in terms if not any(a[0] < b[2] and b[0] < a[2] for b in v))]), {w: s >= sanitise.REMOVE for w, s in give.items()}))
    return out


#: The plain patterns take quadratic time.
SHORT = [t and t[:2000] for t in ODD]
VALUES = [
    "mail a.b+c@x-y.example.org, or a@b.c_d@e.f", "x@y no@dots a@b..c @a.b a@.b a@b.c", "1.2.3.4 01.002.0003.255 256.1.1.1 1.2.3.4.5.6.7.8 12345678901.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 0000000000000000000 00000000000000000000", "+1 (555) 010-9999. +12 345 +49.30.1234567) +0+12345678901",
    "é+1 555 010 9999é 4111111111111111é", "a1.1.1.1b 9999999999.1.1.1", "+4111111111111111 +411111111111111", "1 1.1.1.1 1",
]


def test_values(spark):
    """Also long runs of letters, digits, dots and signs, which plain patterns would take quadratic time or deep recursion for."""
    r = random.Random(4)
    texts = [t or "" for t in [*VALUES, *SHORT]] + ["".join(r.choice("a@.1+- (é25") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    long = ["1" * 200_000, "x" * 200_000 + "@", "1." * 90_000, "+1" * 90_000, "@a.b" * 5000, "1.1.1.1 " * 3000]
    docs = spark.createDataFrame(list(enumerate([*texts, *long])), "doc_id bigint, text string").repartition(3)
    got = {x.id: [tuple(s) for s in x.spans] for x in sanitise.find_values(clash(docs)).collect()}
    some = [[], [], [(8 * k, 1, 8 * k + 7, "1.1.1.1") for k in range(22_500)], [], *(plain_values(t) for t in long[4:])]
    assert got == {**{k: plain_values(t) for k, t in enumerate(texts)}, **dict(enumerate(some, len(texts)))}


def test_sanitise(spark):
    r = random.Random(6)
    people = [(f"{n.lower()}@mail{k}.example.com", n, f"+1 555 010 {1000 + k}") for k, n in enumerate(["Zora", "Quill", "Yorick", "Xeno"])]
    texts = []
    for k in range(400):
        text = " ".join(r.choice(["the", "of", "and", "Bob", f"w{r.randrange(60)}"]) for _ in range(r.randint(0, 60)))
        if k % 50 < 2:
            mail, name, phone = people[k // 50 % 4]
            text += f" Ask {name} Müller{k % 3} ({mail}) or {phone}, dear {name}. " + text
        texts.append(text)
    texts += [texts[0], texts[1], texts[1], *(t or "" for t in SHORT), *VALUES]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id bigint, text string").repartition(3)
    got = {x.id: x for x in sanitise.sanitise(clash(docs)).collect()}
    want = plain_sanitised([*texts, ""])
    terms = collections.Counter()
    for k, (base, spans, give) in enumerate(want[:-1]):
        assert ([tuple(s) for s in got[k].base], [tuple(s) for s in got[k].spans]) == (base, spans), k
        assert ({*got[k].removed}, {*got[k].general}) == ({w for w, x in give.items() if x}, {w for w, x in give.items() if not x})
        terms.update(s[3] for s in spans if s[1] == 4)
        if base and give:
            assert "[EMAIL]" in got[k].text and not plain_values(got[k].text) and not {*re.findall(r"\w+", got[k].text.lower())} & {*give}
        assert (got[k].text is None) == (not base)
    assert terms["Zora"] and terms["Quill"] and not terms["the"] and not terms["Bob"]
    assert not got[None].spans and len(got) == len(texts) + 1
    assert sanitise.sanitise(docs.limit(0)).count() == 0


def test_sanitising_query(spark, given):
    got = {r.doc_id: r for r in entry.queries()["op13_disclosure_sanitising"](spark, SF).collect()}
    assert set(got) == set(given)
    for (i, _), (base, spans, _) in zip(given.items(), plain_sanitised([r["text"] or "" for r in given.values()]), strict=True):
        listed = [",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e, _ in x) for x in (base, spans)]
        o = got[i]
        assert (o.n_email, o.n_ip, o.n_card, o.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert (o.base_sha256, o.spans) == (hashlib.sha256(listed[0].encode()).hexdigest(), listed[1])


def test_chunked_sums(spark):
    from pyspark.sql import functions as F

    rows = [[], [5], list(range(255)), list(range(256)), list(range(257)), list(range(1000))]
    got = spark.createDataFrame([(r,) for r in rows], "a array<bigint>").select(sanitise.sums_before(F.col("a")).alias("s"), "a").collect()
    assert all(r.s == [sum(r.a[:k]) for k in range(len(r.a))] for r in got) and len(got) == len(rows)


# --- sentence spans

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sentences(text):
    """(start, end, words) of every sentence, end exclusive at the next one's start."""
    found = [(m.start(), m.end(), m[0].translate(LOW)) for m in re.finditer(sanitise._WORD, text)]
    stop = []
    for k, (_, b, _) in enumerate(found):
        after = text[b : found[k + 1][0]] if k + 1 < len(found) else None
        stop.append(after is None or "\n" in after or (after[:1] in {".", "!", "?"} and after[1:2] != after[:1]))
    h = []
    for _, _, w in found:
        block = next(blocks(pa.array([w])))
        h.append(int(hashes(block, np.array([0]), np.array([len(block.buf)]))[0]))
    cut = list(stop)
    for k in range(len(found) - passages.CUT + 1):
        if not any(stop[k : k + passages.CUT - 1]):
            cut[min(range(k, k + passages.CUT), key=lambda j: h[j])] = True
    out, first = [], 0
    for k in range(len(found)):
        if cut[k]:
            out.append((found[first][0], found[k + 1][0] if k + 1 < len(found) else len(text), [w for _, _, w in found[first : k + 1]]))
            first = k + 1
    return out


def plain_removed(rows):
    """id, text and number of words that go, for each document that loses text: every run of sentences by its words, the first one stays."""
    parts = [plain_sentences(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda d: (rows[d][0] is not None, rows[d][0] or 0))
    runs = []
    for d in order:
        n = len(parts[d])
        ends = {}
        for a in range(n):
            k, size = a, 0
            while k < n and (size < passages.WORDS or k - a < passages.SENTENCES):
                size, k = size + len(parts[d][k][2]), k + 1
            if size >= passages.WORDS and k - a >= passages.SENTENCES:
                ends[a] = k
        taken = {(a, k) for a, k in ends.items()}
        for k in range(1, n + 1):
            before = [a for a, e in ends.items() if e < k]
            if k not in ends.values() and before:
                taken.add((max(before), k))
        runs += [(d, a, k) for a, k in sorted(taken)]
    first, gone = {}, collections.defaultdict(set)
    for d, a, k in runs:
        name = tuple(w for x in parts[d][a:k] for w in x[2])
        if first.setdefault(name, (d, a, k)) != (d, a, k):
            gone[d] |= {*range(a, k)}
    out = []
    for d, some in gone.items():
        text, n = "", 0
        for k, (a, b, w) in enumerate(parts[d]):
            lo = hi = k
            while lo - 1 in some:
                lo -= 1
            while hi + 1 in some:
                hi += 1
            off = k in some and sum(len(x[2]) for x in parts[d][lo : hi + 1]) >= passages.LEAST
            n += off and len(w)
            text += "" if off else rows[d][1][a:b]
        if n:
            out.append((rows[d][0], rows[d][1][: parts[d][0][0]] + text, n))
    return sorted(out, key=str)


def test_sentence_spans_of_one_id(spark):
    """One id with several texts, null ids and repeated rows, against the plain version."""
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(500)) + r.choice(["", "", "", ".", ",", "!!", " -"]) for _ in range(n))
    passage, short = prose(90), prose(30)
    rows = [(5, prose(60) + ". " + passage + ". " + prose(20)), (5, "short text here."), (1, passage), (5, passage), (None, prose(3) + "\n" + passage), (None, passage.upper() + " end"),
            (None, None), (7, ""), (8, prose(40) + "\n" + short), (9, short + "\n" + prose(40)), (9, passage + " " + passage), (9, re.sub(" ", " | ", passage))]
    docs = spark.createDataFrame([*rows, rows[0], rows[2]], "doc_id bigint, text string").repartition(3)
    got = sorted(((x.id, x.text, x.n_words) for x in passages.remove_repeats(clash(docs)).collect()), key=str)
    plain = plain_removed([(i, t or "") for i, t in rows])
    assert len(plain) >= 5
    # Among texts of one id the one with the smallest hash is first: which of them keeps a passage is not told by the plain version.
    assert {(x[0], x[2] > 60) for x in got} >= {(9, True)} and all(x[0] != 8 for x in got) and (1, passage, 90) not in got
    assert sum("short text here" in x[1] for x in got) == 0
    ids = [(k, t or "") for k, (_, t) in enumerate(rows)]
    apart = spark.createDataFrame(ids, "doc_id bigint, text string").repartition(3)
    assert sorted(((x.id, x.text, x.n_words) for x in passages.remove_repeats(apart).collect()), key=str) == plain_removed(ids)


def test_sentence_spans_query(spark, given):
    got = sorted(((r.doc_id, r.text, r.n_words) for r in entry.queries()["op9_sentence_spans"](spark, SF).collect()), key=str)
    assert got == plain_removed([(i, r["text"] or "") for i, r in sorted(given.items())]) and got
