"""Hand-made rows, one group per trap, against small independent models."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from pressmill.functions import html as h, rules, summaries as sm, text as tx, urls as u
from pressmill.operators import alerts as al, search as se, selection as sel, tables as tb, tenders as td, topics as tp, writes as w
from pressmill.operators.ordered import first_per_key, nearest_rank, running, top_k, with_index
from pressmill.sources import config as cf, feeds as fd


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def many(spark, values, fn, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


# ---- URLs ------------------------------------------------------------------------------------

URLS = [
    "http://A.com:80/x//", "https://www.A.com/", "https://a.com/x/amp/", "https://a.com/p?q=x/", "https://a.com/?b=2&a=1&a=0&utm_x=1&fbclid=z",
    "https://a.com/?a=b%20c+d&x=*~&e", "http://a.com/ü/ä?k=%zz", "https://a.com:443/a/#f", "https://a.com:8080/a b", "",
]


def model_alert_key(raw):
    if not raw:
        return ""
    p = urlsplit(raw)
    host = p.netloc.lower()
    default = {"http": ":80", "https": ":443"}.get(p.scheme, "")
    if default and host.endswith(default):
        host = host[: -len(default)]
    pairs = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in ("fbclid", "gclid"))
    return urlunsplit((p.scheme, host, p.path.rstrip("/"), urlencode(pairs), ""))


def test_alert_key_matches_model_and_is_stable(spark):
    got = many(spark, URLS, u.canonical_alert)
    assert got == [model_alert_key(x) for x in URLS]
    assert many(spark, got, u.canonical_alert) == got


def test_page_and_feed_keys(spark):
    assert many(spark, ["https://www.A.com/amp", "https://a.com/x///?ref=1&Utm_S=2&k=%20#f", "https://a.com"], u.canonical_page) == [
        "https://a.com/", "https://a.com/x?k=%20", "https://a.com/"]
    assert many(spark, ["https://A.com/x/", "https://a.com/", "https://a.com/x;v=1?b=1&mc_eid=2&a=", None], u.canonical_feed) == [
        "https://a.com/x", "https://a.com/", "https://a.com/x?b=1&a=", None]


@pytest.mark.parametrize("href", ["http://b/c", "//b/c", "/z/../q?x", "?k=1", "#f", "n/./m", "../up", "..", ""])
def test_resolve(spark, href):
    base = "https://a.com/x/y.html?q"
    assert one(spark, href, lambda c: u.resolve(F.lit(base), c)) == urljoin(base, href)


def test_index_pages(spark):
    assert many(spark, ["https://a.com/news/", "https://a.com/news/x", "https://a.com/tag/x", "https://a.com/Politics"], u.looks_like_index) == [True, False, True, False]
    assert many(spark, ["https://a.com/Politics", "https://a.com/politics/x"], u.is_single_section) == [True, False]


# ---- HTML ------------------------------------------------------------------------------------

PAGE = """<html><head><title> A &amp; B&eacute; </title><script>var t="</p><a href='/no'>";</script><!-- <meta property="og:type" content="article"> -->
<script type="application/ld+json">{"@type": ["Thing", "NewsArticle"]}</script></head><body><b>open<p>x&nbsp;&hellip; y</p><a href='/q?a=1&amp;b=2'>l</a><A HREF=plain>m</A><a name="n">n</a></body>"""


def test_html_parts(spark):
    rows = spark.createDataFrame([(PAGE,)], "p string")
    r = rows.select(h.title(F.col("p")).alias("t"), h.main_text(F.col("p")).alias("m"), h.hrefs(F.col("p")).alias("l"),
                    h.has_article_meta(F.col("p")).alias("a"), h.anchor_count(F.col("p")).alias("n")).first()
    assert r.t == "A & Bé" and r.m == "A & Bé open x … y l m n"
    assert r.l == ["/q?a=1&b=2", "plain"] and r.a and r.n == 3


@pytest.mark.parametrize("key,attr", [("article:published_time", "property"), ("pubdate", "name"), ("dc.date.issued", "name")])
def test_published_keys(spark, key, attr):
    assert one(spark, f'<meta content=" 2024-01-02 " {attr}="{key}"><time datetime="x">', h.published_at) == "2024-01-02"


def test_linked_data_list_and_object(spark):
    wrap = lambda j: f'<script type="application/ld+json">{j}</script>'
    docs = [wrap('[{"@type":"Thing"},{"@type":"Article"}]'), wrap('{"@type":"Thing"}'), wrap("broken"), "<p>"]
    assert many(spark, docs, h.has_article_meta) == [True, False, False, False]


# ---- text ------------------------------------------------------------------------------------

def test_substring_rules_not_words(spark):
    assert many(spark, ["the soil", "a report", "nothing"], lambda c: rules.category(c, F.lit(None).cast("string"))) == ["Energy", "General", "General"]


def test_names(spark):
    assert many(spark, ["Voice (of (the) East) One", "Open (rest is gone", "قناة (ب) 218", None], tx.normalize_name) == ["voiceone", "open", "قناة218", ""]


def test_summaries(spark):
    text = "One. Two! Three? Four."
    assert one(spark, text, sm.fast_summary) == "One. Two!"
    assert one(spark, text, lambda c: sm.extractive_summary(c, F.lit("T "))).startswith("T\n\n- One. Two! Three?\n\nWhy")
    assert "الأهمية" in one(spark, "خبر. آخر", lambda c: sm.extractive_summary(c, F.lit("")))
    lines = "\n".join(["same"] * 6 + ["other"])
    assert many(spark, [lines, "short cookie text", "fine " * 300, " "], sm.is_junk) == [True, True, False, True]


def test_item_hash_is_python_json(spark):
    import hashlib
    import json

    item = {"title": 'q"\\u001F \x1f\x0b', "summary": None, "content": "ü\n", "url": "u", "external_id": "\\x0c\x0c"}
    row = spark.createDataFrame([item], "title string, summary string, content string, url string, external_id string")
    want = hashlib.sha256(json.dumps(item, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert row.select(w.item_hash().alias("h")).first()["h"] == want


@pytest.mark.parametrize("text,want", [
    ("Closing date: 3/4/2026", "2026-04-03"), ("closing date - 3-4-26", "2026-04-03"), ("Closing date: 3/15/2024", "2024-03-15"),
    ("Closing date: 31/02/2024", None), ("آخر موعد ٣/٤/٢٠٢٦", "2026-04-03"), ("no date", None)])
def test_deadlines(spark, text, want):
    got = one(spark, text, td.extract_deadline)
    assert (str(got) if got else None) == want


def test_error_classes(spark):
    assert many(spark, ["blocked:403", "blocked:401", "request_error:ReadTimeout", "request_error:SSLError", "request_error:ConnectError", "request_error:HTTPError", "x", ""],
                rules.error_class) == ["err_http_403", "err_blocked", "err_timeout", "err_tls", "err_connect", "err_http", "err_other", None]
    assert many(spark, ["send_exception=Timeout:x", "status=500: y", None], rules.giveup_class) == ["Timeout", "status=500", "unknown"]


# ---- order-dependent operators ---------------------------------------------------------------

def test_running_matches_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), p, rng.randint(0, 5)) for p in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {(r.k, r.pos): (r.s, r.m) for r in running(df, ["k"], "pos", sums={"s": F.col("v")}, maxes={"m": F.col("v")}, chunk=37).collect()}
    for key in "ab":
        total, best = 0, -1
        for _, p, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total, best = total + v, max(best, v)
            assert got[(key, p)] == (total, best)


def test_top_k_and_first_with_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 3001).alias("v"), "id")
    top = top_k(df, ["k"], [F.desc("v"), F.col("id")], 5, F.col("id")).collect()
    for key in ("hot", "cold"):
        want = sorted(((r.v, r.id) for r in df.where(F.col("k") == key).collect()), key=lambda x: (-x[0], x[1]))[:5]
        assert [(r.v, r.id) for r in sorted((r for r in top if r.k == key), key=lambda r: r.rn)] == want
    firsts = {r.k: r.id for r in first_per_key(df, ["k"], [F.col("id")]).collect()}
    assert firsts == {"hot": 0, "cold": 2900}


@pytest.mark.parametrize("n", [1, 2, 11, 12, 20])
def test_nearest_rank(spark, n):
    values = [i * 3 for i in range(n)]
    got = nearest_rank(spark.createDataFrame([("k", v) for v in values], "k string, v long"), ["k"], "v", 0.95, "p").first()["p"]
    assert got == sorted(values)[round(0.95 * (n - 1))]


def model_incremental(stored, stop, min_scan, cap):
    out, stale = [], 0
    for i, old in enumerate(stored):
        stale = stale + 1 if old else 0
        if not old:
            out.append(i)
            if len(out) >= cap:
                break
        if i + 1 >= min_scan and stale >= stop:
            break
    return out


def test_incremental_selection(spark):
    rng = random.Random(2)
    cases = [[rng.random() < p for _ in range(n)] for p in (0.0, 0.5, 0.8, 1.0) for n in (0, 5, 40)]
    rows = [(f"s{c}", i, f"u{i}", old) for c, case in enumerate(cases) for i, old in enumerate(case)]
    df = spark.createDataFrame(rows, "source_key string, pos long, url string, stored boolean")
    got: dict = {}
    for r in sel.select_incremental(df, stop=3, min_scan=4, max_total=6).orderBy("source_key", "slot").collect():
        got.setdefault(r.source_key, []).append(r.pos)
    for c, case in enumerate(cases):
        assert got.get(f"s{c}", []) == model_incremental(case, 3, 4, 6)


def test_cooldown(spark):
    times = [0, 10, 59, 60, 61, 119, 120, 300]
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", base + timedelta(seconds=x)) for x in times] + [("j", base)], "k string, ts timestamp_ntz")
    sent = sorted((r.emitted_at - base).seconds for r in sel.notify_cooldown(df, "k", "ts", 60).where("key = 'k'").collect())
    assert sent == [0, 60, 120, 300]


def test_errors_in_window(spark):
    base, offsets = datetime(2024, 1, 1), [0, 299, 300, 301, 600, 602]
    df = spark.createDataFrame([(i, "j", base + timedelta(seconds=s), True) for i, s in enumerate(offsets)], "i int, j string, ts timestamp_ntz, bad boolean")
    got = [r.errors for r in sel.errors_in_window(df, ["j"], "ts", "bad").orderBy("i").collect()]
    assert got == [sum(1 for o in offsets if s - 300 <= o <= s) for s in offsets]


def test_errors_in_window_without_time_and_at_any_density(spark):
    base = datetime(2024, 1, 1)
    offsets = [None, None, *[(37 * i) % 1500 for i in range(200)], 0, 300, 600]
    rows = [(i, "j" if i % 3 else None, None if s is None else base + timedelta(seconds=s), None if i % 7 == 6 else i % 5 != 4) for i, s in enumerate(offsets)]
    counted = sel.errors_in_window(spark.createDataFrame(rows, "i int, j string, ts timestamp_ntz, bad boolean"), ["j"], "ts", "bad")
    # The rows before a row that a window holds must not be gone through again for each row.
    assert "RangeFrame, -" not in counted._jdf.queryExecution().toString()

    def inside(k, s):
        return k is None if s is None else k is not None and s - 300 <= k <= s

    want = [sum(1 for (_, j, _, bad), k in zip(rows, offsets, strict=True) if bad and j == key and inside(k, s)) for (_, key, _, _), s in zip(rows, offsets, strict=True)]
    got = [(r.errors, r.tripped) for r in counted.orderBy("i").collect()]
    assert got == [(n, n >= 3) for n in want]


# ---- search ----------------------------------------------------------------------------------

def rank_of(spark, text, query):
    df = spark.createDataFrame([(1, text)], "id long, title string").selectExpr(
        "id", "title", "'' AS summary", "'' AS content", "'' AS translated_content", "'' AS category", "'s' AS source", "'s' AS source_name",
        "TIMESTAMP_NTZ '2024-01-30 00:00:00' AS published_at", "TIMESTAMP_NTZ '2024-01-30 00:00:00' AS created_at")
    rows = se.search_articles(df, query, "2024-01-31 00:00:00").collect()
    return rows[0]["rank"] if rows else None


@pytest.mark.parametrize("text,query,want", [
    ("a b a", "a", 0.2), ("a x x b", "a b", round(0.1 / 3, 6)), ("a b x a", "a b", round(0.1 + 0.1 / 2, 6)), ("b a", '"a b"', None), ("z a b", '"a b"', 0.1),
    ("a c", "a -c", None), ("a d", "a -c", 0.1), ("c", "a or c", 0.1), ("a c", "a or c", 0.2), ("state-of art", "state-of", 0.1)])
def test_rank(spark, text, query, want):
    assert rank_of(spark, text, query) == want


def test_saved_query_grammar_agrees_with_single_search(spark):
    texts = ['a "b c" -d', 'x or "y z" -w or q', "-only", '-"p q" r', "A-B or"]
    req = spark.createDataFrame([(x,) for x in texts], "query string")
    got: dict = {}
    for r in al.query_clauses(req).collect():
        got.setdefault(r.query, {})[r.clause] = {"pos": r.pos, "neg": r.neg}
    for x in texts:
        assert [c for _, c in sorted(got.get(x, {}).items())] == se.web_query(x)


# ---- alerts ----------------------------------------------------------------------------------

def model_enqueue(matches, existing, window, enabled, now):
    """One alert after the other, as a loop over rows."""
    rows, out = list(existing), []
    for alert in sorted({m[0] for m in matches}):
        mine = [m for m in matches if m[0] == alert]
        user, channel = mine[0][2], mine[0][3]
        recent = {r[3] for r in rows if r[1] == user and r[2] == channel and r[4] >= now - window}
        for _, article, _, _, key in mine:
            if key in recent or channel not in enabled or any((r[0], r[5], r[2]) == (alert, article, channel) for r in rows):
                continue
            rows.append((alert, user, channel, key, now, article))
            out.append((alert, article, key))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_enqueue_equals_sequential_model(spark, seed):
    rng = random.Random(seed)
    now = datetime(2024, 1, 31)
    matches = sorted({(a, art, a % 2, "email", f"k{art % 3}") for a in range(6) for art in rng.sample(range(8), 4)})
    existing = [(rng.randrange(6), rng.randrange(2), "email", f"k{rng.randrange(3)}", now - timedelta(hours=rng.choice([1, 9])), rng.randrange(8)) for _ in range(4)]
    keyed = spark.createDataFrame([(*m, "u", "q", None) for m in matches],
                                  "alert_id long, article_id long, user_id long, channel string, dedupe_key string, normalized_url string, query string, category string")
    log = spark.createDataFrame(existing, "alert_id long, user_id long, channel string, dedupe_key string, created_at timestamp_ntz, article_id long")
    users = spark.createDataFrame([(0,), (1,)], "user_id long")
    prefs = al.effective_prefs(users, spark.createDataFrame([], "user_id long, dedupe_window_sec int, immediate_priorities array<string>, digest_priorities array<string>, priority_categories array<string>, channels_enabled array<string>, digest_schedule string"))
    got = sorted((r.alert_id, r.article_id, r.dedupe_key) for r in al.enqueue(keyed, log, prefs, now).collect())
    assert got == model_enqueue(matches, existing, timedelta(seconds=21600), ["email"], now)


def test_prefs_empty_list_means_none(spark):
    prefs = spark.createDataFrame([(1, None, None, None, [], None, None), (2, 0, [], None, None, ["sms"], "")],
                                  "user_id long, dedupe_window_sec int, immediate_priorities array<string>, digest_priorities array<string>, priority_categories array<string>, channels_enabled array<string>, digest_schedule string")
    got = {r.user_id: r for r in al.effective_prefs(prefs, prefs, ["energy"]).collect()}
    assert got[1].priority_categories == [] and got[2].priority_categories == ["energy"]
    assert got[2].dedupe_window_sec == 21600 and got[2].immediate_priorities == ["P0"] and got[2].channels_enabled == ["sms"]


# ---- tables and sources ----------------------------------------------------------------------

def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, kept string")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, seq int")
    first = w.upsert(old, new, ["k"], "seq")
    assert sorted(map(tuple, first.collect())) == [("a", 1, "x"), ("b", 6, "y"), ("c", 7, None)]
    assert sorted(map(tuple, w.upsert(first, new, ["k"], "seq").collect())) == sorted(map(tuple, first.collect()))


def test_source_names_both_ways_and_wildcards(spark):
    sources = spark.createDataFrame([("k1", "Daily Post (East)"), ("k2", "Po"), ("k3", "Gazette of the North")], "key string, name string")
    raw = spark.createDataFrame([("k2",), ("daily  POST",), ("The Daily Post Online",), ("gazette",), ("zzz",), ("",)], "n string")
    got = {r.n: (r.source_key, r.tier) for r in tb.map_source_name(raw, "n", sources).collect()}
    assert got == {"k2": ("k2", 1), "daily  POST": ("k1", 2), "The Daily Post Online": ("k1", 3), "gazette": ("k3", 3)}
    texts = spark.createDataFrame([("alpha beta",), ("gamma",)], "t string")
    needles = spark.createDataFrame([("a%b",), ("%",), ("m_a",), ("q%",)], "n string")
    hits = {(r.t, r.n) for r in tb.substring_pairs(texts, "t", needles, "n", wildcards=True).collect()}
    assert hits == {("alpha beta", "a%b"), ("alpha beta", "%"), ("gamma", "%"), ("gamma", "m_a")}


def test_feed_pages_walk_the_whole_table(spark):
    rows = [(i, None if i % 5 == 0 else datetime(2024, 1, 1 + i % 3), False, "article", "en") for i in range(23)]
    feed = spark.createDataFrame(rows, "id long, published_at timestamp_ntz, is_deleted boolean, source_type string, language string")
    seen, cursor = [], None
    for _ in range(10):
        page = tb.feed_page(feed, 5, cursor).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = page[-1].next_cursor
    assert sorted(seen) == list(range(23)) and len(seen) == 23


def test_topic_budget_counts_only_items_with_url(spark):
    topics = cf.rule_table(spark, [("a", 1, 0), ("b", 2, 0)], "topic_key string, priority int, max_processed int")
    rows = [("a", i, None if i in (1, 2) else "u") for i in range(10)] + [("b", i, "u") for i in range(10)]
    got: dict = {}
    for r in tp.topic_budget(spark.createDataFrame(rows, "topic_key string, pos long, url string"), topics, 5).collect():
        got.setdefault(r.topic_key, set()).add(r.pos)
    # Five places of topic a hold three URLs, so two are left for topic b.
    assert got == {"a": {0, 1, 2, 3, 4}, "b": {0, 1}}


def test_config_files_and_inbox(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id":"a","enabled":true,"ingest_method":"RSS "},{"id":"b"},{"name":"no id"}]')
    (tmp_path / "s.json").write_text('[{"id":"b","enabled":true,"type":"facebook"}]')
    page = cf.read_config(spark, str(tmp_path / "p.json"), cf.PAGE_SOURCE)
    social = cf.read_config(spark, str(tmp_path / "s.json"), cf.SOCIAL_SOURCE)
    got = {r.source_key: (r.enabled, r.source_type) for r in cf.source_config(page, social).collect()}
    assert got == {"a": (True, "rss"), "b": (True, "social")}
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link>l</link><guid>g</guid></item></channel></rss>")
    assert [(r.title, r.link, r.guid) for r in fd.read_rss(spark, str(tmp_path / "f.xml")).collect()] == [("t", "l", "g")]


def test_detail_page(spark):
    page = ('<div class="article-date"> 3/4 2026 <h2 class="contentheading"> <a href="#">Big &amp; new</a></h2><div class="item-page" x><script>no</script>Text<ul class="pagenav">menu')
    r = td.detail_page(spark.createDataFrame([(page,)], "html string")).first()
    assert (r.title, r.body, str(r.printed_date)) == ("Big & new", "Text", "2026-03-04")


def test_index_with_gaps(spark):
    df = spark.createDataFrame([("a", p) for p in (5, 100_000, 7, 70_000)], "k string, pos long")
    assert [r.i for r in with_index(df, ["k"], "pos").orderBy("pos").collect()] == [1, 2, 3, 4]
