"""Rules that depend on order, nesting or batches, against plain Python models."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pressmill.functions import summaries as sm, text as tx
from pressmill.functions.times import before, effective_from
from pressmill.operators import alerts as al, links as lk
from pressmill.streaming import jobs as jb

AS_OF = "2024-01-31 00:00:00"


def test_names_without_parentheses(spark):
    def model(value):
        out, depth = [], 0
        for c in value or "":
            if c in "()":
                depth = depth + 1 if c == "(" else max(0, depth - 1)
            elif not depth:
                out.append(c)
        return "".join(c for c in "".join(out).lower() if c.isalnum())

    r = random.Random(1)
    names = ["Bank (a\nb", "(" * 9 + "x" + ")" * 9 + " Tripoli", None, "", ")a(b)c"]
    names += ["".join(r.choice("ab( )(9ü\n-") for _ in range(r.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = {x.i: x.norm for x in rows.select("i", tx.normalize_name(F.col("name")).alias("norm")).collect()}
    assert got == {i: model(n) for i, n in enumerate(names)}


def test_links_are_released_to_later_sources(spark):
    def model(items, caps, total):
        taken, out = set(), []
        for source, limit, most in caps:
            links = [x for x in sorted(items) if x[0] == source]
            links = links[:limit] if limit else links
            n = 0
            for _, pos, link in links:
                if len(out) == total or (most and n == most):
                    break
                if link not in taken:
                    taken.add(link)
                    out.append((source, pos, link, len(out) + 1))
                    n += 1
        return sorted(out)

    r = random.Random(2)
    cases = [([("A", 1, "x"), ("A", 2, "y"), ("A", 3, "w"), ("B", 1, "w")], [("A", 0, 1), ("B", 0, 0)], 9)]
    for _ in range(3):
        items = [(s, p, f"l{r.randrange(12)}") for s in "ABCD" for p in range(r.randint(0, 9))]
        cases.append((items, [(s, r.choice([0, 5]), r.choice([0, 1, 2])) for s in "ABCD"], r.choice([4, 50])))
    for items, caps, total in cases:
        rules = [(s, k, limit, most) for k, (s, limit, most) in enumerate(caps)]
        got = lk.source_budget(
            spark.createDataFrame(items, "source_key string, pos long, link string"),
            spark.createDataFrame(rules, "source_key string, source_order int, max_items int, max_inserts int"), total)
        assert sorted((x.source_key, x.pos, x.link, x.slot) for x in got.collect()) == model(items, caps, total)


def test_outcomes_leave_other_rows_alone(spark):
    stored = spark.createDataFrame(
        [(1, 1, "email", "FAILED", 1, "smtp down", None), (2, 1, "email", "FAILED", 1, "smtp down", None), (3, 1, "email", "PENDING", 0, None, None)],
        "alert_id int, article_id int, channel string, status string, attempt_count int, error string, t string").selectExpr(
        "* except (t)", "CAST(t AS TIMESTAMP_NTZ) AS last_attempt_at", "CAST(t AS TIMESTAMP_NTZ) AS next_attempt_at", "CAST(t AS TIMESTAMP_NTZ) AS delivered_at")
    outcomes = spark.createDataFrame([(2, 1, "email", True, None), (3, 1, "email", False, "status=500")], "alert_id int, article_id int, channel string, ok boolean, error string")
    got = {r.alert_id: (r.status, r.error, str(r.delivered_at)) for r in al.delivery_result(stored, outcomes, AS_OF).collect()}
    assert got == {1: ("FAILED", "smtp down", "None"), 2: ("SENT", None, AS_OF), 3: ("FAILED", "status=500", "None")}


def test_display_sentences_know_no_arabic_question_mark(spark):
    text = "هل وصل؟ " + "long enough to be kept by the display cleaner of pages"
    assert spark.range(1).select(sm.drop_boilerplate(F.lit(text)).alias("t")).first().t == text


def test_dedupe_does_not_depend_on_batches(spark, tmp_path):
    r = random.Random(3)
    events = sorted((r.randrange(0, 100 * 3600), r.choice("abc"), r.choice("xy")) for _ in range(300))
    want, last = [], {}
    for t, a, b in events:
        if (a, b) not in last or t - last[a, b] >= 6 * 3600:
            last[a, b] = t
            want.append((a, b, t))
    for files in (1, 7):
        root = tmp_path / str(files)
        for k in range(files):
            part = events[k * 300 // files : (k + 1) * 300 // files]
            rows = spark.createDataFrame(part, "t long, a string, b string").selectExpr("CAST(timestamp_seconds(t) AS TIMESTAMP_NTZ) AS ts", "a", "b")
            rows.coalesce(1).write.mode("append").parquet(str(root / "in"))
        stream = jb.dedupe_stream(jb.read_stream(spark, str(root / "in"), files_per_batch=1), ["a", "b"], "ts", 6 * 3600)
        jb.run_available(jb.append_job(stream, str(root / "out")), str(root / "cp"))
        got = spark.read.parquet(str(root / "out")).select("key", F.unix_seconds(F.to_timestamp("emitted_at")).alias("t")).collect()
        assert sorted((r.key, r.t) for r in got) == sorted((f'{{"a":"{a}","b":"{b}"}}', t) for a, b, t in want)


def test_time_filter_reaches_the_files(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "id", "CASE WHEN id % 3 > 0 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) END AS published_at",
        "TIMESTAMP_NTZ '2024-01-02 00:00:00' + make_dt_interval(CAST(id AS INT)) AS created_at")
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = stored.where(effective_from(before(AS_OF, days=3)))
    assert found.count() == stored.where(F.coalesce("published_at", "created_at") >= before(AS_OF, days=3)).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "published_at" in pushed and "created_at" in pushed


def test_settled_tables_are_cleared(spark):
    import os

    from pressmill.session import clear_scratch, scratch_path, settle

    table = settle(spark.range(5))
    root = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    assert table.count() == 5 and any(name.startswith("settled-") for name in os.listdir(root))
    clear_scratch(spark)
    assert not os.path.exists(root)


def test_failed_notices_do_not_come_back(spark):
    from pressmill.functions.rules import TENDER_WORDS
    from pressmill.operators import tenders as td

    feed = spark.range(6).selectExpr(
        "id", "'s' AS source_key", "concat('https://x/', id) AS url", f"CASE WHEN id < 2 THEN 'about {TENDER_WORDS[0]}' ELSE 'weather' END AS body",
        "'' AS attachment_text", "'' AS title", "0 AS attachments_count", "'en' AS language", "CAST(NULL AS TIMESTAMP_NTZ) AS published_at", "id AS ingested_at")
    sources = spark.createDataFrame([("s", True, "b", "")], "source_key string, needs_words boolean, buyer string, sector string")
    none = spark.createDataFrame([], "raw_article_id long, url string")
    seen, found = spark.createDataFrame([], "id long"), []
    for _ in range(3):
        new, judged = td.extract_tenders(feed, none, sources, limit=2, judged=seen)
        found += [r.raw_article_id for r in new.collect()]
        seen = spark.createDataFrame([(r.id,) for r in seen.unionByName(judged.select("id")).collect()], "id long")
    assert sorted(found) == [0, 1] and seen.count() == 6
    assert td.candidates(feed, none).count() == 6
