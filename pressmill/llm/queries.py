"""Named queries of the package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressmill.llm.audit import audit
from pressmill.llm.blocks import tune
from pressmill.llm.bpe import round_trip
from pressmill.llm.codes import token_codes
from pressmill.llm.exact import exact_groups
from pressmill.llm.langid import fit as fit_languages, identify
from pressmill.llm.leaks import find_copies
from pressmill.llm.licences import scan
from pressmill.llm.lm import fit as fit_model, score
from pressmill.llm.near import near_groups
from pressmill.llm.passages import remove_repeats
from pressmill.llm.periods import collapse_runs
from pressmill.llm.quality import classify, fit as fit_quality
from pressmill.llm.sanitise import KINDS, sanitise
from pressmill.functions.text import let
from pressmill.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(prepare(spark))
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       columns=("n_tokens", "ids_sha256", "bytes_sha256"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.col("bytes_sha256").alias("decoded_sha256"))


@query("op8_token_codes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = token_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), columns=("start", "n_tokens", "ids_crc32"))
    return coded.withColumnRenamed("id", "doc_id")


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", "start", "end")


def remainder(n: int):
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


@query("op3_ppm_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit_languages(docs.where(remainder(3) != 1))
    return identify(docs, trees).withColumnRenamed("id", "doc_id").select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "bits")


@query("op4_attention_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = classify(docs, fit_quality(docs, labels.where(remainder(4) != 2))).withColumnRenamed("id", "doc_id")
    return scored.withColumn("held_out", remainder(4) == 2)


@query("op7_bloom_language_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, vocabulary = fit_model(docs.where(remainder(10) != 0))
    scored = score(docs, model, vocabulary).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.words).cast("long").alias("train_tokens"), "base_score", "score")


@query("op9_sentence_spans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_licence_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "spans.label")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score")


@query("op11_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END) AS f
  FROM w LEFT JOIN l USING (doc_id)),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (SELECT part, good, bad, f, o,
             coalesce(list_min([strpos(o, c) FOR c IN ['A', 'B', 'C', 'D', 'E'] IF contains(f, c)]), 6) AS hit FROM m, o),
s AS (SELECT r.*, k AS step, substr(o, k, 1) AS c FROM r, generate_series(1, 5) AS g(k)),
t AS (SELECT part, o AS filter_order, step, c, sum((hit > step)::INT) AS kept, sum((hit = step)::INT) AS removed,
             sum((contains(f, c) AND hit < step)::INT) AS redundant, sum((f = c)::INT) AS unique_fails,
             sum((hit = step)::INT * good) AS good_lost, sum((hit = step)::INT * bad) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM t
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("bad_lost", "toxic_lost")


def planted(docs: DataFrame) -> DataFrame:
    """``docs``; where the crc32 h of the id is a multiple of 10, the words from number a = g % n on repeat the first p of them, with
    g = h / 10 and p = 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        return F.when(n > 0, let(F.pmod(g, n), lambda a: let(F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)), lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")))).otherwise("")

    w = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (h % 10 == 0), let(w, repeated)).otherwise(F.col("text")))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period.cast("string"), F.lit("\n")))), "")
    told = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_disclosure_sanitising")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")

    ranks = F.transform("base", lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:-1])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
