"""Search, report and article queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import rules
from pressmill.operators import index as ix, search as se
from pressmill.plans import sqlbits as q
from pressmill.plans.pages import _GOOD, SENT
from pressmill.plans.registry import query
from pressmill.plans.tables import ENT, _entity_tables
from pressmill.session import scratch_path
from pressmill.sources.bind import AS_OF

T = "TIMESTAMP '2024-01-31'"
TK = "list_filter(regexp_split_to_array(lower(coalesce(title,'') || ' ' || coalesce(summary,'') || ' ' || coalesce(content,'') || ' '), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
TOK = f"tok AS (SELECT *, coalesce(published_at, created_at) AS ts, {TK} AS tk FROM fx_articles)"
CAT = q.first_label("lower(coalesce(title,'') || ' ' || coalesce(summary,''))", rules.CATEGORIES, "General")


def count(word: str) -> str:
    return f"len(list_filter(tk, lambda x: x = '{word}'))"


@query("build_token_index", f"""WITH {TOK}, e AS (SELECT id, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM tok)
    SELECT token, id, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM e GROUP BY ALL""")
def _(t):
    return se.build_token_index(t.articles).select("token", "id", "tf", F.get("positions", 0).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


def _index(t) -> str:
    path = scratch_path(t.spark, "index")
    ix.write_search_index(t.articles, path, buckets=16, slices=2)
    return path


@query("job_search_index", f"""WITH {TOK}, e AS (SELECT id, unnest(tk) AS token FROM tok) SELECT token, count(DISTINCT id) AS articles, count(*) AS uses FROM e GROUP BY 1""")
def _(t):
    stored = t.spark.read.parquet(f"{_index(t)}/postings")
    return stored.groupBy("token").agg(F.count(F.lit(1)).alias("articles"), F.sum("tf").alias("uses"))


@query("search_articles", f"""WITH {TOK} SELECT id, ts, round(0.1 * {count('minister')}, 6)::DOUBLE AS rank FROM tok WHERE ts >= {T} - INTERVAL 30 DAY AND list_contains(tk, 'minister') ORDER BY rank DESC, ts DESC, id DESC LIMIT 50""")
def _(t):
    return se.search_articles(t.articles, "Minister", AS_OF, days=30, n=50).select("id", "ts", "rank")


@query("search_articles_terms", f"""WITH {TOK} SELECT id, ts, round(CASE WHEN list_contains(tk, 'central') AND list_contains(tk, 'bank') THEN 0.1 ELSE 0 END + 0.1 * {count('pipeline')} + CASE WHEN contains(array_to_string(tk, ' '), 'tender and procurement') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS rank
    FROM tok WHERE ts >= {T} - INTERVAL 30 DAY AND (source ILIKE '%src1%' OR source_name ILIKE '%src1%') AND ((list_contains(tk, 'central') AND list_contains(tk, 'bank')) OR list_contains(tk, 'pipeline') OR contains(array_to_string(tk, ' '), 'tender and procurement'))
    ORDER BY rank DESC, ts DESC, id DESC LIMIT 100""")
def _(t):
    return se.search_articles(t.articles, 'central bank or pipeline or "tender and procurement" -vote', AS_OF, days=30, source="%src1%", n=100).select("id", "ts", "rank")


_TERMS = f"""WITH {TOK} SELECT id, ts, round(CASE WHEN list_contains(tk, 'central') AND list_contains(tk, 'bank') THEN 0.1 ELSE 0 END + 0.1 * {count('pipeline')}, 6)::DOUBLE AS rank
    FROM tok WHERE ts >= {T} - INTERVAL 30 DAY AND category = 'Energy' AND ((list_contains(tk, 'central') AND list_contains(tk, 'bank')) OR list_contains(tk, 'pipeline')) ORDER BY rank DESC, ts DESC, id DESC LIMIT 40"""


@query("search_articles_stored", f"""WITH {TOK}, hit AS (SELECT id, ts, round(0.1 * {count('the')}, 6)::DOUBLE AS rank FROM tok WHERE ts >= {T} - INTERVAL 20 DAY AND list_contains(tk, 'the') AND NOT list_contains(tk, 'vote'))
    SELECT id, ts, rank, a.title, a.url FROM hit JOIN fx_articles a USING (id) ORDER BY rank DESC, ts DESC, id DESC LIMIT 50""")
def _(t):
    return ix.search_articles_stored(t.articles, _index(t), "The -vote", AS_OF, days=20, n=50, buckets=16).select("id", "ts", "rank", "title", "url")


@query("search_articles_sql", _TERMS)
def _(t):
    ix.register_search(t.articles, _index(t), AS_OF, buckets=16)
    return t.spark.sql("SELECT id, ts, rank FROM search_articles('central bank OR pipeline', 30, 'Energy', NULL, 40)")


@query("search_like", f"""SELECT id, coalesce(published_at, created_at) AS ts, coalesce(category, {CAT}) AS category_guess FROM fx_articles WHERE coalesce(published_at, created_at) >= {T} - INTERVAL 14 DAY
    AND (title ILIKE '%port%' OR summary ILIKE '%port%' OR content ILIKE '%port%') AND (contains(lower(source), 'src') OR contains(lower(source_name), 'src')) AND lower(coalesce(category, {CAT})) = 'trade' ORDER BY ts DESC, id DESC LIMIT 50""")
def _(t):
    return se.search_like(t.articles, "port", AS_OF, days=14, category="TRADE", source="SRC", n=50).select("id", "ts", "category_guess")


@query("search", f"""WITH {TOK} SELECT id, ts, coalesce(category, {CAT}) AS category_guess FROM tok WHERE ts >= {T} - INTERVAL 20 DAY AND list_contains(tk, 'customs') AND source ILIKE '%2%' ORDER BY ts DESC, id DESC LIMIT 50""")
def _(t):
    return se.search(t.articles, "customs", AS_OF, days=20, source="2", n=50).select("id", "ts", "category_guess")


# Rank of a text for each of the saved queries, NULL where it does not match.
HIT = f"""CASE query WHEN '' THEN 0.0 WHEN 'pipeline' THEN 0.1 * {count('pipeline')} WHEN 'minister' THEN 0.1 * {count('minister')} WHEN 'attack -vote' THEN CASE WHEN list_contains(tk, 'vote') THEN NULL ELSE 0.1 * {count('attack')} END
      WHEN 'central bank' THEN CASE WHEN list_contains(tk, 'central') AND list_contains(tk, 'bank') THEN 0.1 END WHEN 'customs tariff' THEN CASE WHEN list_contains(tk, 'customs') AND list_contains(tk, 'tariff') THEN 0.1 END
      ELSE CASE WHEN contains(' ' || array_to_string(tk, ' ') || ' ', ' tender and procurement ') THEN 0.1 END END"""

@query("job_search", f"""WITH {TOK}, terms AS (SELECT DISTINCT query FROM fx_searches WHERE query <> ''),
    h AS (SELECT * FROM (SELECT query, id, ts, round({HIT}, 6)::DOUBLE AS rank FROM terms, tok) WHERE rank > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank DESC, ts DESC, id DESC) AS rn FROM h)
    SELECT query, id, rank, rn FROM r WHERE rn <= 50""")
def _(t):
    from pressmill.operators import alerts as al
    from pressmill.operators.ordered import top_k

    asked = t.searches.where("query <> ''").select("query").distinct()
    hits = al.query_hits(asked, t.articles).join(t.articles.select("id", F.coalesce("published_at", "created_at").alias("ts")), "id")
    return top_k(hits, ["query"], [F.desc("rank"), F.desc("ts"), F.desc("id")], 50, F.col("id")).select("query", "id", "rank", "rn")


# ---- reports ---------------------------------------------------------------------------------

_HIT = " + ".join(f"CAST(contains(lower(coalesce(title,'') || ' ' || coalesce(summary,'') || ' ' || coalesce(content,'')), '{k}') AS INT)" for k in ("pipeline", "bank"))
_REC = f"greatest(0.0, 72 - greatest(epoch({T} - published_at) / 3600.0, 0.0)) / 72"
WIN = f"""win AS (SELECT * FROM fx_articles WHERE NOT is_deleted AND published_at >= {T} - INTERVAL 7 DAY AND published_at <= {T} ORDER BY published_at DESC, id DESC LIMIT 50)"""
RANKED = f"""{WIN}, ranked AS (SELECT w.*, s.name AS label, round(({_HIT}) * 2.5 + {_REC} + CASE s.key WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 2.8 ELSE 1.0 END, 9) AS score FROM win w LEFT JOIN fx_sources s ON s.id = w.source_id)"""
_WEIGHTS = {"src1": 3.0, "src2": 2.8}
_START, _END = "2024-01-24 00:00:00", "2024-01-31 00:00:00"


def _ranked(t):
    return se.report_rank(t.feed, t.sources, AS_OF, _START, _END, ["Pipeline", " bank "], limit=50, weights=_WEIGHTS)


@query("report_rank", f"WITH {RANKED} SELECT id, score FROM ranked")
def _(t):
    return _ranked(t).select("id", "score")


@query("report_rank_priority", f"WITH {WIN} SELECT w.id, round({_REC} + coalesce(CAST(json_extract_string(s.meta, '$.priority') AS DOUBLE), 0) + ({_HIT}), 9) AS score FROM win w LEFT JOIN fx_sources s ON s.id = w.source_id")
def _(t):
    return se.report_rank_priority(t.feed, t.sources, AS_OF, _START, _END, ["Pipeline", " bank "], limit=50).select("id", "score")


LINES = f"""{RANKED}, it AS (SELECT *, CASE WHEN source_type = 'social' THEN 2 ELSE 1 END AS section FROM ranked), n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, published_at DESC, id DESC) AS k FROM it),
    body AS (SELECT section, k AS line_no, '- ' || title || ' (' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || ') — ' || url AS line FROM n WHERE k <= 10
      UNION ALL SELECT 3, row_number() OVER (ORDER BY source_id), '- ' || s FROM (SELECT DISTINCT source_id, coalesce(label, source_id) AS s FROM ranked))"""


@query("report_sections", f"WITH {LINES} SELECT section, line_no, line FROM body")
def _(t):
    lines = se.report_lines(_ranked(t), "Report", _START, _END)
    return lines.where("line_no > 0 AND line_no < 1000000").select("section", F.col("line_no").cast("long").alias("line_no"), "line")


@query("job_report", f"""WITH {LINES}, fixed AS (SELECT * FROM (VALUES (0,-8,'# Report'),(0,-7,''),(0,-6,'**Period:** {_START} → {_END}'),(0,-5,''),(0,-4,'## Executive Summary'),(0,-3,''),(0,-2,'- Deterministic summary (LLM optional).'),(0,-1,''),
      (1,-2,'## Key Developments'),(1,-1,''),(1,1000000,''),(2,-2,'## Notable Social Signals'),(2,-1,''),(2,1000000,''),(3,-2,'## Sources'),(3,-1,''),(3,1000000,'')) f(section, line_no, line))
    SELECT trim(string_agg(line, chr(10) ORDER BY section, line_no), ' ' || chr(10)) || chr(10) AS markdown FROM (SELECT * FROM body UNION ALL SELECT * FROM fixed)""")
def _(t):
    return se.report_markdown(se.report_lines(_ranked(t), "Report", _START, _END))


_CLEAN = q.strip("regexp_replace(regexp_replace(regexp_replace({0}, '\\s+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')").replace("{{3,}}", "{3,}")


@query("article_detail", f"""WITH {ENT}, e AS (SELECT normalized_name AS id, CASE WHEN min(article_id) % 3 = 0 THEN normalized_name ELSE 'N:' || normalized_name END AS nm FROM m GROUP BY 1),
    ae AS (SELECT article_id, string_agg(nm, '|' ORDER BY id) AS names FROM (SELECT DISTINCT article_id, normalized_name AS id FROM m) JOIN e USING (id) GROUP BY 1),
    c AS (SELECT *, {_CLEAN.replace('{0}', 'content')} AS t FROM fx_articles),
    b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\\n+'), lambda s: {q.strip('s')}), lambda s: s <> '') AS l, list_filter(list_transform({SENT.format('t')}, lambda s: {q.strip('s')}), lambda s: s <> '') AS ss FROM c)
    SELECT b.id, coalesce(category, {CAT}) AS category_guess, source_name, s.url AS source_url, nullif(left(CASE WHEN len(l) <= 2 THEN array_to_string(list_filter(ss, {_GOOD.format(40)}), chr(10) || chr(10)) ELSE array_to_string(list_filter(l, {_GOOD.format(25)}), chr(10) || chr(10)) END, 4000), '') AS content_clean,
      coalesce(names, '') AS entities FROM b LEFT JOIN fx_sources s ON s.key = b.source LEFT JOIN ae ON ae.article_id = b.id""")
def _(t):
    bridge, ents = _entity_tables(t)
    rows = se.article_detail(t.articles, t.sources, bridge, ents)
    return rows.select("id", "category_guess", "source_name", "source_url", "content_clean", F.array_join("entities", "|").alias("entities"))


