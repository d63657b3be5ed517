"""Streaming jobs run over the stored tables until nothing is left, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressmill.operators import metrics as m
from pressmill.plans import sqlbits as q
from pressmill.plans.alerts import ENQ
from pressmill.plans.metrics import ATT
from pressmill.plans.registry import query
from pressmill.session import scratch_path
from pressmill.sources.bind import AS_OF, Tables
from pressmill.streaming import jobs as jb

T = "TIMESTAMP '2024-01-31'"


class Streams(Tables):
    """The same bindings over streaming reads of the test tables."""

    def raw(self, name: str) -> DataFrame:
        return jb.read_table_stream(self.spark, self.dir, name)


def _streams(t: Tables) -> Streams:
    return Streams(t.spark, t.dir)


def _run(t: Tables, name: str, start) -> str:
    root = scratch_path(t.spark, name)
    jb.run_available(start(f"{root}/out"), f"{root}/progress")
    return f"{root}/out"


def _table(t: Tables, name: str, result: DataFrame, keys: list[str]) -> DataFrame:
    root = _run(t, name, lambda out: jb.table_job(result, out, keys))
    return jb.table_store(root, result, keys).read(t.spark)


@query("stream_inbox", f"""SELECT source_id, post_url AS external_id, rtrim(left({q.squash('captured_text')}, 80)) AS title, captured_at AS published_at FROM fx_inbox
    WHERE CAST(substr(source_id, 4) AS INT) < 13 AND CAST(substr(source_id, 4) AS INT) % 3 <> 0""")
def _(t):
    root = _run(t, "inbox", lambda out: jb.inbox_job(_streams(t).inbox, t.social_sources, out, AS_OF))
    return jb.inbox_store(root).read(t.spark).select("source_id", "external_id", "title", "published_at")


_NO_LOG = ENQ.replace("FROM fx_deliveries d LEFT JOIN fx_articles a ON a.id = d.article_id)", "FROM fx_deliveries d LEFT JOIN fx_articles a ON a.id = d.article_id WHERE false)").replace("coalesce(c.last_ts - INTERVAL 86400 SECOND, ", "coalesce(NULL, ")


@query("stream_alerts", f"WITH {_NO_LOG} SELECT alert_id, user_id, article_id, channel, dedupe_key, priority FROM new")
def _(t):
    root = _run(t, "alerts", lambda out: jb.alert_job(_streams(t).articles, t.alerts, t.searches, t.sources, t.prefs, out, AS_OF))
    return jb.delivery_store(root).read(t.spark).select("alert_id", "user_id", "article_id", "channel", "dedupe_key", "priority")


@query("stream_dedupe", """WITH RECURSIVE ev AS (SELECT DISTINCT user_id, channel, dedupe_key, created_at AS ts FROM fx_deliveries),
    e(user_id, channel, dedupe_key, ts) AS (SELECT user_id, channel, dedupe_key, min(ts) FROM ev GROUP BY 1, 2, 3
      UNION ALL SELECT e.user_id, e.channel, e.dedupe_key, min(ev.ts) FROM e JOIN ev ON ev.user_id = e.user_id AND ev.channel = e.channel AND ev.dedupe_key = e.dedupe_key AND ev.ts >= e.ts + INTERVAL 6 HOUR GROUP BY ALL)
    SELECT user_id, channel, dedupe_key, ts AS emitted_at FROM e""")
def _(t):
    first = jb.dedupe_stream(_streams(t).deliveries, ["user_id", "channel", "dedupe_key"], "created_at", 6 * 3600)
    key = F.from_json("key", "user_id bigint, channel string, dedupe_key string")
    path = _run(t, "dedupe", lambda out: jb.append_job(first.select(key.alias("k"), "emitted_at").select("k.*", "emitted_at"), out))
    return t.spark.read.parquet(path)


_FLAG = {k: q.has_any("lower(coalesce(title,'') || ' ' || coalesce(summary,''))", w) for k, w in m.rules.FLAGS.items()}


@query("stream_activity", f"""WITH x AS (SELECT *, date_trunc('hour', coalesce(published_at, created_at)) AS h FROM fx_articles), w AS (SELECT x.*, h + to_hours(k + 1) AS window_end FROM x, range(24) r(k))
    SELECT window_end, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in _FLAG.items())} FROM w GROUP BY 1""")
def _(t):
    return jb.activity_windows(_table(t, "activity", jb.activity_stream(_streams(t).articles), ["pane_end"]))


@query("stream_daily", f"""SELECT date_trunc('day', started_at)::TIMESTAMP AS day, source_key, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(blocked) AS BIGINT) AS blocked, CAST(sum({ATT}) AS BIGINT) AS attempted
    FROM fx_runs WHERE NOT ({ATT} > 0 AND saved > {ATT}) GROUP BY 1, 2""")
def _(t):
    return _table(t, "daily", jb.daily_stream(_streams(t).runs), ["day", "source_key"])


@query("stream_late", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1")
def _(t):
    root = _run(t, "late", lambda out: jb.late_job(_streams(t).raw("events").select("ts"), "ts", out))
    return jb.late_store(root).read(t.spark)


@query("stream_cooldown", """WITH RECURSIVE ev AS (SELECT DISTINCT job_name || ':' || source_key AS key, started_at AS ts FROM fx_runs WHERE NOT ok),
    e(key, ts) AS (SELECT key, min(ts) FROM ev GROUP BY 1 UNION ALL SELECT e.key, min(ev.ts) FROM e JOIN ev ON ev.key = e.key AND ev.ts >= e.ts + INTERVAL 3 HOUR GROUP BY e.key)
    SELECT key, ts AS emitted_at FROM e""")
def _(t):
    bad = m.exploded_runs(_streams(t).runs.where("NOT ok")).select(F.concat_ws(":", "job_name", "source_key").alias("key"), "started_at")
    path = _run(t, "cooldown", lambda out: jb.append_job(jb.cooldown_stream(bad, "key", "started_at", 3 * 3600), out))
    return t.spark.read.parquet(path)


@query("stream_quotes", f"""SELECT instrument, rate_type, quote_currency, arg_max(value, (as_of, l_orderkey * 10 + l_linenumber + value / 1000000)) AS value, max(as_of) AS as_of, {T} AS fetched_at FROM fx_quotes GROUP BY ALL""")
def _(t):
    rows = _streams(t).quotes.select("instrument", "rate_type", "quote_currency", "value", "as_of", F.expr("l_orderkey * 10 + l_linenumber + value / 1000000").alias("seq"))
    root = _run(t, "quotes", lambda out: jb.quotes_job(rows, out, AS_OF))
    return jb.quote_store(root).read(t.spark)
