"""Saved-search alerts: matching, duplicate windows, queueing, due deliveries, digests and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressmill.functions import urls
from pressmill.functions.text import blank, normalize_title, strip, tokens
from pressmill.functions.times import as_time, before, effective_from, span
from pressmill.operators.fence import fence
from pressmill.operators.ordered import top_k
from pressmill.operators.search import asked_postings, total_sql
from pressmill.operators.tables import substring_pairs
from pressmill.operators.writes import pref_defaults
from pressmill.session import settle

NONE = "\u0002"
MATCH_LIMIT = 50
#: Articles of a lookup word in one slice, and slices of the mark that every article has.
HOT, MARK_PARTS = 100_000, 64
#: Widths of the time slices of which the best rows are stored, in microseconds: equal times, minutes, hours, days, 32 days.
LADDER = [1, 60_000_000, 3_600_000_000, 86_400_000_000, 32 * 86_400_000_000]
OVERLAP_SEC = 86_400
MAX_ATTEMPTS = 5


# ---- requests and preferences ----------------------------------------------------------------

def alert_requests(alerts: DataFrame, searches: DataFrame, as_of, cursors: DataFrame | None = None) -> DataFrame:
    """Active alerts with their search and the time to look back to: cursor minus overlap, else the days window."""
    s = searches.select(
        F.col("id").alias("saved_search_id"), "name", strip(blank(F.col("query"))).alias("query"),
        F.coalesce(F.nullif("days", F.lit(0)), F.lit(7)).alias("days"), F.nullif("category", F.lit("")).alias("category"), F.nullif("source", F.lit("")).alias("source"))
    rows = alerts.where("active").select(F.col("id").alias("alert_id"), "user_id", "channel", "target", "saved_search_id").join(s, "saved_search_id")
    start = as_time(as_of) - F.make_dt_interval(F.col("days").cast("int"))
    if cursors is None:
        return rows.withColumn("start_ts", start)
    return rows.join(cursors.select("alert_id", "last_ts"), "alert_id", "left").withColumn(
        "start_ts", F.coalesce(F.col("last_ts") - span(seconds=OVERLAP_SEC), start)).drop("last_ts")


def effective_prefs(users: DataFrame, prefs: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """Preferences with defaults. A missing category list inherits the global one, an empty list means none."""
    defaults = pref_defaults()
    none_global = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")

    def value(c: str) -> Column:
        stored = F.col(c)
        if c == "dedupe_window_sec":
            stored = F.nullif(c, F.lit(0))
        elif c == "digest_schedule":
            stored = F.nullif(c, F.lit(""))
        else:
            stored = F.when(F.size(c) > 0, F.col(c))
        return F.coalesce(stored, defaults[c]).alias(c)

    joined = users.select("user_id").distinct().join(prefs.withColumn("_p", F.lit(True)), "user_id", "left")
    return joined.select("user_id", *[value(c) for c in defaults], F.coalesce("priority_categories", none_global).alias("priority_categories"),
                         F.when(F.col("_p"), "db").otherwise("env").alias("prefs_source"))


def priority(query: Column, category: Column, categories: Column) -> Column:
    low = F.lower(strip(blank(category)))
    return F.when(strip(blank(query)) != "", "P0").when((low != "") & F.coalesce(F.array_contains(categories, low), F.lit(False)), "P1").otherwise("P2")


def dedupe_key(url: Column, source_name: Column, title: Column, ts: Column, item_id: Column) -> Column:
    """Canonical URL, else source|title|day of what is there, else the id."""
    parts = F.concat_ws("|", F.nullif(F.lower(strip(blank(source_name))), F.lit("")), F.nullif(normalize_title(title), F.lit("")), F.date_format(ts, "yyyy-MM-dd"))
    return F.coalesce(F.nullif(urls.canonical_alert(url), F.lit("")), F.nullif(parts, F.lit("")), F.concat(F.lit("unknown:"), item_id.cast("string")))


# ---- matching --------------------------------------------------------------------------------

def query_clauses(requests: DataFrame) -> DataFrame:
    """Distinct query texts as clauses of (wanted, excluded) word lists. The grammar is that of ``search.web_query``."""
    queries = requests.where("query <> ''").select("query").distinct()
    items = F.regexp_extract_all("query", F.lit(r'-?(?:"[^"]*"|[^\s"]+)'), F.lit(0))
    is_or = lambda x: F.lower(x) == "or"
    rows = fence(queries, items=items)
    read = F.transform("items", lambda x, i: F.struct(
        F.startswith(x, F.lit("-")).alias("minus"), F.when(is_or(x), F.array().cast("array<string>")).otherwise(tokens(x)).alias("words"),
        F.size(F.filter(F.slice(F.col("items"), F.lit(1), i), is_or)).alias("clause")))
    rows = fence(rows, read=read).withColumn("clause", F.explode(F.sequence(F.lit(0), F.size(F.filter("items", is_or)))))
    side = lambda minus: F.transform(F.filter(
        "read", lambda r: (r["clause"] == F.col("clause")) & (r["minus"] == F.lit(minus)) & (F.size(r["words"]) > 0)), lambda r: r["words"])
    rows = fence(rows, pos=side(False), neg=side(True)).where((F.size("pos") > 0) | (F.size("neg") > 0))
    return rows.select("query", "clause", "pos", "neg")


def clause_lookups(clauses: DataFrame, counts: DataFrame) -> DataFrame:
    """Clauses with the word they are looked up by: of the wanted words the one in the fewest articles (``counts``: token, n). A clause with
    a wanted word that no article has is left out. A clause of exclusions only is looked up by the mark every article has. Adds ``parts``, the
    number of slices that the lookup word's articles are dealt into."""
    wanted = clauses.select("query", "clause", F.explode_outer(F.array_distinct(F.flatten("pos"))).alias("token"))
    rarest = wanted.join(counts, "token", "left").groupBy("query", "clause").agg(
        F.min_by(F.struct("token", "n"), F.struct("n", "token")).alias("r"), F.count_if(F.col("token").isNotNull() & F.col("n").isNull()).alias("lost"))
    found = clauses.join(rarest.where("lost = 0"), ["query", "clause"])
    none = F.col("r.token").isNull()
    return found.select("query", "clause", "pos", "neg", F.when(none, NONE).otherwise(F.col("r.token")).alias("token"),
                        F.when(none, MARK_PARTS).otherwise(F.ceil(F.col("r.n") / HOT)).cast("int").alias("parts"))


def query_hits(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """(query, id, rank) of every distinct query text: a reverse index of the clauses, keyed by their rarest word.

    Of the articles' words only those that some clause asks for leave the pass over the texts, with their places, and are stored once; a
    text's words are never shuffled. A lookup word of more than ``HOT`` articles is dealt into slices by article. Clauses of one word
    are ranked by the places that come with the lookup; the others meet the stored places of their articles.
    """
    clauses = settle(query_clauses(requests).withColumn("words", F.array_distinct(F.flatten(F.flatten(F.array("pos", "neg"))))))
    asked = clauses.select(F.explode("words").alias("token")).distinct()
    posted = settle(asked_postings(articles, asked))
    lookups = clause_lookups(clauses, posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"))).join(clauses.select("query", "clause", "words"), ["query", "clause"])
    lookups = settle(lookups)
    hot = lookups.where("parts > 1").select("token", "parts").distinct()
    # Only where some clause has exclusions alone do all articles come in, by their ids.
    everywhere = articles.where(lookups.agg(F.count_if(F.col("token") == NONE) > 0).scalar())
    marked = everywhere.select(F.lit(NONE).alias("token"), "id", F.array().cast("array<int>").alias("positions"))
    dealt = posted.unionByName(marked).join(hot, "token", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    spread = lookups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    pairs = dealt.join(spread, ["token", "part"]).select("id", "query", "pos", "neg", "words", "token", "positions")

    alone = (F.size("words") == 1) & (F.col("token") != NONE)
    own = pairs.where(alone).withColumn("held", F.array(F.struct("token", "positions")))
    held = posted.groupBy("id").agg(F.collect_list(F.struct("token", "positions")).alias("held"))
    met = pairs.where(~alone).join(held, "id", "left")
    cols = ["id", "query", "pos", "neg", "words", "held"]
    placed = F.transform(F.filter("held", lambda h: F.array_contains("words", h["token"])), lambda h: F.transform(h["positions"], lambda i: F.struct(i.alias("i"), h["token"].alias("x"))))
    rows = fence(own.select(cols).unionByName(met.select(cols)), e=F.coalesce(F.array_sort(F.flatten(placed)), F.array().cast("array<struct<i: int, x: string>>")))
    ranked = fence(rows.withColumn("c", F.array(F.struct("pos", "neg"))), r=F.expr(total_sql("e", "c"))).where(F.col("r").isNotNull())
    return ranked.groupBy("query", "id").agg(F.round(F.sum("r"), 6).alias("rank"))


def source_patterns(requests: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_ref, pattern): which source filters an article's source satisfies, by any of its four names."""
    dim = sources.select(F.col("id").cast("string").alias("source_id"), F.col("name").alias("dim_name"))
    refs = articles.select("source", "source_id", "source_name").distinct().join(dim, "source_id", "left")
    names = refs.select(source_ref().alias("source_ref"), F.explode(F.array("source_name", "source", "source_id", "dim_name")).alias("n")).where("n IS NOT NULL")
    names = names.select("source_ref", F.lower("n").alias("n"))
    asked = requests.where("source IS NOT NULL").select(F.col("source").alias("pattern"), F.lower("source").alias("p")).distinct()
    hits = substring_pairs(names, "n", asked, "p", wildcards=True)
    return hits.join(names, "n").join(asked, "p").select("source_ref", "pattern").distinct()


def source_ref() -> Column:
    return F.concat_ws(NONE, blank(F.col("source")), blank(F.col("source_id")), blank(F.col("source_name")))


def scope(query: Column, category: Column, source: Column) -> Column:
    none = F.lit(NONE)
    return F.concat_ws("\u0001", query, F.coalesce(category, none), F.coalesce(source, none))


def scoped(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each row under every scope it can belong to: with or without its category, with or without each source filter."""
    grouped = patterns.groupBy("source_ref").agg(F.collect_set("pattern").alias("patterns"))
    joined = rows.withColumn("source_ref", source_ref()).join(grouped, "source_ref", "left")
    opts = F.array_append(F.coalesce("patterns", F.array().cast("array<string>")), F.lit(None).cast("string"))
    cats = F.array_distinct(F.array(F.lit(None).cast("string"), F.col("category")))
    wide = joined.withColumn("o", F.explode(opts)).withColumn("k", F.explode(cats))
    return wide.withColumn("scope", scope(F.col("query"), F.col("k"), F.col("o"))).select("scope", "id", "ts", "rank")


def rungs(ts: str, name: str, later: bool) -> Column:
    """One row for each width of ``LADDER``: ``level``, the slice of a time as ``name`` (or the one after it; of equal times always its own), and
    ``parent``, the slice of the next width that it is part of (0 at the top)."""
    at = F.unix_micros(F.to_timestamp(ts))
    wider = [F.floor(at / F.lit(w)) for w in LADDER[1:]] + [F.lit(0).cast("long")]
    return F.inline(F.array(*[
        F.struct(F.lit(k).alias("level"), (F.floor(at / F.lit(w)) + F.lit(int(later and k > 0))).alias(name), wider[k].alias("parent")) for k, w in enumerate(LADDER)]))


def from_ladder(found: DataFrame, asking: DataFrame, limit: int) -> DataFrame:
    """(scope, start_ts, id, ts, rank): rows among which are the best ``limit`` of each asked scope from ``start_ts`` on.

    Each scope has a ladder of time slices with the best ``limit`` rows of each. Of each width a start reads the later parts of the wider
    slice in which it lies: an equi join, with at most ``limit`` rows for each part. Parts that no start reads are not ranked: all
    32 days after the first start, but hours only of the days with a start, and so on.
    """
    wanted = asking.select("scope", "start_ts", rungs("start_ts", "first", True))
    read = wanted.groupBy("scope", "level", "parent").agg(F.min("first").alias("low"))
    parts = found.select("scope", "id", "ts", "rank", rungs("ts", "node", False)).join(read, ["scope", "level", "parent"]).where("node >= low").drop("low")
    slices = top_k(parts, ["scope", "level", "node", "parent"], [F.desc("rank"), F.desc("ts"), F.desc("id")], limit, F.col("id"))
    return wanted.join(slices, ["scope", "level", "parent"]).where("node >= first").select("scope", "start_ts", "id", "ts", "rank")


def with_scope(requests: DataFrame) -> DataFrame:
    return requests.withColumn("scope", scope(F.col("query"), F.col("category"), F.col("source")))


def scope_matches(reqs: DataFrame, articles: DataFrame, sources: DataFrame, limit: int = MATCH_LIMIT) -> DataFrame:
    """(scope, start_ts, id, ts, rank, match_no): the best ``limit`` articles of each distinct wish and look-back, by rank, then newest.

    Alerts that ask for the same thing share one scope, worked out once. Of a scope an alert only needs the
    newest rows when there is no query text, and otherwise the best rows of the time slices that make up its
    look-back (``from_ladder``). So a popular query is never multiplied with all its alerts.
    """
    ts = F.coalesce("published_at", "created_at")
    # No alert looks back further than this, so older rows are not read.
    articles = articles.where(effective_from(reqs.agg(F.min("start_ts")).scalar()))
    scopes = reqs.select("scope", (F.col("query") != "").alias("text")).distinct()
    patterns = source_patterns(reqs, articles, sources)
    base = articles.select("id", ts.alias("ts"), "category", "source", "source_id", "source_name").where(F.col("ts").isNotNull())

    plain = scoped(base.withColumn("query", F.lit("")).withColumn("rank", F.lit(0.0)), patterns)
    plain = plain.join(scopes.where("NOT text").select("scope"), "scope", "left_semi")
    newest = top_k(plain, ["scope"], [F.desc("ts"), F.desc("id")], limit, F.col("id"))
    # Alerts of one scope and one time have the same matches: these are picked once and then given to each of them.
    starts = reqs.select("scope", "start_ts", (F.col("query") != "").alias("text")).distinct()
    quick = starts.where("NOT text").join(newest, "scope").where("ts >= start_ts")

    found = scoped(query_hits(reqs, articles).join(base, "id"), patterns)
    found = settle(found.join(scopes.where("text").select("scope"), "scope", "left_semi"))
    ranked = from_ladder(found, starts.where("text"), limit)
    cols = ["scope", "start_ts", "id", "ts", "rank"]
    # A start has at most ``limit`` rows of each slice here.
    return top_k(quick.select(cols).unionByName(ranked.select(cols)), ["scope", "start_ts"], [F.desc("rank"), F.desc("ts"), F.desc("id")], limit, F.col("id"), "match_no", salts=1)


def alert_matches(requests: DataFrame, articles: DataFrame, sources: DataFrame, as_of, limit: int = MATCH_LIMIT) -> DataFrame:
    """Best ``limit`` articles of every alert: those of its scope and look-back (``scope_matches``)."""
    reqs = with_scope(requests)
    best = scope_matches(reqs, articles, sources, limit)
    return reqs.select("alert_id", "scope", "start_ts").join(best, ["scope", "start_ts"]).select("alert_id", "id", "ts", "rank", "match_no")


# ---- queueing --------------------------------------------------------------------------------

def article_keys(ids: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, normalized_url, dedupe_key) of the articles whose ``id`` is in ``ids``."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("dim_name"))
    items = articles.join(ids, "id", "left_semi").select("id", "url", "title", "source_id", F.coalesce("published_at", "created_at").alias("ts")).join(names, "source_id", "left")
    return items.select("id", urls.canonical_alert(F.col("url")).alias("normalized_url"),
                        dedupe_key(F.col("url"), F.col("dim_name"), F.col("title"), F.col("ts"), F.col("id")).alias("dedupe_key"))


def keyed_matches(matches: DataFrame, requests: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    rows = matches.select("alert_id", "id").join(article_keys(matches.select("id").distinct(), articles, sources), "id")
    return rows.join(requests.select("alert_id", "user_id", "channel", "query", "category"), "alert_id").withColumnRenamed("id", "article_id")


def not_recent(rows: DataFrame, deliveries: DataFrame, prefs: DataFrame, as_of) -> DataFrame:
    """Drop keys queued for the same user and channel inside the user's window, whatever became of them."""
    windows = prefs.select("user_id", "dedupe_window_sec")
    longest = windows.agg(F.max("dedupe_window_sec")).scalar()
    late = deliveries.where(F.col("created_at") >= as_time(as_of) - span(seconds=longest)).join(windows, "user_id")
    late = late.where(F.col("created_at") >= as_time(as_of) - span(seconds=F.col("dedupe_window_sec"))).select("user_id", "channel", "dedupe_key").distinct()
    return rows.join(windows.select("user_id"), "user_id", "left_semi").join(late, ["user_id", "channel", "dedupe_key"], "left_anti")


def allowed(rows: DataFrame, deliveries: DataFrame, prefs: DataFrame, as_of) -> DataFrame:
    """Rows whose key is not recent and whose channel the user has enabled."""
    fresh = not_recent(rows, deliveries, prefs, as_of)
    return fresh.join(prefs.select("user_id", "channels_enabled", "priority_categories"), "user_id").where(F.array_contains("channels_enabled", F.col("channel")))


def first_alerts(new: DataFrame, as_of) -> DataFrame:
    """The delivery rows: of each user, channel and key those of the first alert."""
    keys = ["user_id", "channel", "dedupe_key"]
    first = new.groupBy(*keys).agg(F.min("alert_id").alias("alert_id"))
    rows = new.join(first, [*keys, "alert_id"], "left_semi")
    return rows.select(
        "alert_id", "user_id", "article_id", "channel", F.lit("PENDING").alias("status"), F.lit(0).alias("attempt_count"),
        as_time(as_of).alias("next_attempt_at"), as_time(as_of).alias("queued_at"), "dedupe_key", F.col("dedupe_key").alias("dedupe_group"),
        F.nullif("normalized_url", F.lit("")).alias("normalized_url"),
        priority(F.col("query"), F.col("category"), F.col("priority_categories")).alias("priority"), as_time(as_of).alias("created_at"))


def enqueue(keyed: DataFrame, deliveries: DataFrame, prefs: DataFrame, as_of) -> DataFrame:
    """New delivery rows. Order matters: what is already queued adds no row and so does not hold back a later alert."""
    chosen = allowed(keyed, deliveries, prefs, as_of)
    new = settle(chosen.join(deliveries.select("alert_id", "article_id", "channel"), ["alert_id", "article_id", "channel"], "left_anti"))
    return first_alerts(new, as_of)


def enqueue_scopes(reqs: DataFrame, best: DataFrame, keys: DataFrame, deliveries: DataFrame, prefs: DataFrame, as_of) -> DataFrame:
    """New delivery rows, as ``enqueue`` gives them for the matches of every alert, without a row for each alert and match.

    ``reqs``: alerts with their scope; ``best``: ``scope_matches``; ``keys``: ``article_keys``. A user's alerts of one channel, scope and
    look-back have the same matches, and only the first of them that has not yet queued an article can add a row for it. So matches meet such
    groups of alerts, by their first alert. Where alerts of the group have queued the article, their numbers in the group tell the first that
    has not: the queued numbers that equal their own place in order are a run from 1 on, and the next number is free.
    """
    group = ["user_id", "channel", "scope", "start_ts"]
    numbered = reqs.select("alert_id", *group, F.row_number().over(Window.partitionBy(*group).orderBy("alert_id")).alias("no"))
    groups = reqs.groupBy(*group).agg(F.min("alert_id").alias("lead"), F.first("query").alias("query"), F.first("category").alias("category"))
    offers = allowed(groups.join(best.select("scope", "start_ts", "id"), ["scope", "start_ts"]).join(keys, "id").withColumnRenamed("id", "article_id"), deliveries, prefs, as_of)

    queued = deliveries.select("alert_id", "article_id", "channel").distinct().join(numbered, ["alert_id", "channel"])
    queued = queued.join(best.select("scope", "start_ts", F.col("id").alias("article_id")), ["scope", "start_ts", "article_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy(*group, "article_id").orderBy("no"))
    free = queued.withColumn("place", place).groupBy(*group, "article_id").agg((F.coalesce(F.max(F.when(F.col("no") == F.col("place"), F.col("no"))), F.lit(0)) + 1).alias("no"))
    later = free.join(numbered, [*group, "no"], "left").select(*group, "article_id", F.lit(True).alias("met"), "alert_id")
    new = offers.join(later, [*group, "article_id"], "left").withColumn("alert_id", F.when(F.col("met"), F.col("alert_id")).otherwise(F.col("lead")))
    return first_alerts(settle(new.where(F.col("alert_id").isNotNull()).drop("met", "lead")), as_of)


def run_cycle(alerts: DataFrame, searches: DataFrame, cursors: DataFrame, articles: DataFrame, sources: DataFrame, deliveries: DataFrame,
              prefs: DataFrame, as_of, limit: int = MATCH_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(new deliveries, newest match of each alert as ``alert_id, ts``). Write the deliveries before the cursors."""
    reqs = settle(with_scope(alert_requests(alerts, searches, as_of, cursors)))
    best = settle(scope_matches(reqs, articles, sources, limit))
    newest = best.groupBy("scope", "start_ts").agg(F.max("ts").alias("ts")).join(reqs.select("alert_id", "scope", "start_ts"), ["scope", "start_ts"]).select("alert_id", "ts")
    keys = article_keys(best.select("id").distinct(), articles, sources)
    return enqueue_scopes(reqs, best, keys, deliveries, effective_prefs(reqs, prefs), as_of), newest


# ---- due deliveries and digests --------------------------------------------------------------

def cap_due(due: DataFrame, n: int) -> DataFrame:
    """At most ``n`` per alert by due time, then ``n`` per user in alert order."""
    per_alert = top_k(due, ["alert_id", "channel"], [F.col("next_attempt_at"), F.col("id")], n, F.col("id"), "alert_no")
    return top_k(per_alert, ["user_id"], [F.col("alert_id"), F.col("alert_no"), F.col("id")], n, F.col("id"), "user_no")


def alert_due(deliveries: DataFrame, alerts: DataFrame, prefs: DataFrame, as_of, n: int = 25, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Retryable and due rows of active alerts; the caps are used up before the priority filter."""
    ready = deliveries.where(F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt_at") <= as_time(as_of)) & (F.col("attempt_count") < max_attempts))
    active = alerts.where("active").select(F.col("id").alias("alert_id"), "target", "channel")
    capped = cap_due(ready.join(active, ["alert_id", "channel"]), n)
    wanted = effective_prefs(capped, prefs).select("user_id", F.concat("immediate_priorities", "digest_priorities").alias("wanted"))
    return capped.join(wanted, "user_id").where(F.array_contains("wanted", F.col("priority"))).drop("wanted")


def due_articles(due: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Due rows with their article; ``missing`` marks the ones whose article is gone."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    items = articles.select(F.col("id").alias("article_id"), "title", "url", "summary", "source_id", F.lit(True).alias("_a"))
    return due.join(items, "article_id", "left").join(names, "source_id", "left").withColumn("missing", F.col("_a").isNull()).drop("_a")


def alert_digest(ready: DataFrame, batch: int = 50, brand: str = "your searches") -> DataFrame:
    """One message per alert and batch. A batch has at most ``batch`` rows, so its text is built in one row."""
    rows = ready.where("NOT missing").withColumn("batch_no", F.floor((F.col("alert_no") - 1) / batch))
    key = F.coalesce("dedupe_key", F.col("article_id").cast("string"))
    groups = rows.groupBy("alert_id", "batch_no", key.alias("key")).agg(
        F.min("alert_no").alias("at"), F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct("alert_no", "title", "url", "summary", "source_name"))).alias("items"))
    first = F.get(F.col("items"), 0)
    names = F.filter(F.transform("items", lambda x: strip(blank(x["source_name"]))), lambda x: x != "")
    # Sources are distinct without regard to case, in order of their first item.
    distinct = F.filter(F.col("names"), lambda x, i: ~F.exists(F.slice(F.col("names"), F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    held = fence(groups, names=names)
    held = fence(held, srcs=distinct)
    extra = F.size("srcs") - 3
    src_line = F.when(F.size("srcs") > 0, F.concat(F.lit("Sources: "), F.array_join(F.slice("srcs", 1, 3), ", "),
                      F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise("")))
    summary, link = strip(blank(first["summary"])), strip(blank(first["url"]))
    block = F.concat_ws("\n", F.nullif(strip(blank(first["title"])), F.lit("")), src_line,
                        F.when(summary != "", F.concat(F.lit("\n"), F.left(summary, F.lit(600)))), F.when(link != "", F.concat(F.lit("\n"), link)))
    blocks = held.select("alert_id", "batch_no", "at", "n", strip(block).alias("block"))
    text = blocks.groupBy("alert_id", "batch_no").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("items"), F.sort_array(F.collect_list(F.struct("at", "block"))).alias("b"))
    return text.select("alert_id", "batch_no", "groups", "items", F.concat(
        F.col("items").cast("string"), F.lit(f" new items from {brand}\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n")).alias("message"))


# ---- outcomes and health ---------------------------------------------------------------------

def delivery_result(deliveries: DataFrame, outcomes: DataFrame, as_of, base: int = 60, cap: int = 3600, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Apply send outcomes (alert_id, article_id, channel, ok, error): backoff doubles up to the cap. Success clears the error and
    sets ``delivered_at``; rows without an outcome stay as they are."""
    keys = ["alert_id", "article_id", "channel"]
    result = outcomes.groupBy(*keys).agg(F.bool_or("ok").alias("_ok"), F.max("error").alias("_err"))
    rows = deliveries.join(result, keys, "left")
    hit, ok = F.col("_ok").isNotNull(), F.coalesce("_ok", F.lit(False))
    tries = F.col("attempt_count") + 1
    wait = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(tries - 1, F.lit(0))))
    return rows.withColumns({
        "status": F.when(~hit, F.col("status")).when(ok, "SENT").otherwise("FAILED"),
        "error": F.when(~hit, F.col("error")).when(~ok, F.left("_err", F.lit(500))),
        "delivered_at": F.when(hit & ok, as_time(as_of)).otherwise(F.col("delivered_at")),
        "attempt_count": F.when(hit, tries).otherwise(F.col("attempt_count")),
        "last_attempt_at": F.when(hit, as_time(as_of)).otherwise(F.col("last_attempt_at")),
        "next_attempt_at": F.when(~hit, F.col("next_attempt_at")).when(ok, as_time(as_of)).otherwise(as_time(as_of) + span(seconds=wait)),
        "gave_up": hit & ~ok & (tries >= max_attempts),
    }).drop("_ok", "_err")


def backlog_health(deliveries: DataFrame, as_of, max_attempts: int = MAX_ATTEMPTS, warn_count: int = 200, warn_age: int = 3600) -> DataFrame:
    """One pass over the queue. A row without a next time counts as due here."""
    now = as_time(as_of)
    open_ = F.col("status").isin("PENDING", "FAILED") & (F.col("attempt_count") < max_attempts)
    nxt = F.col("next_attempt_at")
    secs = lambda a, b: F.coalesce(F.unix_seconds(F.to_timestamp(b)) - F.unix_seconds(F.to_timestamp(a)), F.lit(0))
    sums = deliveries.agg(
        F.count_if(open_).alias("pending_count"), F.count_if(open_ & (nxt.isNull() | (nxt <= now))).alias("pending_due_count"),
        F.min(F.when(open_ & ~F.col("queued_at_is_estimated"), F.col("queued_at"))).alias("oldest"),
        F.min(F.when(open_ & (nxt > now), nxt)).alias("next_due"),
        F.count_if(open_ & F.col("queued_at_is_estimated")).alias("queued_at_estimated"),
        F.count_if((F.col("status") == "FAILED") & (F.col("attempt_count") >= max_attempts)).alias("giveup_count"))
    rows = sums.select("pending_count", "pending_due_count", secs(F.col("oldest"), now).alias("oldest_age_sec"), secs(now, F.col("next_due")).alias("next_due_in_sec"),
                       "queued_at_estimated", "giveup_count")
    return rows.withColumn("warn", (F.col("pending_due_count") >= warn_count) | (F.col("oldest_age_sec") >= warn_age))


def priority_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def dedupe_groups(deliveries: DataFrame, as_of, days: int = 1, at_least: int = 2, top: int = 200) -> DataFrame:
    rows = deliveries.where(F.col("created_at") >= before(as_of, days=days)).groupBy("user_id", "channel", "dedupe_key").agg(
        F.count(F.lit(1)).alias("seen_count"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
    return rows.where(F.col("seen_count") >= at_least).orderBy(F.desc("last_seen_at"), "user_id", "channel", "dedupe_key").limit(top)


def queued_at_repair(deliveries: DataFrame) -> DataFrame:
    """Fill a missing queue time and mark it estimated; where a reliable time exists the mark is taken back."""
    delivered = F.col("delivered_at") if "delivered_at" in deliveries.columns else F.lit(None).cast("timestamp_ntz")
    known = F.coalesce(F.col("created_at"), F.col("last_attempt_at"), delivered)
    missing = F.col("queued_at").isNull()
    estimated = missing | F.col("queued_at_is_estimated")
    filled = F.coalesce("queued_at", known, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return deliveries.withColumns({
        "queued_at": F.when(estimated & known.isNotNull(), known).otherwise(filled),
        "queued_at_is_estimated": estimated & known.isNull(),
    })


# ---- fetch queue -----------------------------------------------------------------------------

def queue_claim(queue: DataFrame, as_of, n: int) -> DataFrame:
    """The next due rows of each source, now running with one more attempt."""
    due = queue.where((F.col("status") == "queued") & (F.col("next_run_at") <= as_time(as_of)))
    picked = top_k(due, ["source_id"], [F.col("next_run_at"), F.col("id")], n, F.col("id"), "slot")
    return picked.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1}).drop("slot")


def queue_skip_full(claimed: DataFrame, articles: DataFrame) -> DataFrame:
    full = articles.where("content_kind = 'full'").select("url").distinct().withColumn("_full", F.lit(True))
    return claimed.join(full, "url", "left").withColumn("status", F.when(F.col("_full"), "done").otherwise(F.col("status"))).drop("_full")


def queue_result(queue: DataFrame, outcomes: DataFrame, as_of, max_attempts: int = 5) -> DataFrame:
    """Outcomes (id, ok, error): done, dead, or queued again after a growing wait or the server's own."""
    rows = queue.join(outcomes.select("id", "ok", F.left("error", F.lit(200)).alias("_err")), "id", "left")
    # Waits in seconds after the first, second, ... failure.
    waits = F.array(*map(F.lit, [600, 1800, 7200, 43200]))
    wait = F.element_at(waits, F.greatest(F.lit(1), F.least(F.col("attempts"), F.lit(4))).cast("int"))
    asked = F.regexp_extract("_err", r"^blocked_html:retry_after=\s*(\d+)\s*$", 1).try_cast("int")
    wait = F.when(F.startswith("_err", F.lit("blocked_html:retry_after=")), F.greatest(F.coalesce(asked, wait), F.lit(3600))).otherwise(wait)
    dead = F.col("attempts") >= max_attempts
    failed = ~F.col("ok")
    return rows.withColumns({
        "status": F.when(F.col("ok"), "done").when(failed & dead, "dead").when(failed, "queued").otherwise(F.col("status")),
        "last_error": F.when(F.col("ok"), None).when(failed, F.col("_err")).otherwise(F.col("last_error")),
        "next_run_at": F.when(failed & ~dead, as_time(as_of) + span(seconds=wait)).otherwise(F.col("next_run_at")),
    }).drop("ok", "_err")


