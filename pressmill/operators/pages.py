"""Landed pages to articles: quality gates, never-downgrade merges, tagging and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions import html as h, rules, summaries as sm, urls
from pressmill.functions.text import any_of, blank, contains_any, let, strip

from pressmill.functions.times import as_time, span
from pressmill.operators.fence import fence


# ---- page assessment -------------------------------------------------------------------------

def is_article_like(html: Column, text: Column, title: Column, url: Column) -> Column:
    t = strip(blank(title))
    p = F.rtrim(urls.path(url), F.lit("/"))
    marked = let(F.lower(blank(html)), lambda low: (
        (F.contains(low, F.lit('property="og:type"')) & F.contains(low, F.lit("article"))) | F.contains(low, F.lit("article:published_time"))
        | F.contains(low, F.lit("<article"))))
    size = F.length(strip(blank(text)))
    hinted = F.rlike(urls.path(url), F.lit(urls.ARTICLE_HINT)) | marked
    titled = (t != "") & ~F.startswith(t, F.lit("http"))
    # The markup is only searched where the length alone does not decide.
    return titled & ~p.isin("", "/en", "/ar") & (size >= 200) & ((size >= 600) | hinted)


def is_junk_page(title: Column, text: Column, density: Column) -> Column:
    n = F.length(strip(blank(text)))
    return (blank(title) == "") | (n < 600) | ((density > 0.02) & (n < 1200))


def content_quality(teaser: Column, blocked: Column, text: Column) -> dict[str, Column]:
    empty = blocked | (strip(blank(text)) == "")
    pick = lambda t, e, full: F.when(teaser, t).when(empty, e).otherwise(full)
    return {
        "content_kind": pick("teaser", "title_only", "full"),
        "verification_status": pick("partial", "blocked", "full"),
        "fetch_quality": pick(30, 0, 80),
    }


def read_pages(pages: DataFrame) -> DataFrame:
    """Title, text, time, language and article evidence of every page; no shuffle."""
    html = F.col("html")
    seen = fence(pages, v=h.visible(F.coalesce(html, F.lit(""))))
    parsed = fence(seen, title=h.title_of(F.col("v")), content=h.text_of(F.col("v")), anchors=h.anchors_of(F.col("v")), metas=h.metas_of(F.col("v")))
    return parsed.select(
        "page_id", "source_key", "url", "title", "content",
        h.published_of(F.col("v"), F.col("metas")).alias("published"), urls.language_from_url(F.col("url")).alias("language"),
        h.article_meta_of(html, F.col("metas")).alias("article_meta"), rules.blocked_text(html).alias("blocked_html"), "html",
        F.when(F.length("content") == 0, F.lit(1.0)).otherwise(F.col("anchors") / F.greatest(F.length("content"), F.lit(1))).alias("link_density"),
    )


def assess_pages(pages: DataFrame, thin: dict[str, int] | None = None, partial_sources: Sequence[str] = (),
                 no_meta_sources: Sequence[str] = ()) -> DataFrame:
    """Adds ``outcome``: saved, or why the page is skipped, in the order of the gates."""
    rows = read_pages(pages)
    n = F.length("content")
    src = F.col("source_key")
    partial = src.isin(*partial_sources) if partial_sources else F.lit(False)
    blocked = partial & (F.col("blocked_html") | rules.blocked_text(F.col("content")))
    is_thin = any_of((src == key) & (n < size) for key, size in (thin or {}).items())
    no_meta = ~F.col("article_meta") & ~(src.isin(*no_meta_sources) if no_meta_sources else F.lit(False))
    junk = is_junk_page(F.col("title"), F.col("content"), F.col("link_density")) & ~(partial & (blocked | (n == 0)))
    outcome = (
        F.when(~is_article_like(F.col("html"), F.col("content"), F.col("title"), F.col("url")), "not_article")
        .when(is_thin, "thin_content").when(no_meta, "no_article_meta").when(junk, "junk").otherwise("saved")
    )
    quality = content_quality(F.lit(False), blocked, F.col("content"))
    return rows.withColumn("outcome", outcome).withColumns(quality).drop("html").withColumn(
        "title", F.coalesce(F.nullif(F.col("title"), F.lit("")), urls.slug_title(F.col("url"))))


def page_reject_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("source_key").pivot(
        "outcome", ["saved", "not_article", "thin_content", "no_article_meta", "junk"]
    ).agg(F.count(F.lit(1))).na.fill(0)


def teaser_fallback(pages: DataFrame, teasers: DataFrame) -> DataFrame:
    """A page landed blank takes title and text of its listing teaser."""
    joined = pages.join(teasers.select("url", F.col("title").alias("t_title"), F.col("summary").alias("t_summary"), F.lit(True).alias("t_hit")), "url", "left")
    used = (strip(blank(F.col("html"))) == "") & F.col("html").isNotNull() & F.coalesce("t_hit", F.lit(False))
    return joined.withColumns({
        "used_teaser": used,
        "title": F.when(used, blank(F.col("t_title"))).otherwise(h.title(F.col("html"))),
        "content": F.when(used, blank(F.col("t_summary"))).otherwise(h.main_text(F.col("html"))),
    }).drop("t_title", "t_summary", "t_hit", "html")


# ---- stored quality --------------------------------------------------------------------------

QUALITY = ["content_kind", "verification_status", "fetch_quality"]
TEXTS = ["content", "title", "summary"]


def quality_merge(existing: DataFrame, incoming: DataFrame, key: str = "url", short_sources: Sequence[str] = (), min_full: int = 1800) -> DataFrame:
    """A lesser copy never replaces a better one; a stored text that is short or blocked may be replaced."""
    old = existing.select(key, *[F.col(c).alias(f"o_{c}") for c in [*QUALITY, *TEXTS]])
    rows = incoming.join(old, key, "left")
    stored = strip(blank(F.col("o_content")))
    short = F.lit(False)
    if short_sources:
        short = F.col("source_id").isin(*short_sources) & ((F.length(stored) < min_full) | rules.blocked_text(F.col("o_content")))
    rank = rules.quality_rank(F.col("content_kind"))
    keep = (rank < 3) & (rules.quality_rank(F.col("o_content_kind")) > rank) & ~short
    merged = {c: F.when(keep, F.coalesce(F.nullif(F.col(f"o_{c}"), F.lit("")), F.col(c))).otherwise(F.col(c))
              for c in [*TEXTS, "content_kind", "verification_status"]}
    merged["fetch_quality"] = F.when(keep, F.coalesce(F.nullif(F.col("o_fetch_quality"), F.lit(0)), F.col("fetch_quality"))).otherwise(F.col("fetch_quality"))
    return rows.select(*[merged.get(c, F.col(c)).alias(c) for c in incoming.columns])


def quality_backfill(feed: DataFrame, articles: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Fill missing quality: feed by what text it has, articles from the feed."""
    has, bare = blank(F.col("content")) != "", (blank(F.col("content")) == "") & (blank(F.col("summary")) == "")
    values = {"content_kind": ("full", "title_only"), "verification_status": ("full", "blocked"), "fetch_quality": (80, 0)}
    filled = feed.withColumns({c: F.coalesce(F.col(c), F.when(has, F.lit(a)).when(bare, F.lit(b))) for c, (a, b) in values.items()})
    src = filled.groupBy(key).agg(*[F.min_by(c, F.col("id")).alias(f"f_{c}") for c in QUALITY])
    joined = articles.join(src, key, "left")
    return filled, joined.select(*[F.coalesce(c, f"f_{c}").alias(c) if c in QUALITY else F.col(c) for c in articles.columns])


def refetch_upgrade(articles: DataFrame, refetched: DataFrame, key: str = "url", min_accept: int = 600, good: int = 2000) -> DataFrame:
    """Apply accepted refetched texts; ``refetch_result`` says what happened."""
    rows = articles.join(refetched.select(key, F.col("title").alias("n_title"), F.col("content").alias("n_content")), key, "left")
    n = F.length(strip(blank(F.col("n_content"))))
    result = (
        F.when(F.col("n_content").isNull(), "none").when(rules.blocked_text(F.col("n_content")), "blocked_html")
        .when(n < min_accept, "content_too_short").otherwise("ok")
    )
    ok = result == "ok"
    return rows.withColumns({
        "title": F.when(ok, F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("n_title"))).otherwise(F.col("title")),
        "content": F.when(ok, F.col("n_content")).otherwise(F.col("content")),
        "content_kind": F.when(ok, "full").otherwise(F.col("content_kind")),
        "verification_status": F.when(ok, "full").otherwise(F.col("verification_status")),
        "fetch_quality": F.when(ok, F.when(n >= good, 90).otherwise(70)).otherwise(F.col("fetch_quality")),
        "refetch_result": result,
    }).drop("n_title", "n_content")


def content_changed(existing: DataFrame, incoming: DataFrame, key: str = "url") -> DataFrame:
    """Compare content hashes; an unchanged article keeps its summary state."""
    old = existing.select(key, F.coalesce(F.nullif("content_hash", F.lit("")), F.sha2("content", 256)).alias("old_hash"),
                          F.col("summary_status").alias("old_status"))
    new_hash = F.sha2(blank(F.col("content")), 256)
    rows = incoming.join(old, key, "left").withColumn("content_hash", new_hash)
    changed = ~F.col("content_hash").eqNullSafe(F.col("old_hash"))
    return rows.withColumn("changed", changed).withColumn(
        "summary_status", F.when(changed, "PENDING").otherwise(F.col("old_status"))).drop("old_hash", "old_status")


# ---- tags ------------------------------------------------------------------------------------

def tag_articles(articles: DataFrame) -> DataFrame:
    title, summary = F.col("title"), F.col("summary")
    text = rules.headline_text(title, summary)
    flags = {f"is_{name}": flag for name, flag in rules.keyword_flags(title, summary).items()}
    return articles.withColumns({
        "category_guess": F.coalesce(F.nullif(F.col("category"), F.lit("")), rules.category(title, summary)),
        "sector": rules.sector(text), "tags": rules.tag_hits(text), **flags,
    })


def tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("tag"), "category_guess").groupBy("tag", "category_guess").agg(F.count(F.lit(1)).alias("n"))


def error_counts(runs_exploded: DataFrame) -> DataFrame:
    kind = rules.error_class(F.col("m.last_error"))
    return runs_exploded.groupBy("source_key", kind.alias("error_class")).agg(F.count(F.lit(1)).alias("n")).where("error_class IS NOT NULL")


# ---- summaries -------------------------------------------------------------------------------

def retry_eligible(articles: DataFrame, as_of, slow: bool = True, cooldown_min: int = 30, has_next: bool = True) -> DataFrame:
    """Articles whose summary is due: pending, deferred (slow mode), or timed out and past the wait."""
    wait = F.col("summary_next_attempt_at") if has_next else F.col("summary_updated_at") + span(minutes=cooldown_min)
    status = F.col("summary_status")
    ready = status.isin("PENDING", "DEFERRED_LONG") if slow else status == "PENDING"
    return articles.where(ready | ((status == "TIMEOUT") & (wait.isNull() | (wait <= as_time(as_of)))))


def legacy_attempts(error: Column) -> Column:
    return F.coalesce(F.regexp_extract(blank(error), r"(?s)attempt=\s*(\d+)\s*$", 1).try_cast("int"), F.lit(0))


def summary_route(articles: DataFrame, use_model: bool = False, min_chars: int = 600, min_words: int = 80,
                  model_min: int = 2200, defer_over: int = 12000) -> DataFrame:
    """Route of every article: skip, keep, fast path, junk, extractive (or left to the model)."""
    rows = articles.withColumn("cleaned", sm.plain_text(F.col("content")))
    cleaned, raw = F.col("cleaned"), F.col("content")
    same = F.coalesce(F.col("content_hash") == F.sha2(cleaned, 256), F.lit(False))
    n = F.length(cleaned)
    short = (n < min_chars) & (sm.word_count(cleaned) < min_words)
    long_route = F.lit("EXTRACTIVE")
    if use_model:
        long_route = F.when(n > defer_over, "DEFERRED_LONG").when(n < model_min, "SHORT_MODEL_MIN").otherwise("MODEL")
    route = (
        F.when(blank(raw) == "", "NO_CONTENT")
        .when((F.col("summary_status") == "DONE") & same, "HASH_SKIP")
        .when((F.col("summary_status") == "PENDING") & (blank(F.col("summary")) != "") & same, "KEEP_SUMMARY")
        .when(contains_any(F.lower(blank(F.col("url"))), rules.BRIEF_PATHS), "BRIEF_EXTRACTIVE")
        .when(cleaned == "", "NO_TEXT").when(short, "SHORT_BOTH")
        .when(sm.is_junk(raw), sm.junk_reason(raw)).otherwise(long_route)
    )
    return rows.withColumn("route", route)


def summarize(articles: DataFrame, as_of, **limits: int) -> DataFrame:
    """Route, summary, new status and hashes of due articles."""
    rows = summary_route(articles, **limits)
    route, cleaned, title = F.col("route"), F.col("cleaned"), F.col("title")
    text = (
        F.when(route.isin("BRIEF_EXTRACTIVE", "EXTRACTIVE"), sm.extractive_summary(cleaned, title))
        .when(route == "NO_TEXT", blank(title)).when(route.isin("SHORT_BOTH", "SHORT_MODEL_MIN"), sm.fast_summary(cleaned))
        .when(route.isin("KEEP_SUMMARY", "HASH_SKIP"), F.col("summary")).otherwise("")
    )
    rows = rows.withColumn("new_summary", text)
    made = F.col("new_summary") != ""
    status = (
        F.when(route.isin("NO_CONTENT", "MODEL"), F.col("summary_status")).when(route.isin("HASH_SKIP", "KEEP_SUMMARY"), "DONE")
        .when(F.startswith(route, F.lit("JUNK")), "SKIPPED_JUNK").when(route == "DEFERRED_LONG", "DEFERRED_LONG")
        .when(made, "DONE_FASTPATH").otherwise("ERROR")
    )
    error = (
        F.when(F.startswith(route, F.lit("JUNK")), F.concat(route, F.lit(" attempt=0")))
        .when(route == "DEFERRED_LONG", "deferred_long_content attempt=0").when(status == "ERROR", "empty_summary attempt=1")
    )
    return rows.withColumns({
        "new_status": status, "summary_error": error, "new_content_hash": F.sha2(cleaned, 256),
        "summary_hash": F.when(made, F.sha2("new_summary", 256)), "updated_at": as_time(as_of),
    })


def summary_run_stats(done: DataFrame) -> DataFrame:
    st, route = F.col("new_status"), F.col("route")
    return done.where(route != "NO_CONTENT").groupBy("source").agg(
        F.count(F.lit(1)).alias("picked"),
        F.count_if((st == "DONE") & (route != "HASH_SKIP")).alias("done"), F.count_if(st == "DONE_FASTPATH").alias("fastpath"),
        F.count_if(st == "SKIPPED_JUNK").alias("junk"), F.count_if(route == "HASH_SKIP").alias("hash_skip"),
        F.count_if(st == "ERROR").alias("failed"),
    )
