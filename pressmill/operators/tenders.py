"""Procurement notices to tenders, and the weekly digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions import html as h, rules
from pressmill.functions.text import arabic_digits_to_ascii, blank, contains_any, lead_words, let, strip
from pressmill.functions.times import before
from pressmill.operators.fence import fence
from pressmill.operators.ordered import first_per_key, top_k

# Phrases before a deadline, tried in this order.
DEADLINE_PHRASES = [
    "آخر موعد|موعد تقديم العروض|تقديم العروض|آخر موعد للتقديم|آخر موعد لاستلام",
    "Submission deadline|Closing date",
]

# Date forms, tried in this order; the pattern keeps two- and four-digit years apart.
DATE_FORMS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"), (r"^\d{1,2}/\d{1,2}\s+\d{4}$", "M/d yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
]


def parse_date(text: Column) -> Column:
    tidy = F.regexp_replace(text, r"\s+", " ")
    return F.coalesce(*[F.when(F.rlike(tidy, F.lit(p)), F.try_to_date(tidy, fmt)) for p, fmt in DATE_FORMS])


def before_dates(text: Column, reach: int = 100) -> Column:
    """The dates of a text, each with up to ``reach`` characters before it: all that a phrase with a date can match, so that the costly
    pattern does not walk through whole texts. Digits may be Arabic."""
    digit = "[0-9٠-٩]"
    date = rf"{digit}{{1,2}}[/\-]{digit}{{1,2}}[/\-]{digit}{{2,4}}"

    def near(found: Column) -> Column:
        gaps = F.slice(F.split(text, date, -1), F.lit(1), F.size(found))
        return F.array_join(F.zip_with(gaps, found, lambda g, d: F.concat(F.right(g, F.lit(reach)), d)), " ")

    return let(F.regexp_extract_all(text, F.lit(date), 0), lambda found: F.when(F.size(found) > 0, near(found)).otherwise(""))


def extract_deadline(text: Column) -> Column:
    """Date after the first phrase list that is followed by one; an impossible date gives NULL."""
    def after_phrase(near: Column) -> Column:
        found = None
        for phrases in DEADLINE_PHRASES:
            raw = F.regexp_extract(near, rf"(?iu)(?:{phrases})[^\d]{{0,20}}(\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}})", 1)
            found = F.when(raw != "", raw) if found is None else found.when(raw != "", raw)
        return F.when(near != "", found)

    return let(let(arabic_digits_to_ascii(before_dates(text)), after_phrase), parse_date)


def is_tender_text(text: Column) -> Column:
    return contains_any(text, rules.TENDER_WORDS)


def candidates(feed: DataFrame, tenders: DataFrame, source: str | None = None, limit: int | None = None, judged: DataFrame | None = None) -> DataFrame:
    """Notices without a tender; of these the newest ``limit`` where one is given. ``judged``: ids that an earlier run has judged, so
    that notices which failed the gate do not come back and hold up older ones."""
    rows = feed if source is None else feed.where(F.col("source_key") == source)
    done = tenders.where("raw_article_id IS NOT NULL").select(F.col("raw_article_id").alias("id"))
    if judged is not None:
        done = done.unionByName(judged.select("id"))
    rows = rows.join(done, "id", "left_anti")
    return rows if limit is None else rows.orderBy(F.desc("ingested_at"), F.desc("id")).limit(limit)


def gate(notices: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``gate``: html, attachment, fail or open. Only sources with ``needs_words`` are tested for tender words,
    first in the page text, then in the text of the attachments; all others pass with any text."""
    rules_of = sources.select("source_key", F.coalesce("needs_words", F.lit(False)).alias("needs_words"), "buyer", F.col("sector").alias("config_sector"))
    rows = notices.join(rules_of, "source_key", "left")
    tested = F.coalesce("needs_words", F.lit(False))
    result = (
        F.when(~tested & (blank(F.col("body")) == ""), "empty").when(~tested, "open")
        .when(F.coalesce(is_tender_text(F.col("body")), F.lit(False)), "html")
        .when(F.coalesce(is_tender_text(F.col("attachment_text")), F.lit(False)), "attachment").otherwise("fail")
    )
    return rows.withColumn("gate", result)


def confidence(deadline: Column, sector: Column) -> Column:
    score = F.lit(0.2) + F.when(deadline.isNotNull(), 0.4).otherwise(0.0) + F.when((blank(sector) != "") & (sector != "unknown"), 0.2).otherwise(0.0)
    return F.round(score, 6)


def tender_fields(passed: DataFrame) -> DataFrame:
    """Title, dates, buyer, sector, summary and confidence of accepted notices."""
    text = F.when(F.col("gate") == "attachment", F.col("attachment_text")).otherwise(F.col("body"))
    rows = fence(passed, text=text)
    rows = fence(rows, deadline_date=extract_deadline(F.col("text")),
                 sector=F.coalesce(F.nullif("config_sector", F.lit("")), rules.sector(F.col("text"))))
    page_date = F.to_date("published_at")
    url_date = parse_date(F.regexp_extract("url", r"/(\d{4}-\d{2}-\d{2})", 1))
    given = F.nullif(F.col("title"), F.lit("")) if "title" in passed.columns else F.lit(None).cast("string")
    return rows.select(
        F.coalesce("source_key", F.lit("unknown")).alias("source"), F.coalesce("buyer", F.nullif("source_key", F.lit("")), F.lit("unknown")).alias("buyer"),
        F.coalesce(given, F.left(F.substring_index("text", "\n", 1), F.lit(200))).alias("title"), lead_words(F.col("text"), 40).alias("summary"),
        F.coalesce(page_date, url_date).alias("publish_date"), "deadline_date", "sector", "url", F.col("id").alias("raw_article_id"), "language",
        confidence(F.col("deadline_date"), F.col("sector")).alias("confidence_score"),
        # Fixed value: stored text length of the tenders table.
        F.left("text", F.lit(200000)).alias("pdf_text"), F.coalesce("attachments_count", F.lit(0)).alias("attachments_count"), F.col("id").alias("seq"),
    )


def extract_tenders(feed: DataFrame, tenders: DataFrame, sources: DataFrame, source: str | None = None, limit: int | None = None,
                    judged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows inserted, judged candidates). Keep the ids of the second and give them as ``judged`` to the next run."""
    judged = gate(candidates(feed, tenders, source, limit, judged), sources)
    made = tender_fields(judged.where(~F.col("gate").isin("fail", "empty")))
    # Newest candidates come first, so of equal URLs the newest is inserted.
    firsts = first_per_key(made, ["url"], [-F.col("seq")])
    return firsts.join(tenders.select("url"), "url", "left_anti").drop("seq"), judged


def gate_stats(judged: DataFrame, inserted: DataFrame) -> DataFrame:
    counts = judged.agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("gate") == g).alias(f"gate_{g}") for g in ("html", "attachment", "fail")])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in counts.columns],
                                           F.struct(F.lit("gate_fail_rate").alias("metric"), F.try_divide("gate_fail", "candidates").alias("value")))).alias("m")).select("m.*")
    return rows.unionByName(inserted.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("inserted").alias("metric"), "value"))


def detail_page(pages: DataFrame) -> DataFrame:
    """Detail page of a gated source: item block text, heading and printed date."""
    block = h.item_block(F.col("html"))
    rows = fence(pages, item=F.coalesce(F.nullif(block, F.lit("")), F.col("html")))
    head = F.regexp_extract("html", r"(?is)<h2 class=\"contentheading\">\s*<a[^>]*>(.*?)</a>", 1)
    date = F.regexp_extract("html", r"(?is)<div class=\"article-date\">\s*([0-9]{1,2}/[0-9]{1,2}\s+[0-9]{4})", 1)
    return rows.withColumns({
        "body": h.simple_text(F.col("item")), "title": F.nullif(F.left(h.simple_text(head), F.lit(200)), F.lit("")), "printed_date": parse_date(date)})


# ---- digest ----------------------------------------------------------------------------------

def window(tenders: DataFrame, as_of, days: int = 7) -> DataFrame:
    rows = tenders.where(F.col("created_at") >= before(as_of, days=days))
    return rows.withColumn("who", F.coalesce(F.nullif("buyer", F.lit("")), "source"))


def by_buyer(tenders: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Count per buyer with the sector of the newest tender."""
    return window(tenders, as_of, days).groupBy("who").agg(
        F.max_by(F.coalesce("sector", F.lit("unknown")), F.struct("created_at", "raw_article_id")).alias("sector"), F.count(F.lit(1)).alias("n"))


def one_line(col: Column) -> Column:
    return strip(F.replace(blank(col), F.lit("\n"), F.lit(" ")))


def digest_lines(tenders: DataFrame, as_of, days: int = 7, per_buyer: int = 200) -> DataFrame:
    """Digest rows (part, buyer, line_no, line) in order: header, summary by buyer, table per buyer."""
    from pressmill.sources.config import rule_table

    rows = window(tenders, as_of, days)
    buyers = by_buyer(tenders, as_of, days)
    total = buyers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    start, end = F.date_format(before(as_of, days=days), "yyyy-MM-dd"), F.date_format(before(as_of), "yyyy-MM-dd")
    def numbered(first: int, *texts: Column | str) -> Column:
        return F.explode(F.array(*[
            F.struct(F.lit(first + i).alias("line_no"), F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit("")).alias("line"))
            for i, x in enumerate(texts)])).alias("h")

    head = total.select(numbered(
        1, "# Procurement Digest", "", F.concat(F.lit("**Window:** "), start, F.lit(" -> "), end),
        F.concat(F.lit("**Total new items:** "), F.col("n").cast("string")), "",
        F.when(F.col("n") > 0, "## Summary by buyer").otherwise("_No new tenders in this window._"),
    )).select(F.lit(0).alias("part"), F.lit("").alias("buyer"), "h.line_no", "h.line")
    summary = buyers.select(F.lit(1).alias("part"), F.col("who").alias("buyer"), F.lit(0).alias("line_no"), F.concat(
        F.lit("- **"), one_line(F.col("who")), F.lit("** ("), one_line(F.col("sector")), F.lit("): "), F.col("n").cast("string")).alias("line"))
    gap = rule_table(tenders.sparkSession, [(2, "", 0, "")], "part int, buyer string, line_no int, line string")
    heads = buyers.select(F.lit(3).alias("part"), F.col("who").alias("buyer"), numbered(
        -5, F.concat(F.lit("## "), one_line(F.col("who"))),
        F.concat(F.lit("**Sector:** "), one_line(F.col("sector")), F.lit("  |  **Count:** "), F.col("n").cast("string")),
        "", "| Title | Published | Deadline | Attachments | Link |", "|---|---:|---:|---:|---|")).select("part", "buyer", "h.line_no", "h.line")
    tails = buyers.select(F.lit(3).alias("part"), F.col("who").alias("buyer"), F.lit(1_000_000).alias("line_no"), F.lit("").alias("line"))
    shown = top_k(rows, ["who"], [F.desc("created_at"), F.desc("raw_article_id")], per_buyer, F.col("raw_article_id"), "line_no")
    title = F.coalesce(F.nullif(F.left(one_line(F.col("title")), F.lit(160)), F.lit("")), F.lit("(no title)"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    body = shown.select(F.lit(3).alias("part"), F.col("who").alias("buyer"), F.col("line_no").cast("int").alias("line_no"), F.concat(
        F.lit("| "), title, F.lit(" | "), day("publish_date"), F.lit(" | "), day("deadline_date"), F.lit(" | "),
        F.coalesce("attachments_count", F.lit(0)).cast("string"), F.lit(" | "), blank(F.col("url")), F.lit(" |")).alias("line"))
    out = head
    for part in (summary, gap, heads, body, tails):
        out = out.unionByName(part)
    return out.orderBy("part", "buyer", "line_no")


def write_digest(lines: DataFrame, path: str) -> None:
    """One text file per range of lines, in order."""
    lines.orderBy("part", "buyer", "line_no").select("line").write.text(path)
