"""Stored tables bound onto the test tables.

A deployment would return its own tables from the same methods; the operators only see columns.
Times are timestamps without zone and mean UTC.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressmill.sources.config import rule_table

AS_OF = "2024-01-31 00:00:00"

_HEADLINES = (
    "array('oil pipeline restart','central bank loan','militia attack reported','cabinet and minister vote',"
    "'customs tariff import','migrant detention','tender and procurement notice','weather and culture')"
)
_BASE = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
_LATE = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
_SHIFT = "(TIMESTAMP_NTZ '2024-01-31 00:00:00' - TIMESTAMP_NTZ '2001-08-01 00:00:00')"


def _hours(start: str, hours: str) -> str:
    return f"({start} + make_dt_interval(0, CAST({hours} AS INT)))"


_COUNTERS = [
    "total", "attempted", "saved", "failed", "blocked", "discovered_total", "new_candidates",
    "deduped_existing", "dedup_existing", "dedup_new", "updated_existing", "junk_saved",
    "err_dns", "err_timeout", "err_connect", "err_tls", "err_http_403", "err_http_429", "err_http", "err_other",
]


#: Tables of whole texts, and the session setting that deals them out.
TEXTS, SPLITS = ("documents", "pages"), "spark.pressmill.splits"


class Tables:
    """``splits``: number of parts into which the tables of texts are dealt after the scan; by default the session's SPLITS, else as they are read.
    A file of one row group is otherwise one task, however costly its texts. The rows are the same either way."""

    def __init__(self, spark: SparkSession, sf_dir: str, splits: int | None = None):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        asked = spark.conf.get(SPLITS, None)
        self.splits = splits if splits is not None else asked and int(asked)

    def raw(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return rows.repartition(self.splits) if self.splits and name in TEXTS else rows

    @cached_property
    def articles(self) -> DataFrame:
        when = _hours(_BASE, "(doc_id * 7) % 720")
        return self.raw("documents").selectExpr(
            "doc_id AS id", "source", "source AS source_id", "concat('Desk ', source) AS source_name",
            f"concat(substr(text,1,60), ' ', element_at({_HEADLINES}, CAST(doc_id % 8 + 1 AS INT))) AS title",
            "substr(text,61,200) AS summary", "text AS content", "lang AS language",
            "CAST(NULL AS STRING) AS translated_content",
            "CASE WHEN doc_id % 9 = 0 THEN 'Energy' END AS category",
            "concat('https://', CASE WHEN doc_id % 4 = 0 THEN 'www.' ELSE '' END, source, '.example.org/', lang, '/news/',"
            " doc_id % 700, CASE WHEN doc_id % 3 = 0 THEN '/?utm_source=feed&b=2&a=1' ELSE '' END) AS url",
            f"CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {when} END AS published_at",
            f"{_hours(_BASE, '(doc_id * 7) % 720 + 1')} AS created_at",
            "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars < 300 THEN 'title_only' WHEN n_chars < 800 THEN 'teaser' ELSE 'full' END AS content_kind",
            "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars < 300 THEN 'blocked' WHEN n_chars < 800 THEN 'partial' ELSE 'full' END AS verification_status",
            "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars < 300 THEN 0 WHEN n_chars < 800 THEN 30 ELSE 80 END AS fetch_quality",
            "CASE WHEN doc_id % 5 = 0 THEN 'social' ELSE 'article' END AS source_type",
            "doc_id % 17 = 0 AS is_deleted",
            "element_at(array('DONE','DONE_FASTPATH','PENDING','TIMEOUT','ERROR'), CAST(doc_id % 5 + 1 AS INT)) AS summary_status",
            f"{_hours(_BASE, '(doc_id * 7) % 720 + 2')} AS summary_updated_at",
            "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE "
            f"{_hours(_LATE, '(doc_id * 11) % 360')} END AS summary_next_attempt_at",
            f"{_hours(_LATE, '(doc_id * 13) % 264')} AS last_seen_at",
            "CASE WHEN doc_id % 4 = 1 THEN sha2(text, 256) WHEN doc_id % 4 = 2 THEN sha2('old', 256) END AS content_hash",
        )

    @property
    def feed(self) -> DataFrame:
        """Feed items share their rows with the articles."""
        return self.articles

    @cached_property
    def sources(self) -> DataFrame:
        return self.spark.range(22).where("id NOT IN (18, 19)").selectExpr(
            "concat('src', id) AS id", "concat('src', id) AS key", "concat('Source ', id, ' (Daily)') AS name",
            "id % 6 <> 0 AS is_active",
            "CASE WHEN id % 3 = 0 THEN 'social' WHEN id % 3 = 1 THEN 'rss' ELSE 'page' END AS source_type",
            "concat('https://src', id, '.example.org') AS url",
            "concat('{\"priority\": ', id % 4, '}') AS meta",
        )

    @cached_property
    def config(self) -> DataFrame:
        return self.spark.range(22).where("id <> 20").selectExpr(
            "concat('src', id) AS source_key", "id % 5 <> 0 AS enabled",
            "CASE WHEN id % 3 = 0 THEN 'social' WHEN id % 3 = 1 THEN 'rss' ELSE 'page' END AS type",
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Job log with the nested per-source counters."""
        k = "CAST(get_json_object(props, '$.k') AS INT)"
        values = {
            "saved": f"{k} % 7",
            "attempted": f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE {k} % 12 END",
            "total": f"CASE WHEN event_id % 8 = 0 THEN NULL ELSE {k} % 15 END",
            "failed": "CASE WHEN event_type = 'error' THEN 2 ELSE 0 END",
            "blocked": "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END",
            "discovered_total": f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {k} % 20 END",
            "new_candidates": f"CASE WHEN event_id % 6 = 0 THEN NULL ELSE {k} % 10 END",
            "deduped_existing": f"CASE WHEN event_id % 4 = 1 THEN NULL ELSE {k} % 5 END",
            "dedup_existing": f"{k} % 3", "dedup_new": f"{k} % 4", "updated_existing": f"{k} % 2",
            "junk_saved": f"CAST({k} % 9 = 0 AS INT)",
            "err_dns": f"CAST({k} % 11 = 0 AS INT)", "err_timeout": f"CAST({k} % 13 = 0 AS INT)",
            "err_connect": f"CAST({k} % 17 = 0 AS INT)", "err_tls": f"CAST({k} % 19 = 0 AS INT)",
            "err_http_403": f"CAST({k} % 23 = 0 AS INT)", "err_http_429": f"CAST({k} % 29 = 0 AS INT)",
            "err_http": f"CAST({k} % 31 = 0 AS INT)", "err_other": f"CAST({k} % 37 = 0 AS INT)",
        }
        fields = ", ".join(f"'{name}', {values[name]}" for name in _COUNTERS)
        error = (
            "CASE WHEN event_type = 'error' THEN element_at(array('blocked:403','request_error:dns',"
            "'request_error:ReadTimeout','parse_error:ValueError'), CAST(event_id % 4 + 1 AS INT)) END"
        )
        meta = (
            f"named_struct({fields}, 'fetch_degraded', event_id % 50 = 0,"
            f" 'discovery_degraded', event_id % 60 = 0, 'last_error', {error})"
        )
        return self.raw("events").selectExpr(
            "event_id AS id",
            "CASE WHEN event_id % 2 = 0 THEN 'page_ingest' ELSE 'rss_ingest' END AS job_name",
            "ts AS started_at",
            "CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + INTERVAL '5' MINUTE END AS finished_at",
            "CASE WHEN event_type = 'error' THEN FALSE WHEN event_id % 19 = 0 THEN NULL ELSE TRUE END AS ok",
            f"named_struct('by_source', map(concat('src', user_id % 21), {meta})) AS stats",
        )

    @cached_property
    def searches(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id", "c_custkey % 300 AS user_id", "concat('Search ', c_custkey) AS name",
            "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE element_at(array('pipeline','central bank','attack -vote','minister',"
            "'customs tariff','\"tender and procurement\"'), CAST(c_custkey % 6 + 1 AS INT)) END AS query",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 + c_custkey % 30 END AS days",
            "CASE WHEN c_custkey % 5 = 0 THEN 'Energy' WHEN c_custkey % 5 = 1 THEN '' END AS category",
            "CASE WHEN c_custkey % 6 = 0 THEN concat('src', c_custkey % 20) END AS source",
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id", "c_custkey % 300 AS user_id", "c_custkey AS saved_search_id",
            "CASE WHEN c_custkey % 8 = 0 THEN 'telegram' ELSE 'email' END AS channel",
            "concat('target', c_custkey) AS target", "c_custkey % 10 <> 0 AS active",
        )

    @cached_property
    def prefs(self) -> DataFrame:
        users = self.raw("customer").selectExpr("c_custkey % 300 AS u").distinct().where("u % 3 <> 0")
        return users.selectExpr(
            "u AS user_id", "CAST(3600 * (1 + u % 12) AS INT) AS dedupe_window_sec",
            "CASE WHEN u % 4 = 0 THEN NULL WHEN u % 4 = 1 THEN CAST(array() AS ARRAY<STRING>) ELSE array('energy') END AS priority_categories",
            "CASE WHEN u % 5 = 0 THEN array('email','telegram') ELSE array('email') END AS channels_enabled",
            "CASE WHEN u % 7 = 0 THEN array('P0','P1') END AS immediate_priorities",
            "CASE WHEN u % 9 = 0 THEN array('P1') END AS digest_priorities",
            "CASE WHEN u % 2 = 0 THEN 'weekly' END AS digest_schedule",
        )

    @cached_property
    def cursors(self) -> DataFrame:
        return self.raw("customer").where("c_custkey % 3 = 0").selectExpr(
            "c_custkey AS alert_id",
            f"{_hours(_BASE + ' + INTERVAL 19 DAY', 'c_custkey % 240')} AS last_ts",
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_orderkey % 1500 AS alert_id", "(o_orderkey % 1500) % 300 AS user_id",
            "o_orderkey % 1000 AS article_id",
            "CASE WHEN o_orderkey % 8 = 0 THEN 'telegram' ELSE 'email' END AS channel",
            "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PENDING' ELSE 'SENT' END AS status",
            "CAST(o_orderkey % 7 AS INT) AS attempt_count",
            f"o_orderdate + {_SHIFT} AS created_at", f"o_orderdate + {_SHIFT} AS queued_at",
            "o_orderkey % 20 = 0 AS queued_at_is_estimated",
            f"CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {_hours('o_orderdate + ' + _SHIFT, 'o_orderkey % 200')} END AS next_attempt_at",
            f"CASE WHEN o_orderkey % 5 = 0 THEN {_hours('o_orderdate + ' + _SHIFT, '3')} END AS last_attempt_at",
            "concat('k', o_orderkey % 400) AS dedupe_key",
            "concat('P', least(CAST(substr(o_orderpriority,1,1) AS INT) - 1, 2)) AS priority",
        )

    @cached_property
    def quotes(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "concat('S', l_suppkey) AS instrument",
            "CASE l_returnflag WHEN 'A' THEN 'official' WHEN 'N' THEN 'parallel' ELSE 'spot' END AS rate_type",
            "CASE WHEN l_linestatus = 'O' THEN 'LYD' ELSE 'USD' END AS quote_currency",
            "l_extendedprice AS value", "l_shipdate AS as_of", "l_shipdate + INTERVAL '1' HOUR AS fetched_at",
        )

    @cached_property
    def notices(self) -> DataFrame:
        day = "concat(doc_id % 28 + 1, '{0}', doc_id % 12 + 1, '{0}', '{1}')"
        return self.raw("documents").selectExpr(
            "doc_id AS id", "source AS source_key", "lang AS language",
            "concat('https://', source, '.example.org/n/', doc_id) AS url",
            "concat(text, CASE"
            f" WHEN doc_id % 5 = 0 THEN concat(' Closing date: ', {day.format('/', '2024')})"
            f" WHEN doc_id % 5 = 1 THEN concat(' Submission deadline - ', {day.format('-', '24')})"
            f" WHEN doc_id % 5 = 2 THEN concat(' آخر موعد ', translate({day.format('/', '2024')}, '0123456789', '٠١٢٣٤٥٦٧٨٩'), ' مناقصة')"
            " WHEN doc_id % 5 = 3 THEN ' Closing date: 31/02/2024 drilling rig' ELSE ' generator and transformer' END) AS body",
            f"{_hours(_BASE, '(doc_id * 7) % 720')} AS created_at",
        )

    @cached_property
    def inbox(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "concat('fb_', conv_id % 14) AS source_id",
            "concat('https://social.example.org/', conv_id, '/', turn) AS post_url",
            "CASE WHEN role = 'system' THEN '' WHEN conv_id % 6 = 0 THEN concat('خبر عاجل ', text) ELSE text END AS captured_text",
            f"{_hours(_BASE, '(conv_id * 3 + turn) % 720')} AS captured_at",
        )

    @cached_property
    def social_sources(self) -> DataFrame:
        """Every third account is disabled, one is unknown."""
        return self.spark.range(13).selectExpr(
            "concat('fb_', id) AS id", "id % 3 <> 0 AS enabled",
            "concat('https://social.example.org/p/', id) AS page_url", "concat('page', id) AS page_handle",
            "CASE WHEN id % 2 = 0 THEN array('west', 'national') ELSE CAST(array() AS ARRAY<STRING>) END AS region_coverage",
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.raw("pages").selectExpr(
            "page_id AS pos", "url", "html",
            "CASE WHEN page_id % 3 = 0 THEN 'news' WHEN page_id % 3 = 1 THEN 'inbrief' ELSE 'other' END AS bucket",
            "concat('site', page_id % 4) AS source_key", "page_id % 7 < 3 AS stored",
        )

    @cached_property
    def pages(self) -> DataFrame:
        """Landed pages with some head markup and links of known shape added."""
        head = (
            "CASE page_id % 5"
            " WHEN 0 THEN '<meta property=\"og:type\" content=\"article\"><meta content=\"2024-01-05T08:00:00Z\" property=\"article:published_time\">'"
            " WHEN 1 THEN '<meta name=\"pubdate\" content=\" 2024-01-06 \">'"
            " WHEN 2 THEN '<script type=\"application/ld+json\">[{\"@type\":[\"Thing\",\"NewsArticle\"]}]</script>'"
            " WHEN 3 THEN '<!-- <meta property=\"og:type\" content=\"article\"> -->'"
            " ELSE '<meta name=\"dc.date\" content=\"2024-01-08\">' END"
        )
        story = "'<a href=\"/news/2024/1/', page_id % 9 + 1, '/story-', page_id"
        file = "/docs/2024/tender/file', page_id % 3, '.pdf\">"
        links = (
            f"concat({story}, '?utm_source=x&amp;p=1#c\">Story</a>', {story}, '/?p=1\">Again</a>',"
            f"'<a class=\"d\" href=\"{file}Tender file</a>', '<a href=\"{file}Copy</a>',"
            "'<a href=\"mailto:a@b.c\">m</a><a href=\"/category/x/\">c</a>"
            "<a href=\"https://other.example.org/press/9\">o</a><time datetime=\"2024-01-09\">t</time></nav>')"
        )
        return self.raw("pages").selectExpr(
            "page_id", "url", "concat('site', page_id % 4) AS source_key",
            f"replace(replace(html, '<head>', concat('<head>', {head})), '</nav>', {links}) AS html",
        )

    @cached_property
    def topics(self) -> DataFrame:
        none: list[str] = []
        rows = [
            ("energy_en", 1, "en", ["oil_gas"], ["is", "the"], none, none, none, none, 0),
            ("banking_en", 2, "en", ["banking"], ["er", "re"], ["bank", "loan"], none, none, ["src3.example.org"], 40),
            ("security_any", 3, None, ["security", "governance"], ["e"], none, ["attack", "vote"], ["militia", "minister"], ["src1.example.org"], 0),
            ("trade_de", 4, "de", ["regulation"], ["en"], none, none, none, none, 25),
        ]
        return rule_table(
            self.spark, rows,
            "topic_key string, priority int, topic_lang string, tags array<string>, location_terms array<string>,"
            "require_terms array<string>, require_terms_any array<string>, require_terms_any2 array<string>,"
            "preferred_domains array<string>, max_processed int",
        )

    @cached_property
    def topic_items(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "element_at(array('energy_en','banking_en','security_any','trade_de'), CAST(doc_id % 4 + 1 AS INT)) AS topic_key",
            "doc_id AS pos",
            "CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN concat('https://www.facebook.com/p/', doc_id)"
            " ELSE concat('https://', source, '.example.org/', lang, '/', doc_id % 160,"
            " CASE WHEN doc_id % 3 = 0 THEN '/?utm_source=x&b=2' ELSE '' END) END AS url",
            f"concat(substr(text,1,60), ' ', element_at({_HEADLINES}, CAST(doc_id % 8 + 1 AS INT))) AS title",
            "text AS snippet",
            f"CASE WHEN doc_id % 6 = 0 THEN 'bad' ELSE date_format({_hours(_BASE, '(doc_id * 7) % 720')}, 'yyyyMMddHHmmss') END AS seendate",
            "lang AS language",
        )
