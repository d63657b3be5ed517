"""Latest market quotes, staleness and currency pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressmill.functions.times import before
from pressmill.operators.writes import upsert_quotes

KEY = ["instrument", "rate_type", "quote_currency"]


def latest(quotes: DataFrame, seq: str) -> DataFrame:
    """Newest quote of each key; combines before the shuffle."""
    rest = [c for c in quotes.columns if c not in KEY]
    return quotes.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("as_of", seq)).alias("q")).select(*KEY, "q.*").select(*quotes.columns)


def mark_stale(quotes: DataFrame, as_of, minutes: int = 180) -> DataFrame:
    old = (F.col("fetched_at") < before(as_of, minutes=minutes)) & (F.col("status") == "ok")
    return quotes.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def refresh(existing: DataFrame, incoming: DataFrame, as_of, seq: str, minutes: int = 180) -> DataFrame:
    return mark_stale(upsert_quotes(existing, incoming, as_of, seq), as_of, minutes)


def refresh_counts(refreshed: DataFrame, incoming: DataFrame) -> DataFrame:
    new = incoming.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("updated").alias("metric"), "n")
    return new.unionByName(refreshed.groupBy(F.col("status").alias("metric")).agg(F.count(F.lit(1)).alias("n")))


def pairs(quotes: DataFrame, currency: str = "LYD") -> DataFrame:
    """Official and parallel rate side by side. A row without any of the two is not shown."""
    rows = quotes.where((F.col("quote_currency") == currency) & F.col("rate_type").isin("official", "parallel"))
    side = lambda kind, c: F.max(F.when(F.col("rate_type") == kind, F.col(c)))
    wide = rows.groupBy("instrument").agg(
        side("official", "value").alias("official"), side("parallel", "value").alias("parallel"),
        F.coalesce(side("official", "as_of"), side("parallel", "as_of")).alias("as_of"),
        F.bool_or(F.col("status") != "ok").alias("warn"))
    return wide.orderBy("instrument")


def listing(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0))).orderBy(*KEY)


def latest_as_of(quotes: DataFrame) -> DataFrame:
    return quotes.agg(F.max("as_of").alias("as_of"))
