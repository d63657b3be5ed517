"""A keyed table for streaming writes: hash buckets, one small delta for each batch, merged when it is read.

``delta/batch=N/bucket=B``: rows that batch N changed, whole. ``base/v=N/bucket=B``: all rows as of batch N. ``commits/batch=N``: a row that
says which base is whole; it is written after the base. A batch reads and writes only the buckets of its keys. Everything has the batch's
number in its name and a batch never reads what it or a later one has written, so a batch that is repeated writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Store:
    """``schema``: DDL of the rows; ``keys``: columns that name a row. Every ``compact_after`` batches the deltas are merged into a new base."""

    def __init__(self, root: str, schema: str, keys: list[str], buckets: int = 16, compact_after: int = 16):
        self.root, self.schema, self.keys, self.buckets, self.compact_after = root, schema, keys, buckets, compact_after

    def _stored(self, spark: SparkSession, folder: str, schema: str) -> DataFrame:
        """Rows below a folder; none where nothing has been written yet."""
        try:
            return spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def base(self, spark: SparkSession, before: int | None = None) -> int:
        """Number of the newest whole base of an earlier batch; -1: none. There is one row for each compaction."""
        commits = self._stored(spark, "commits", "base long, batch long")
        return (commits if before is None else commits.where(F.col("batch") < before)).agg(F.coalesce(F.max("base"), F.lit(-1)).alias("v")).first().v

    def read(self, spark: SparkSession, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of all batches (or those ``before`` one): of each key the row of its last batch. ``buckets``: only these."""
        v = self.base(spark, before)
        rows = self._stored(spark, "delta", f"{self.schema}, bucket int, batch long").where(F.col("batch") > v)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        if v >= 0:
            rows = rows.unionByName(self._stored(spark, f"base/v={v}", f"{self.schema}, bucket int").withColumn("batch", F.lit(v).cast("long")))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        names = [c for c in rows.columns if c not in ("bucket", "batch")]
        rest = [c for c in names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")) if rest else rows.select(*self.keys).distinct()
        return last.select(*(F.col(c) if c in self.keys else F.col(f"_r.{c}") for c in names))

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Writes the changed rows of a batch, one for each key, and compacts when it is time."""
        names = rows.sparkSession.createDataFrame([], self.schema).columns
        rows.select(*names).withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/delta/batch={batch_id}")
        if batch_id - self.base(rows.sparkSession, batch_id) >= self.compact_after:
            self.compact(rows.sparkSession, batch_id)

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """A new base of all batches up to this one. Deltas and bases before the last base but one are no longer read and may be removed."""
        rows = self.read(spark, batch_id + 1).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/v={batch_id}")
        spark.createDataFrame([(batch_id,)], "base long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch_id}")

    def merge(self, rows: DataFrame, batch_id: int, into: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``into``: the stored rows of the batch's keys and the batch's rows to the new rows. Reads the touched buckets only."""
        touched = [r.bucket for r in rows.select(self.bucket()).distinct().collect()]
        old = self.read(rows.sparkSession, batch_id, touched).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")
        self.put(into(old, rows), batch_id)

    def writer(self, into: Callable[[DataFrame, DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function. ``prepare``: the batch to rows with the store's keys."""

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = prepare(batch).persist()
            try:
                self.merge(rows, batch_id, into)
            finally:
                rows.unpersist()

        return write
