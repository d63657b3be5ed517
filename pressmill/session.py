"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Arrow batches of bounded bytes: a batch of 10000 rows of long texts would be held whole by each Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


def build_session(app: str = "pressmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder of the cluster; ``fallback`` only where none is set."""
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    wanted = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if wanted:
        context.setCheckpointDir(wanted)
    return wanted


def shared_dir(spark: SparkSession) -> str | None:
    """The cluster's shared folder; on a single machine without one, a fresh temporary folder."""
    local = spark.sparkContext.master.startswith("local")
    return checkpoint_dir(spark) or checkpoint_dir(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") if local else None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder."""
    root = shared_dir(spark)
    if root is None:
        raise RuntimeError("spark.checkpoint.dir is not set, and a cluster has no other shared folder")
    return f"{root}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has settled; call it when its results are written."""
    root = shared_dir(spark)
    if root is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Parquet settings for tables whose rows are megabytes long. By default a page or a row group is first measured after 100 rows.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write an expensive intermediate once as a table in the shared folder and go on from there.

    Used where an operator reads its input more than once (prefix sums, several aggregates), so that page parsing
    and text work are not repeated. A lost executor costs nothing: the rows are read back from the folder, with
    only the columns asked for and with real sizes for the optimizer. (A checkpoint would compute the last stage
    twice.) A cluster without a shared folder is an error. ``clear_scratch`` removes the tables. ``options``: of the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
