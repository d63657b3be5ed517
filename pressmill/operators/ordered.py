"""Order-dependent operators that never need a whole group in one task.

Groups may be very large (one source can hold a third of a table), so
* picking one row per key is an aggregate with map-side combine,
* top-k is ranked per salted slice of the group first, and
* running totals carry per-chunk summaries instead of scanning the group in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 65_536
SALTS = 64


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row per key: smallest (or largest) by ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    spread: Column,
    rank: str = "rn",
    salts: int = SALTS,
) -> DataFrame:
    """First ``k`` rows per key by a total ``order``. ``spread`` is a column that tells rows apart;
    each salted slice keeps its own first k, so the last window sees at most ``k * salts`` rows a key.
    ``salts=1`` is for groups that are bounded already."""
    sliced = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    limited = df if salts == 1 else (
        df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        .withColumn("_part", F.row_number().over(sliced))
        .where(F.col("_part") <= k)
        .drop("_part", "_salt")
    )
    return limited.withColumn(rank, F.row_number().over(whole).cast("long")).where(F.col(rank) <= k)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Inclusive running sums and maxima over ``keys`` in the order of the unique integer ``pos``.

    The group is cut into ranges of ``chunk`` positions. A small table of one row per range carries
    what came before; the wide rows are only windowed inside their own range.
    """
    sums, maxes = sums or {}, maxes or {}
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk)))
    for name, value in {**sums, **maxes}.items():
        cut = cut.withColumn(f"_v_{name}", value)
    totals = cut.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k__chunk"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
    )
    on = F.col("_chunk") == F.col("_k__chunk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carry, on, "left")
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(inside)))
    return out.select(*df.columns, *sums, *maxes)


def with_index(df: DataFrame, keys: Sequence[str], pos: str, out: str = "i", chunk: int = CHUNK) -> DataFrame:
    """1-based index of each row within its key by ``pos``."""
    return running(df, keys, pos, sums={out: F.lit(1).cast("long")}, chunk=chunk)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, pct: float, out: str) -> DataFrame:
    """Value at index round(pct * (n - 1)), half-even, of the sorted integer values per key.

    Works on counts per distinct value, so the group itself is never sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    seen = running(counts, keys, value, sums={"_upto": F.col("_n")})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rank = F.bround(F.lit(pct) * (F.col("_total") - 1), 0)
    return (
        seen.join(total, list(keys))
        .where(F.col("_upto") > rank)
        .groupBy(*keys)
        .agg(F.min(value).alias(out))
    )
