"""Compute an expensive expression once per row.

Filters on a computed column are pushed below the projection and carry the whole expression with them,
once per use, and an expression inside an array lambda is evaluated per element. A one-element explode
is a plan node the expression cannot move through, so what comes after reads a plain column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fence(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add (or replace) the columns; all of them are computed in one step."""
    kept = [c for c in df.columns if c not in exprs]
    row = F.struct(*[e.alias(n) for n, e in exprs.items()])
    held = df.select("*", F.explode(F.array(row)).alias("_held"))
    return held.select(*kept, *[F.col(f"_held.{n}").alias(n) for n in exprs])
