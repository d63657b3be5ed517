"""Chains of events that keep a distance, by jump functions of time slices.

Which event follows depends on the one before, so a plain pass walks a key in one task. Here every event first gets the event that would
follow if it were in the chain. Slices of one wait are then combined, ``FAN`` at a time, into the jump of a longer slice: for each event by
which a chain can enter it, the event by which the chain leaves it. Slices shrink in number by ``FAN`` at each level and only their entries
go on, so all levels together are a small part of the first. The way back down enters the one slice at the top by a key's first event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressmill.operators.ordered import running
from pressmill.session import settle

FAN = 8


def followers(times: DataFrame, wait: int) -> DataFrame:
    """Adds ``exit``: a key's first time that is at least ``wait`` later (NULL: none). ``times``: distinct ``key``, ``t``."""
    events = times.select("key", "t", (-2 * F.col("t") - 1).alias("pos"), (-F.col("t")).alias("at"))
    asked = times.select("key", "t", (-2 * (F.col("t") + wait)).alias("pos"), F.lit(None).cast("long").alias("at"))
    # From the newest to the oldest; an event comes before a question for its own time.
    swept = running(events.unionByName(asked), ["key"], "pos", maxes={"nearest": F.col("at")}, chunk=max(2, wait // 4))
    return swept.where("at IS NULL").select("key", "t", (-F.col("nearest")).alias("exit"))


def longer(level: DataFrame, start: int, wait: int, length: int) -> DataFrame:
    """Jumps of slices of ``length`` from those of their ``FAN`` parts, with ``path``: the entries into the parts on the way.

    A chain enters a slice by a time of its first wait, or else by the first time after that: where it comes from is before the slice.
    """
    offset = F.pmod(F.col("t") - start, F.lit(length))
    early = level.where(offset < wait).select("key", "t", "exit")
    late = level.where(offset >= wait).groupBy("key", F.floor((F.col("t") - start) / F.lit(length)).alias("slice")).agg(F.min_by(F.struct("t", "exit"), "t").alias("e"))
    chains = early.unionByName(late.select("key", "e.*")).withColumns({
        "end": F.col("t") - F.pmod(F.col("t") - start, F.lit(length)) + length, "path": F.array("t")})
    steps = level.select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.col("exit").alias("_exit"))
    for _ in range(FAN - 1):
        within = F.when(F.col("exit") < F.col("end"), F.col("exit"))
        chains = chains.join(steps, F.col("key").eqNullSafe(F.col("_key")) & (within == F.col("_t")), "left").select(
            "key", "t", "end", F.when(F.col("_t").isNull(), F.col("exit")).otherwise(F.col("_exit")).alias("exit"),
            F.when(F.col("_t").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_t"))).alias("path"))
    return chains.select("key", "t", "exit", "path")


def spaced(times: DataFrame, wait: int) -> DataFrame:
    """The distinct ``key``, ``t`` (whole number) of each key's chain: its first time, then always the first that is at least ``wait`` later.

    A NULL key is a key; NULL times are left out. Equal times are one. With ``wait`` of 0 or less all times stay. No Python, and a key's
    times are spread over tasks: only sums of quarter waits are in order of the key. Jobs run while this is called: one for the range of
    the times and one write for each level (the number of waits in that range, to the base of ``FAN``).
    """
    distinct = times.where("t IS NOT NULL").select("key", "t").distinct()
    if wait <= 0:
        return distinct
    distinct = settle(distinct)
    start, end = distinct.agg(F.min("t"), F.max("t")).first()
    firsts = distinct.groupBy("key").agg(F.min("t").alias("t"))
    if start is None or end - start < wait:
        return firsts
    levels, length = [settle(followers(distinct, wait))], wait
    while length <= end - start:
        length *= FAN
        levels.append(settle(longer(levels[-1], start, wait, length)))
    chain = firsts
    for level in reversed(levels[1:]):
        down = level.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "path")
        chain = chain.join(down, F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t"))).select("key", F.explode("path").alias("t"))
    return chain
