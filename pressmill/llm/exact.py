"""Exact deduplication with a split of the heavy digests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import unused
from pressmill.session import settle

#: A digest that holds more than this share of the rows is counted as frequent; at most 1/SHARE such digests exist.
SHARE = 1 / 256


def text_digest(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest`` of every row; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """Row that stays and size of each group, from partial sums in the map tasks."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``id, digest, keep_id, group_size, kept``: one row for every row of ``docs``, dropped ones too.

    Texts are equal when their bytes are; the row with the largest id stays. One Misra-Gries pass over the digests names
    at most 1/share candidates. Their exact counts and winners (1/share rows at most, whatever the input) are broadcast, so
    frequent digests are settled in the map tasks without a shuffle. Of the other digests none holds more than ``share`` of
    the rows; they meet their winners through an ordinary shuffled join.

    Cases: null text = empty text. A null id never wins against another id; if all ids of a group are null, all its rows stay.
    Rows repeated with the same id and text count in ``group_size`` and share the decision. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    rows = settle(digests(docs, id_col, text_col))
    frequent = rows.stat.freqItems(["digest"], share).select(F.explode("digest_freqItems").alias("digest"))
    heavy = winners(rows.join(F.broadcast(frequent), "digest", "left_semi"))
    heavy = settle(heavy)
    light = rows.join(F.broadcast(heavy), "digest", "left_anti")
    told = rows.join(F.broadcast(heavy), "digest").unionByName(light.join(winners(light), "digest"))
    return told.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Cases as in ``exact_groups``; rows meet their verdict by id and digest."""
    name, digest = unused(docs, "gone_id"), unused(docs, "gone_digest")
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("id").alias(name), F.col("digest").alias(digest)).distinct()
    return docs.join(gone, (text_digest(text_col) == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
