"""Concatenated alignments over markers: ids of every marker, or of any with gaps filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widths(msa: DataFrame) -> DataFrame:
    return msa.groupBy("marker").agg(F.max(F.length("aln")).alias("width"))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("marker", "aln"))), lambda x: x["aln"]), "").alias("aln"))


def intersection(msa: DataFrame) -> DataFrame:
    """(id, aln) of ids that stand in every marker, alignments in marker order."""
    k = msa.select("marker").distinct().count()
    full = msa.groupBy("id").agg(F.count_distinct("marker").alias("k")).where(F.col("k") == k).select("id")
    return _joined(msa.join(full, "id", "left_semi"))


def union(msa: DataFrame) -> DataFrame:
    """(id, aln) of all ids; a missing marker is as many gaps as the marker is wide.

    The list of markers, one row, is broadcast: every row of the result has a part for each of them anyway.
    """
    every = widths(msa).agg(F.sort_array(F.collect_list(F.struct("marker", "width"))).alias("w"))
    own = msa.groupBy("id").agg(F.collect_list(F.struct("marker", "aln")).alias("have"))
    part = lambda x: F.coalesce(F.get(F.filter("have", lambda h: h["marker"] == x["marker"]), F.lit(0))["aln"], F.repeat(F.lit("-"), x["width"]))
    return own.join(F.broadcast(every), F.lit(True)).select("id", F.array_join(F.transform("w", part), "").alias("aln"))


def only_references(msa: DataFrame, is_ref: str = "is_ref") -> bool:
    """Whether no id is a query: true for an empty alignment too."""
    return msa.where(~F.col(is_ref)).isEmpty()
