"""Lineage strings to one column for each rank, and validation against known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_lineage(df: DataFrame, id_col: str, lineage: str, scores: str) -> DataFrame:
    """(id, pos, rank, name, score) of `rank:name;...` and its parallel `;` scores."""
    z = F.arrays_zip(F.split(lineage, ";").alias("l"), F.split(scores, ";").alias("s"))
    x = df.select(id_col, F.posexplode(z).alias("pos", "z"))
    return x.select(id_col, "pos", F.substring_index("z.l", ":", 1).alias("rank"), F.expr("substring(z.l, instr(z.l, ':') + 1)").alias("name"), F.expr("try_cast(z.s as double)").alias("score"))


def to_valid_rank(names: DataFrame, valid: DataFrame) -> DataFrame:
    """The rank under which each name is known: its own if the name is known there, else that of the first known name, by
    ord, that begins with the name's stem.

    names: (…, rank, name); valid: (rank, name, ord). Adds valid_rank and valid_name, null if unknown. A name's stem is
    what stands before the ending of its rank (SUFFIXES). Known names are listed by all their beginnings, so stems are
    found by an equi-join.
    """
    exact = valid.select(F.lower("rank").alias("e_key"), F.col("name").alias("e_name"), F.col("rank").alias("e_rank")).dropDuplicates(["e_key", "e_name"])
    begin = valid.select("rank", "name", "ord", F.explode(F.sequence(F.lit(0), F.length("name"))).alias("len"))
    near = begin.groupBy(F.expr("substring(name, 1, len)").alias("begin")).agg(F.min_by(F.struct("rank", "name"), "ord").alias("n"))
    j = names.join(exact, (F.lower("rank") == F.col("e_key")) & (F.col("name") == F.col("e_name")), "left")
    j = j.join(near, F.when(F.col("e_name").isNull(), _stem("rank", "name")) == F.col("begin"), "left")
    return j.withColumn("valid_rank", F.coalesce("e_rank", "n.rank")).withColumn("valid_name", F.coalesce("e_name", "n.name")).drop("e_key", "e_rank", "e_name", "n", "begin")


#: The endings of virus names by rank.
SUFFIXES = {
    "realm": "viria", "subrealm": "vira", "kingdom": "virae", "subkingdom": "virites", "phylum": "viricota", "subphylum": "viricotina", "class": "viricetes", "subclass": "viricetidae",
    "order": "virales", "suborder": "virineae", "family": "viridae", "subfamily": "virinae", "genus": "virus", "subgenus": "virus",
}


def _stem(rank: str, name: str) -> Column:
    out = F.col(name)
    for r, end in SUFFIXES.items():
        out = F.when(F.lower(rank) == r, F.substring_index(name, end, 1)).otherwise(out)
    return out


def scores_by_rank(long: DataFrame, id_col: str, ranks: list[str]) -> DataFrame:
    """One row for each id: for each rank its name and `<rank>_score`, NA where it lacks them."""
    wide = long.groupBy(id_col).pivot("rank", ranks).agg(F.min("name").alias("name"), F.max("score").alias("score"))
    parts = [c for r in ranks for c in (F.coalesce(f"{r}_name", F.lit("NA")).alias(r), F.coalesce(F.col(f"{r}_score").cast("string"), F.lit("NA")).alias(f"{r}_score"))]
    return wide.select(id_col, *parts)


def pivot_ranks(long: DataFrame, id_col: str, ranks: list[str], rank: str = "rank", value: str = "name") -> DataFrame:
    """One column for each of the given ranks (given, so no extra pass finds them); missing is NA."""
    wide = long.groupBy(id_col).pivot(rank, ranks).agg(F.min(value))
    return wide.select(id_col, *[F.coalesce(r, F.lit("NA")).alias(r) for r in ranks])


def invalid_names(wide: DataFrame, id_col: str, ranks: list[str], valid: DataFrame) -> DataFrame:
    """(id, column, value) of cells that are neither null nor NA nor a valid name of their rank."""
    long = wide.unpivot([id_col], ranks, "column", "value").where("value is not null and value <> 'NA'")
    return long.join(valid.select(F.col("rank").alias("column"), F.col("name").alias("value")).distinct(), ["column", "value"], "left_anti").select(id_col, "column", "value")
