"""Best, near-top and top-k hits; set and sentinel filters on alignment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def hit_order() -> list[Column]:
    return [F.col("bitscore").desc(), F.col("pident").desc(), F.col("sseqid")]


def best_hit(hits: DataFrame) -> DataFrame:
    return first_per_key(hits, ["qseqid"], hit_order())


def top_k(hits: DataFrame, k: int, keys: tuple[str, ...] = ("qseqid",)) -> DataFrame:
    """Hits ranked within a query; the rank limit prunes rows before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*hit_order())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_top(hits: DataFrame, share: float = 0.9, strict: bool = False) -> DataFrame:
    """Hits within `share` of their query's best bit score: above it (strict) or at least it."""
    top = F.max("bitscore").over(Window.partitionBy("qseqid"))
    cut = F.col("top") * F.lit(share)
    return hits.withColumn("top", top).where(F.col("bitscore") > cut if strict else F.col("bitscore") >= cut).drop("top")


def no_self(hits: DataFrame, q: str = "qseqid", t: str = "sseqid") -> DataFrame:
    return hits.where(F.col(q) != F.col(t))


def spacer_hits(hits: DataFrame, identity: float, cover: float) -> DataFrame:
    """CRISPR spacer hits strictly above both thresholds, with cov."""
    return hits.withColumn("cov", F.try_divide(F.col("length").cast("double"), "slen")).where((F.col("cov") > cover / 100) & (F.col("pident") > identity))


def trna_hits(hits: DataFrame, cover: float) -> DataFrame:
    return hits.withColumn("cov", F.least(F.try_divide(F.col("length").cast("double"), "slen"), F.lit(1.0))).where(F.col("cov") >= cover)


def marker_best(hits: DataFrame, identity: float, cover: float) -> DataFrame:
    """Best marker for each genome by coverage, then identity; the thresholds are applied to the best alone."""
    h = hits.withColumn("cov", 100 * F.greatest(F.try_divide(F.col("length").cast("double"), "qlen"), F.try_divide(F.col("length").cast("double"), "slen")))
    best = first_per_key(h, ["genome"], [F.col("cov").desc(), F.col("pident").desc(), F.col("sseqid"), F.col("qseqid")])
    return best.where((F.col("cov") > cover) & (F.col("pident") > identity))


def first_evalue(hits: DataFrame, order: Column) -> DataFrame:
    """(query, evalue): the first hit's e-value of each query in a given order."""
    return first_per_key(hits, ["query"], [order]).select("query", "evalue")


def span_ratio(hits: DataFrame, order: Column, least: float = 0.7) -> DataFrame:
    """(qseqid, ratio): query span over target span of each query's first hit, in a given order, that reaches `least`."""
    ratio = F.abs(F.try_divide((F.col("qstart") - F.col("qend")).cast("double"), F.col("sstart") - F.col("send")))
    return first_per_key(hits.withColumn("ratio", ratio).where(F.col("ratio") >= least), ["qseqid"], [order]).select("qseqid", "ratio")
