"""Genome pairs: mean amino-acid identity, nucleotide identity, coverage, edge filters, seed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions import genome_of
from seqlake.operators.besthit import first_per_key


def symmetrise(hits: DataFrame) -> DataFrame:
    """Hits and the same hits seen from the target."""
    rest = [c for c in hits.columns if c not in ("qseqid", "sseqid")]
    return hits.unionByName(hits.select(F.col("sseqid").alias("qseqid"), F.col("qseqid").alias("sseqid"), *rest))


def genome_sizes(orfs: DataFrame, orf_col: str = "orf_id") -> DataFrame:
    return orfs.select(orf_col).distinct().groupBy(genome_of(F.col(orf_col)).alias("genome")).agg(F.count("*").alias("genes"))


def amino_acid_identity(hits: DataFrame, q_sizes: DataFrame, t_sizes: DataFrame, both_ways: bool = False) -> DataFrame:
    """(query, target, aai, sgenes, qcov, tcov, qgenes, tgenes): one hit, the best, for each ORF and target genome.

    A genome of unknown size gives null coverage, so no edge. `both_ways` adds the hits seen from the target.
    """
    h = symmetrise(hits) if both_ways else hits
    h = h.select("qseqid", "sseqid", "pident", "bitscore").withColumn("query", genome_of(F.col("qseqid"))).withColumn("target", genome_of(F.col("sseqid")))
    one = first_per_key(h, ["query", "target", "qseqid"], [F.col("bitscore").desc(), F.col("pident").desc(), F.col("sseqid")])
    pairs = one.groupBy("query", "target").agg(F.avg("pident").alias("aai"), F.count("*").alias("sgenes"))
    q = q_sizes.select(F.col("genome").alias("query"), F.col("genes").alias("qgenes"))
    t = t_sizes.select(F.col("genome").alias("target"), F.col("genes").alias("tgenes"))
    pairs = pairs.join(q, "query", "left").join(t, "target", "left")
    pct = lambda n: 100 * F.try_divide(F.col("sgenes").cast("double"), n)
    return pairs.select("query", "target", "aai", "sgenes", pct("qgenes").alias("qcov"), pct("tgenes").alias("tcov"), "qgenes", "tgenes")


def edges(pairs: DataFrame, aai: float = 75, cover: float = 80, share: int = 15) -> DataFrame:
    """Pairs that are similar and well covered on either side or in shared genes, with their score."""
    keep = (F.col("aai") >= aai) & ((F.col("qcov") >= cover) | (F.col("tcov") >= cover) | (F.col("sgenes") >= share))
    return pairs.where(keep).withColumn("score", F.col("aai") / 100 * F.greatest("qcov", "tcov") / 100)


def weighted_identity(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Alignment-length-weighted identity, rounded to two places, halves up.

    Identities are taken as whole millionths and summed and rounded as whole numbers, so neither the order of the rows
    nor binary fractions move a tie.
    """
    mass = F.sum(F.col("length").cast("decimal(12,0)") * F.round(F.col("pident") * 1_000_000).cast("decimal(12,0)"))
    g = hits.groupBy(*keys).agg(F.count("*").alias("num_alns"), mass.cast("decimal(30,0)").alias("_mass"), F.sum("length").cast("decimal(18,0)").alias("_length"))
    return g.select(*keys, "num_alns", F.when(F.col("_length") > 0, F.expr("(2 * _mass + _length * 10000) div (2 * _length * 10000)") / 100).alias("pid"))


def interval_union(iv: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covered): positions in the union of closed intervals (start, stop); touching intervals join.

    A running maximum of stops over starts gives each interval's new part, so no island numbering is needed.
    """
    w = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("stop").over(w)
    new = F.greatest(F.col("stop") - F.greatest(F.col("start") - 1, F.coalesce(seen, F.col("start") - 1)), F.lit(0))
    return iv.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("covered"))


def ani_edges(pairs: DataFrame, ani: float = 95, tcov: float = 85) -> DataFrame:
    return pairs.where((F.col("qname") != F.col("tname")) & (F.col("tcov") >= tcov) & (F.col("pid") >= ani))


def nucleotide_pairs(hits: DataFrame) -> DataFrame:
    """(qname, tname, num_alns, pid, qcov, tcov) from 14-column hits, self hits left out."""
    h = hits.where("qseqid <> sseqid").select(F.col("qseqid").alias("qname"), F.col("sseqid").alias("tname"), "pident", "length", "qlen", "slen", F.least("qstart", "qend").alias("qs"), F.greatest("qstart", "qend").alias("qe"), F.least("sstart", "send").alias("ss"), F.greatest("sstart", "send").alias("se"))
    pid = weighted_identity(h, ["qname", "tname"])
    cov = lambda a, b, n, out: interval_union(h.select("qname", "tname", n, F.col(a).alias("start"), F.col(b).alias("stop")), ["qname", "tname", n]).select("qname", "tname", F.round(100 * F.try_divide(F.col("covered").cast("double"), n), 2).alias(out))
    return pid.join(cov("qs", "qe", "qlen", "qcov"), ["qname", "tname"]).join(cov("ss", "se", "slen", "tcov"), ["qname", "tname"])


def seed_join(a: DataFrame, b: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(a_id, b_id, seeds): pairs of (id, seq) sequences that share at least `least` distinct seeds of k letters.

    Seeds that one side lacks are dropped by the equi-join; each side's seeds are distinct before it.
    """
    from seqlake.functions import windows

    s = lambda d, i: d.select(F.col("id").alias(i), F.explode(F.array_distinct(windows(F.col("seq"), k))).alias("seed"))
    return s(a, "a_id").join(s(b, "b_id"), "seed").groupBy("a_id", "b_id").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least)
