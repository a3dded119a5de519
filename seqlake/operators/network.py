"""Genomes by the protein clusters they share: profile tables, exact shared counts without the pairs of common clusters, tail probabilities.

Two sets with at least k items in common share one of their rarest items: each set leaves out its k - 1 most common items and
still meets every set it must. What remains meets in an equi-join on the item; an item of many sets is dealt out over pairs
of blocks of its sets, so no task holds all of them. Counts are then taken from the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.operators.numbering import number_rows
from seqlake.storage import materialize

#: Sets of one item that meet in one group of a join.
BLOCK = 1000


def shared_items(members: DataFrame, least: int | DataFrame = 1) -> DataFrame:
    """(a, b, shared): pairs a < b of ids that share at least `least` distinct items; members is (id, item).

    `least` is a number, or a table (id, least): a pair then needs the larger of its two. Items are told apart by their MD5.
    Null ids and null items take no part; repeated rows count once; an id alone shares nothing. No pair is left out: a
    common item costs pairs only as far as sets have too few rarer items to meet by.
    """
    key = F.unhex(F.md5(F.col("item").cast("string").cast("binary")))
    m = materialize(members.where("id IS NOT NULL AND item IS NOT NULL").select("id", key.alias("item")).distinct(), "set-members")
    often = m.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1")
    m = materialize(m.join(often, "item"), "set-shared")
    sets = m.groupBy("id").agg(F.collect_list("item").alias("items"))
    need = F.lit(least).cast("long") if isinstance(least, int) else F.col("least").cast("long")
    ranked = m.withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy("sets", "item"))).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    ranked = (ranked if isinstance(least, int) else ranked.join(least.select("id", "least"), "id")).where(F.col("no") <= F.col("n") - F.greatest(need, F.lit(1)) + 1)

    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    own = ranked.select("id", "item", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = own.withColumn("other", other).select("id", "item", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    a, b = (own.select(F.col("id").alias(x), F.col("block").alias("block_" + x), "item", "lo", "hi") for x in "ab")
    met = a.join(b, ["item", "lo", "hi"]).where("a < b AND (lo = hi OR block_a <> block_b)").select("a", "b").distinct()
    set_of = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias("items_" + x))
    found = met.join(set_of("a"), "a").join(set_of("b"), "b").select("a", "b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("shared"))
    if isinstance(least, int):
        return found.where(F.col("shared") >= least)
    more = lambda x: least.select(F.col("id").alias(x), F.col("least").alias("least_" + x))
    return found.join(more("a"), "a").join(more("b"), "b").where(F.col("shared") >= F.greatest("least_a", "least_b")).select("a", "b", "shared")


def cluster_profiles(genes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, genomes, clusters) of genes (gene, genome, keywords) in clusters (cluster, gene).

    profiles: (genome, cluster), once each. genomes: (genome, proteins, clusters, singletons), singletons being the genes
    beyond one for each of its clusters; a genome without clusters has as many as proteins. clusters: (cluster, size,
    annotated, keys): members, genes with keywords, and `keyword (n)` by count, then name, joined by `; `. Members that
    are no known gene count in size only; null genomes and clusters take no part.
    """
    g = genes.where("genome IS NOT NULL")
    placed = members.where("cluster IS NOT NULL").select("cluster", F.col("gene").alias("_gene"))
    both = g.join(placed, F.col("gene") == F.col("_gene")).drop("_gene")
    profiles = both.select("genome", "cluster").distinct()
    per = profiles.groupBy("genome").agg(F.count("*").alias("clusters"))
    genomes = g.groupBy("genome").agg(F.count("*").alias("proteins")).join(per, "genome", "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))
    genomes = genomes.withColumn("singletons", F.col("proteins") - F.col("clusters"))
    words = both.where("keywords IS NOT NULL").select("cluster", F.explode(F.split("keywords", ";")).alias("key")).groupBy("cluster", F.trim("key").alias("key")).agg(F.count("*").alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), lambda x: F.concat(x["key"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")")))
    keys = words.groupBy("cluster").agg(F.array_join(listed, "; ").alias("keys"))
    known = both.groupBy("cluster").agg(F.count("keywords").alias("annotated"))
    clusters = placed.groupBy("cluster").agg(F.count("*").alias("size")).join(known, "cluster", "left").join(keys, "cluster", "left")
    return profiles, genomes, clusters.withColumn("annotated", F.coalesce("annotated", F.lit(0)))


def incidence(profiles: DataFrame) -> DataFrame:
    """(row, column): profiles as places in a matrix, genomes and clusters numbered from 0 in order of name."""
    number = lambda c, out: number_rows(profiles.select(c).distinct(), [F.col(c)], out).withColumn(out, F.col(out) - 1)
    return profiles.join(number("genome", "row"), "genome").join(number("cluster", "column"), "cluster").select("row", "column")


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1025)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """log n! of whole numbers: a table, and the asymptotic series beyond it."""
    n = np.asarray(n, np.float64)
    x = np.maximum(n, 1024.0)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 1024, _SMALL[np.minimum(n, 1024).astype(np.int64)], series)


def log_tail(k: np.ndarray, total: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of P(X >= k), X hypergeometric: shared items of sets of a and b out of `total`; -inf where it can't be.

    The first term by factorials, the rest by the ratio of neighbours, for all rows at once, until no row gains.
    """
    k, a, b = (np.asarray(x, np.float64) for x in (k, a, b))
    k = np.maximum(k, np.maximum(0, a + b - total))
    possible = (k <= np.minimum(a, b)) & (a <= total) & (b <= total)
    i = np.where(possible, k, np.maximum(0, a + b - total))
    safe = lambda x: np.maximum(x, 0)
    choose = lambda n, r: log_factorial(safe(n)) - log_factorial(safe(r)) - log_factorial(safe(n - r))
    first = choose(a, i) + choose(total - a, b - i) - choose(np.full_like(a, total), b)
    term, whole = np.ones_like(first), np.ones_like(first)
    while True:
        ratio = safe(a - i) * safe(b - i) / ((i + 1) * np.maximum(total - a - b + i + 1, 1))
        term = term * ratio
        whole += term
        i = i + 1
        if not ((term > 1e-18 * whole) & (term > 0)).any():
            break
        big = whole > 1e200
        if big.any():
            first, term, whole = np.where(big, first + math.log(1e200), first), np.where(big, term / 1e200, term), np.where(big, whole / 1e200, whole)
    return np.where(possible, np.minimum(first + np.log(whole), 0.0), -np.inf)


def shared_cluster_edges(profiles: DataFrame, genomes: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """(a, b, shared, weight) of genomes by the clusters they share, from cluster_profiles().

    weight = -log10 P(X >= shared) - log10(number of pairs of genomes), X hypergeometric over all clusters and singletons,
    with the sets' sizes being their proteins' clusters and singletons; kept above `least`, cut at `most`. A pair needs at
    least as many shared clusters as its genomes would in the best case, which leaves common clusters out of the join.
    """
    g = materialize(genomes.select("genome", F.col("clusters") + F.col("singletons").alias("n")).toDF("genome", "n"), "net-genomes")
    pool = genomes.agg(F.count("*").alias("genomes"), F.coalesce(F.sum("singletons"), F.lit(0)).alias("singletons")).first()
    total = profiles.select("cluster").distinct().count() + pool.singletons
    log_pairs = math.log10(max(1.0, 0.5 * pool.genomes * (pool.genomes - 1)))

    @F.pandas_udf("long")
    def fewest(n: pd.Series) -> pd.Series:
        """Shared items from which a set of n can be significant at all: with a set of just those items."""
        n_, k = n.to_numpy(np.float64), np.ones(len(n))
        while True:
            low = (k <= n_) & (-log_tail(k, total, n_, k) / math.log(10) - log_pairs <= least)
            if not low.any():
                return pd.Series(np.maximum(k, 1).astype(np.int64))
            k = k + low

    @F.pandas_udf("double")
    def surprise(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(-log_tail(k.to_numpy(), total, a.to_numpy(), b.to_numpy()) / math.log(10))

    need = g.select(F.col("genome").alias("id"), fewest("n").alias("least"))
    pairs = shared_items(profiles.select(F.col("genome").alias("id"), F.col("cluster").alias("item")), materialize(need, "net-needs"))
    size = lambda x: g.select(F.col("genome").alias(x), F.col("n").alias("n_" + x))
    weight: Column = F.least(surprise("shared", "n_a", "n_b") - F.lit(log_pairs), F.lit(most))
    return pairs.join(size("a"), "a").join(size("b"), "b").withColumn("weight", weight).where(F.col("weight") > least).select("a", "b", "shared", "weight")
