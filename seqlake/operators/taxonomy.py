"""Taxonomy: closure of a tree, lowest common ancestors, lineage strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.storage import materialize


#: A tree deeper than this has a cycle.
DEEPEST = 1 << 20


def closure(nodes: DataFrame) -> DataFrame:
    """(taxid, ancestor, depth) for each node and ancestor, itself included; depth is the ancestor's, 1 at a root.

    A root is its own parent. Pointer doubling: round k knows the ancestors up to 2**k steps, so rounds are few; they end
    when no node has an ancestor so far up. A cycle raises.
    """
    n = nodes.select("taxid", "parent")
    up = materialize(n.where("taxid <> parent").select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")), "tax-up")
    known = up
    jump, reach = up, 1
    while not jump.isEmpty():
        if reach > DEEPEST or not known.where("taxid = ancestor").isEmpty():
            raise ValueError("the tree has a cycle")
        far = jump.select(F.col("taxid").alias("ancestor"), F.col("ancestor").alias("to"), F.col("steps").alias("more"))
        # ancestors beyond the last known one of each node
        longer = known.join(far, "ancestor").select("taxid", F.col("to").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        known = materialize(known.union(longer.where(F.col("steps") > reach)).distinct(), "tax-known")
        reach *= 2
        jump = known.where(F.col("steps") == reach)
    whole = known.union(n.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("steps")))
    height = whole.groupBy("taxid").agg(F.max("steps").alias("height"))
    return whole.join(height, "taxid").select("taxid", "ancestor", (F.col("height") - F.col("steps") + 1).alias("depth"))


def orf_lca(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """(orf, lca, bits): deepest taxid over all mapped hits (orf, taxid, bitscore), and the best bit score of all hits.

    lca is null where no hit has a taxid in the tree.
    """
    best = hits.groupBy("orf").agg(F.max("bitscore").alias("bits"))
    # one row for each ORF and taxid before the tree multiplies them
    taxa = hits.select("orf", "taxid").distinct().join(tree, "taxid")
    n = taxa.where("taxid = ancestor").groupBy("orf").agg(F.count("*").alias("n"))
    per = taxa.groupBy("orf", "ancestor").agg(F.count("*").alias("k"), F.max("depth").alias("depth"))
    lca = per.join(n, "orf").where("k = n").groupBy("orf").agg(F.max_by("ancestor", "depth").alias("lca"))
    return best.join(lca, "orf", "left").select("orf", "lca", "bits")


def weighted_lca(orfs: DataFrame, tree: DataFrame, share: float = 0.5) -> DataFrame:
    """(contig, ancestor, depth, score): the lineage of each contig's best taxon, with the share of bits of every node on it.

    orfs: (contig, taxid, bits). Taxa that hold more than `share` of the contig's bits are candidates; the one with the
    longest lineage wins, then the largest sum of shares along it, then the greater taxid. All its lineage is returned, as
    ancestors hold no less than their descendants.
    """
    total = orfs.join(tree.select("taxid").distinct(), "taxid", "left_semi").groupBy("contig").agg(F.sum("bits").alias("total"))
    per = orfs.join(tree, "taxid").groupBy("contig", "ancestor").agg(F.sum("bits").alias("s"), F.max("depth").alias("depth"))
    score = per.join(total, "contig").withColumn("score", F.try_divide("s", "total")).select("contig", "ancestor", "depth", "score")
    able = score.where(F.col("score") > share)
    longest = able.join(able.groupBy(F.col("contig").alias("c")).agg(F.max("depth").alias("most")), (F.col("contig") == F.col("c")) & (F.col("depth") == F.col("most"))).select("contig", F.col("ancestor").alias("taxid"))
    along = longest.join(tree.select("taxid", "ancestor"), "taxid").join(score, ["contig", "ancestor"])
    sums = along.groupBy("contig", "taxid").agg(F.round(F.sum("score"), 9).alias("sum")).groupBy("contig").agg(F.max_by("taxid", F.struct("sum", "taxid")).alias("taxid"))
    return along.join(sums, ["contig", "taxid"], "left_semi").select("contig", "ancestor", "depth", "score")


#: Names that are written otherwise in lineages.
RENAMES = {"Tailed phages": "Caudoviricetes"}


def lineage_strings(path: DataFrame, names: DataFrame, root: str, renames: dict[str, str] | None = None) -> DataFrame:
    """(contig, lineage, scores): `rank:name` from the root down and the scores with two places, joined by `;`.

    The root and nodes of no rank are left out; names: (taxid, rank, name). A node that it lacks is `unknown:unknown`.
    """
    old = F.coalesce("name", F.lit("unknown"))
    new = old
    for a, b in (RENAMES if renames is None else renames).items():
        new = F.when(old == a, F.lit(b)).otherwise(new)
    j = path.join(names, path["ancestor"] == names["taxid"], "left").withColumn("rank", F.coalesce("rank", F.lit("unknown")))
    j = j.where((F.col("ancestor") != root) & (F.col("rank") != "no rank")).withColumn("name", new)
    g = j.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("depth", F.concat_ws(":", "rank", "name").alias("label"), F.format_string("%.2f", "score").alias("s")))).alias("p"))
    return g.select("contig", F.array_join("p.label", ";").alias("lineage"), F.array_join("p.s", ";").alias("scores"))
