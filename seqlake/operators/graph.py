"""Graph operators on edge tables: components, greedy clusters, Markov clusters, label propagation, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.numbering import number_rows
from seqlake.storage import discard, materialize


#: Tables of edges are kept in parts of at least so many rows, so that few edges are few tasks.
EDGES_A_PART = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) over undirected links (a, b): the least node reached, by alternating large and small stars.

    A round that changes no edge ends it: told by one aggregate, the edges' number and the sum of their hashes. By then
    every edge leads from a node to its component.
    """
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph-links")
    mark = _checksum(e)
    while True:
        parts = 1 + mark[0] // EDGES_A_PART
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = materialize(small.coalesce(parts), "graph-stars")
        discard(e)
        last, mark, e = mark, _checksum(small), small
        if mark == last:
            break
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    labels = materialize(labels.coalesce(parts), "graph-labels")
    discard(e)
    return labels


def _checksum(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes, as decimals that can't overflow."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), h(1), h(2)).first())


#: Edges of a component up to which one task decides it in order, and edges that such a task has in all, about.
WHOLE, TOGETHER = 500_000, 250_000


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fates of all nodes that edges lead to, from edges (src, dst, at: place of src, to: place of dst, lead: src is known to lead)."""
    rep: dict = {}
    leads = set(pdf.loc[pdf["lead"], "src"])
    out = []
    for (_, dst), own in pdf.sort_values(["to", "dst", "at", "src"]).groupby(["to", "dst"], sort=False)["src"]:
        first = next((x for x in own if x in leads or rep.get(x, x) == x), dst)
        rep[dst] = first
        out.append((dst, first))
    return pd.DataFrame(out, columns=["node", "rep"])


def greedy_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rep): in length order, each node not yet taken leads and takes the untaken nodes its edges lead to.

    nodes: (node, length); edges: (src, dst). A node's fate follows from nodes that come earlier and point to it, so from
    its component alone: components of up to WHOLE edges are decided in order, many in one task, however long their
    chains. In larger ones a round decides nodes none of whose earlier neighbours is open, or whose first leader comes
    before all open ones; what is decided leaves, and what then falls apart is decided in order. Only a chain of more than
    WHOLE edges costs rounds by its length. Equal lengths go by name; repeated nodes and edges count once.
    """
    order = nodes.select("node", F.struct((-F.col("length")).alias("l"), F.col("node").alias("n")).alias("o")).groupBy("node").agg(F.min("o").alias("o"))
    src, dst = order.select(F.col("node").alias("src"), F.col("o").alias("so")), order.select(F.col("node").alias("dst"), F.col("o").alias("do"))
    # only edges from an earlier to a later node can decide anything
    back = edges.select("src", "dst").where("src <> dst").distinct().join(src, "src").join(dst, "dst").where("so < do").withColumn("lead", F.lit(False))
    back = materialize(back, "greedy-edges")
    kind = nodes.schema["node"].dataType.simpleString()
    fates = [order.select("node").join(back.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("rep", F.col("node"))]
    while not back.isEmpty():
        cc = components(back.where("NOT lead").select(F.col("src").alias("a"), F.col("dst").alias("b")))
        held = materialize(back.join(cc.withColumnRenamed("node", "dst"), "dst", "left"), "greedy-held")  # no component: leaders alone point to it
        sizes = held.where("component IS NOT NULL").groupBy("component").agg(F.count("*").alias("edges"))
        few = sizes.where(F.col("edges") <= WHOLE)
        tasks = 1 + (few.agg(F.sum("edges")).first()[0] or 0) // TOGETHER
        small = held.join(few.select("component"), "component", "left_semi").select("src", "dst", F.col("so.l").alias("at"), F.col("do.l").alias("to"), "lead", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"))
        fates.append(materialize(small.groupBy("task").applyInPandas(_in_order, f"node {kind}, rep {kind}"), "greedy-fates"))
        rest = held.join(few.select("component"), "component", "left_anti")
        pointed = rest.select(F.col("dst").alias("src")).distinct().withColumn("_open", F.lit(True))
        known = materialize(rest.join(pointed, "src", "left").withColumn("lead", F.col("lead") | F.col("_open").isNull()).drop("_open", "component"), "greedy-known")
        state = known.groupBy("dst").agg(F.min(F.when(F.col("lead"), F.struct("so", "src"))).alias("first"), F.min(F.when(~F.col("lead"), F.col("so"))).alias("open"))
        sure = F.col("open").isNull() | F.coalesce(F.col("first.so") < F.col("open"), F.lit(False))
        done = materialize(state.where(sure).select(F.col("dst").alias("node"), F.coalesce(F.col("first.src"), F.col("dst")).alias("rep")), "greedy-fates")
        fates.append(done)
        undone = known.join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = undone.join(done.select(F.col("node").alias("src"), (F.col("rep") == F.col("node")).alias("_leads")), "src", "left").where(F.coalesce("_leads", F.lit(True)))
        back = materialize(left.withColumn("lead", F.col("lead") | F.coalesce("_leads", F.lit(False))).drop("_leads"), "greedy-edges")
        fates.append(undone.select("dst").distinct().join(back.select("dst"), "dst", "left_anti").select(F.col("dst").alias("node"), F.col("dst").alias("rep")))  # followers alone pointed to it
    out = fates[0]
    for f in fates[1:]:
        out = out.unionByName(f)
    return out


def markov_clusters(edges: DataFrame, inflation: float = 2.0, max_nodes: int = 5000) -> DataFrame:
    """(node, cluster) of weighted edges (a, b, w): expansion and inflation until steady, cluster = its least node.

    Flow never leaves a connected component, so each is clustered alone, in one task of its own; components over
    max_nodes, whose dense matrix would not fit a task, as tables of matrix entries. Entries under 1e-5 of their column's
    largest are dropped, so no column is ever empty.
    """
    cc = components(edges.select("a", "b"))
    own = edges.join(cc, edges["a"] == cc["node"]).select("component", "a", "b", "w")
    alone = edges.where("a = b").select("a").distinct().join(cc, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("a").alias("cluster"))
    kind = edges.schema["a"].dataType.simpleString()
    big = materialize(cc.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > max_nodes).select("component"), "mcl-big")
    if not big.isEmpty():
        alone = alone.unionByName(_sparse_markov(own.join(big, "component", "left_semi"), inflation))
        own = own.join(big, "component", "left_anti")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"], strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = max(m[at[a], at[b]], w)
        for i in range(len(names)):  # a loop as strong as the strongest edge
            m[i, i] = max(m[i].max(), 1e-9)
        m /= m.sum(0)
        for _ in range(100):
            new = (m @ m) ** inflation
            new[new < 1e-5 * new.max(0)] = 0
            new /= new.sum(0)
            if np.abs(new - m).max() < 1e-8:
                break
            m = new
        to, top = {i: i for i in range(len(names))}, m.max(0)

        def find(i: int) -> int:
            while to[i] != i:
                i = to[i]
            return i

        for r in range(len(names)):
            members = np.flatnonzero(m[r] > 1e-6 * top)
            for x in members[1:]:
                a, b = sorted((find(members[0]), find(x)))
                to[b] = a
        return pd.DataFrame({"node": names, "cluster": [names[find(i)] for i in range(len(names))]})

    return own.groupBy("component").applyInPandas(run, f"node {kind}, cluster {kind}").unionByName(alone)


def _sparse_markov(own: DataFrame, inflation: float) -> DataFrame:
    """(node, cluster) of edges (component, a, b, w) by the steps of markov_clusters on matrix entries (i, j, v)."""
    nodes = own.select("component", F.col("a").alias("node")).union(own.select("component", "b")).distinct()
    nodes = materialize(number_rows(nodes, [F.col("component"), F.col("node")], "no").select("node", F.col("no").cast("bigint").alias("no")), "mcl-nodes")
    e = own.join(nodes.toDF("a", "i"), "a").join(nodes.toDF("b", "j"), "b").where("w > 0").select("i", "j", F.col("w").cast("double").alias("v"))
    e = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.max("v").alias("v"))
    e = materialize(e, "mcl-edges")
    # a loop as strong as the strongest edge
    loops = e.select("i", "v").unionByName(nodes.select(F.col("no").alias("i"), F.lit(1e-9).alias("v"))).groupBy("i").agg(F.max("v").alias("v"))
    m = _stochastic(e.where("i <> j").unionByName(loops.select("i", F.col("i").alias("j"), "v")))
    for _ in range(100):
        new = _squared(m).withColumn("v", F.pow("v", F.lit(inflation)))
        new = materialize(new, "mcl-square")
        top = new.groupBy("j").agg(F.max("v").alias("top"))
        new = _stochastic(new.join(top, "j").where("v >= 1e-5 * top").select("i", "j", "v"))
        both = m.unionByName(new.withColumn("v", -F.col("v"))).groupBy("i", "j").agg(F.abs(F.sum("v")).alias("d"))
        if both.agg(F.max("d")).first()[0] < 1e-8:
            break
        m = new
    top = m.groupBy("j").agg(F.max("v").alias("top"))
    flow = materialize(m.join(top, "j").where("v > 1e-6 * top").select("i", "j"), "mcl-flow")
    groups = components(flow.join(flow.groupBy("i").agg(F.min("j").alias("a")), "i").select("a", F.col("j").alias("b")))
    c = nodes.join(groups.toDF("no", "c"), "no", "left").select("node", F.coalesce("c", "no").alias("c"))
    # numbers rise with the names, so the least number is the least name
    return c.join(nodes.select(F.col("no").alias("c"), F.col("node").alias("cluster")), "c").select("node", "cluster")


def _stochastic(m: DataFrame) -> DataFrame:
    """Matrix entries (i, j, v) divided by the sum of their column j."""
    return materialize(m.join(m.groupBy("j").agg(F.sum("v").alias("sum")), "j").select("i", "j", (F.col("v") / F.col("sum")).alias("v")), "mcl-matrix")


def _squared(m: DataFrame, side: int = 1024) -> DataFrame:
    """The matrix product of entries (i, j, v) with themselves: by a join of entries where that makes fewer rows,
    else by dense products of blocks of `side` rows and columns, each task holding two blocks."""
    by = m.select(F.col("i").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(m.select(F.col("j").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    joined = by.groupBy("k").agg((F.sum("l") * F.sum("r")).alias("n")).agg(F.sum("n")).first()[0]
    b = m.withColumns({"bi": F.floor(F.col("i") / side), "bj": F.floor(F.col("j") / side)})
    sizes = materialize(b.groupBy("bi", "bj").agg(F.count("*").alias("n")), "mcl-blocks")
    left, right = sizes.select("bi", F.col("bj").alias("bk"), F.col("n").alias("ln")), sizes.select(F.col("bi").alias("bk"), "bj", F.col("n").alias("rn"))
    per = left.groupBy("bk").agg(F.count("*").alias("lb"), F.sum("ln").alias("ln")).join(right.groupBy("bk").agg(F.count("*").alias("rb"), F.sum("rn").alias("rn")), "bk")
    if joined <= per.agg(F.sum(F.col("lb") * F.col("rn") + F.col("rb") * F.col("ln"))).first()[0]:
        x, y = m.select("i", F.col("j").alias("k"), F.col("v").alias("x")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    x = b.withColumnRenamed("bj", "bk").join(right.select("bk", "bj"), "bk").select("bi", "bk", "bj", "i", "j", "v")
    y = b.withColumnRenamed("bi", "bk").join(left.select("bi", "bk"), "bk").select(F.col("bi").alias("ci"), F.col("bk").alias("ck"), F.col("bj").alias("cj"), F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("u"))

    def product(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        bi, bk, bj = (int(z) * side for z in key)
        one, two = np.zeros((side, side)), np.zeros((side, side))
        one[p["i"] - bi, p["j"] - bk] = p["v"]
        two[q["k"] - bk, q["l"] - bj] = q["u"]
        out = one @ two
        i, j = np.nonzero(out)
        return pd.DataFrame({"i": i + bi, "j": j + bj, "v": out[i, j]})

    return x.groupBy("bi", "bk", "bj").cogroup(y.groupBy("ci", "ck", "cj")).applyInPandas(product, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def propagate(members: DataFrame) -> DataFrame:
    """Labels spread in clusters: (cluster, node, length, is_ref, genus, lineage) -> adds new_genus and new_lineage.

    Without a reference, the longest member with a usable lineage labels all its cluster. With references of exactly one
    known genus, members that are none take that genus and the lineage of the longest reference of that genus.
    """
    usable = F.col("lineage").isNotNull()
    per = members.groupBy("cluster").agg(
        F.max(F.col("is_ref").cast("int")).alias("refs"), F.count_distinct(F.when(F.col("is_ref"), F.col("genus"))).alias("genera"),
        F.max(F.when(F.col("is_ref"), F.col("genus"))).alias("one_genus"),
        F.min_by("lineage", F.when(usable, F.struct((-F.col("length")).alias("l"), F.col("node").alias("n")))).alias("long_lineage"),
        F.min_by("genus", F.when(usable, F.struct((-F.col("length")).alias("l"), F.col("node").alias("n")))).alias("long_genus"),
        F.min_by("lineage", F.when(F.col("is_ref") & F.col("genus").isNotNull(), F.struct((-F.col("length")).alias("l"), F.col("node").alias("n")))).alias("ref_lineage"),
    )
    single = (F.col("refs") == 1) & (F.col("genera") == 1)
    spread = lambda own, no_ref, ref: F.when(F.col("is_ref"), F.col(own)).when(F.col("refs") == 0, F.col(no_ref)).when(single, F.col(ref)).otherwise(F.col(own))
    return members.join(per, "cluster").select(*members.columns, spread("genus", "long_genus", "one_genus").alias("new_genus"), spread("lineage", "long_lineage", "ref_lineage").alias("new_lineage"))


def largest_components(labels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(component, size): the k largest components that hold a query node; ties to the smaller name."""
    own = labels.join(queries.select("node"), "node", "left_semi").select("component").distinct()
    return labels.join(own, "component", "left_semi").groupBy("component").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "component").limit(k)


def number_clusters(clusters: DataFrame) -> DataFrame:
    """(node, cluster) -> adds size and name: `group_i` numbered by cluster, or `singleton`.

    Clusters of two or more are numbered by ranges, so no task sees them all.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    many = number_rows(sizes.where("size > 1").select(F.col("cluster").alias("c")), [F.col("c")], "no")
    j = clusters.join(sizes, "cluster").join(many, F.col("cluster") == F.col("c"), "left")
    return j.select("node", "cluster", "size", F.when(F.col("no").isNotNull(), F.concat(F.lit("group_"), F.col("no").cast("string"))).otherwise(F.lit("singleton")).alias("name"))


def node_table(*parts: DataFrame) -> DataFrame:
    """Union of node tables (accession, label, type); the first part that names an accession wins."""
    return _first_wins(parts, ["accession"])


def edge_table(*parts: DataFrame) -> DataFrame:
    """Union of edge tables (source, target, weight); the first part that holds a pair wins, then the heavier edge."""
    return _first_wins(parts, ["source", "target"])


def _first_wins(parts: tuple[DataFrame, ...], keys: list[str]) -> DataFrame:
    every = None
    for k, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(k))
        every = one if every is None else every.unionByName(one)
    rest = [c for c in every.columns if c not in (*keys, "_part")]
    w = Window.partitionBy(*keys).orderBy("_part", *[F.col(c).desc() for c in rest])
    return every.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_part")
