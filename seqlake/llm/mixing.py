"""Operator 4: mix sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import OWN, bounded_broadcast, discard, materialize, word_count

#: Pareto ranks (log2 of odds) are first summed by steps of 1/RANK_STEP; only the step with the cut is ranked exactly.
RANK_STEP = 1 << 8
#: At most so many (source, size) or (source, rank step) rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000


def targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: its target in words.

    Sources in code-point order, null last, take `weights` in turn. They divide share * all words by weight.
    A target stops at cap * source_size; what is cut off goes to the others by weight, until none is above.
    That fixed point is the water level t with sum(min(cap*size, t*weight)) = share*all: sources fill up in
    the order of cap*size/weight, so prefix sums over that order give t in one pass instead of a loop.
    There is one row for each source; the single-partition windows see that many rows and no documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = totals.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    base = (
        base.withColumn("pool", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("t", F.greatest((F.col("pool") - F.col("filled")) / F.col("open_weight"), F.lit(0.0)))
        # t falls after the first source that its own level doesn't fill, so the largest such t is the level
        .withColumn("level", F.max(F.when(F.col("t") * F.col("weight") <= F.col("most"), F.col("t"))).over(whole))
    )
    return base.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """Add size, source_size, target, copies (0, 1, 2, ...) and taken = copies * size to every row of docs.

    Each source's target/size ratio r gives every document floor(r) certain whole copies. The rest of the target
    is one sample without replacement: a document's inclusion odds grow with its size (probability
    min(1, k*size), k solved so the expected words fill the rest; probability 1 is another certain copy). The others
    are put in Pareto order, rank = odds(u)/odds(p) with u from a hash of id and size, and taken from
    the front until the rest is filled. Fixed size counts words: the cut goes to the nearer side of the document
    that crosses it, and then one more document, the one outside that best closes the gap, may be added.

    That document is the one exception to the order, at most one (or its equal rows) in each source; a source's other
    documents keep the inclusion of the sampling design.

    The cut is found as in a radix selection: words summed by (source, rank step), then exact order inside the one
    step that crosses. So a hot source is never sorted in one task. What a document needs to know is a row for each
    source: k, the cut and the added document. Copies are an expression on the document's row, so texts never move.

    Null text has size 0 and takes 0 words, as does text without words. Null source is a source of its own, last.
    Null or repeated ids are allowed: rows that are equal in id, source and size share a rank and are taken together.
    Empty input gives empty output. Columns of docs with the names of added ones are replaced; none may start with `__sl_`.
    """
    rows = docs.withColumns({OWN + "source": F.col(source_col), OWN + "size": word_count(F.col(text_col)), OWN + "id": F.col(id_col)})
    small = materialize(_kinds(rows.select(F.col(OWN + "id").alias("id"), F.col(OWN + "source").alias("source"), F.col(OWN + "size").alias("size"))), "mix-sizes")
    p = _params(small, weights, share, cap, seed)
    discard(small)
    keys = [OWN + "id", OWN + "source", OWN + "size"]
    out = rows.drop("size", "source_size", "target", "copies", "taken").join(p, _same(F.col(OWN + "source"), F.col(OWN + "p_source")), "left")
    of = F.col(OWN + "p")
    out = out.withColumns({"size": F.col(OWN + "size"), "source_size": of["source_size"], "target": of["target"], "copies": _copies(*(F.col(c) for c in keys[::2]), of, seed)})
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(*keys, OWN + "p", OWN + "p_source")


def _kinds(rows: DataFrame) -> DataFrame:
    """Rows alike in (id, source, size) are told apart by nothing that a rerun keeps, so they are one row with their number."""
    return rows.groupBy("id", "source", "size").agg(F.count("*").alias("dup"))


def plan_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """As mix(), but only (id, source, size, dup, source_size, target, copies): one narrow row for each kind of row, no texts."""
    small = materialize(_kinds(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))), "mix-sizes")
    p = _params(small, weights, share, cap, seed)
    of = F.col(OWN + "p")
    return small.join(p, _same(F.col("source"), F.col(OWN + "p_source")), "left").select(
        "id", "source", "size", "dup", of["source_size"].alias("source_size"), of["target"].alias("target"), _copies(F.col("id"), F.col("size"), of, seed).alias("copies")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _rank(id_: Column, size: Column, of: Column, seed: int) -> Column:
    """Pareto rank in log2: log2(u/(1-u)) - log2(p/(1-p)), u kept off 0 and 1. Probability 1 ranks below every other; null is never taken."""
    u = (F.pmod(F.xxhash64(id_, size, F.lit(seed)), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    p = of["k"] * size
    sure = (size > 0) & (of["rest"] > 0) & (of["k"].isNull() | (size > of["below"]))
    return F.when(sure, F.lit(-1000.0)).when((of["rest"] > 0) & (size > 0) & (p > 0), F.log2(u / (1 - u)) - F.log2(p / (1 - p)))


def _order(rank: Column, id_: Column, size: Column, seed: int) -> Column:
    """The exact order: by rank, ties by a hash, then by id, null last, and size."""
    return F.struct(rank.alias("rank"), F.xxhash64(id_, size, F.lit(seed + 1)).alias("tie"), id_.isNull().alias("last"), id_.alias("id"), size.alias("size"))


def _picked(id_: Column, size: Column, of: Column, seed: int) -> Column:
    """Whether the sample takes the document: it comes before the cut of its source (all do if its words don't fill the rest)."""
    rank = _rank(id_, size, of, seed)
    step = F.floor(rank * RANK_STEP)
    upto = (step < of["c_step"]) | ((step == of["c_step"]) & of["edge"].isNotNull() & (_order(rank, id_, size, seed) <= of["edge"]))
    return F.coalesce(rank.isNotNull() & F.when(of["c_step"].isNull(), F.lit(True)).otherwise(upto), F.lit(False))


def _copies(id_: Column, size: Column, of: Column, seed: int) -> Column:
    added = F.coalesce(of["f_id"].eqNullSafe(id_) & (of["f_size"] == size), F.lit(False))
    return F.when(size > 0, of["whole"] + (_picked(id_, size, of, seed) | added).cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def _params(small: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """(OWN p_source, OWN p): for each source, the struct that _copies() reads; broadcast if there are few sources."""
    by_size = materialize(small.groupBy("source", "size").agg(F.sum("dup").alias("n")), "mix-by-size")
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(totals, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio + F.lit(1e-9))).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    goal = materialize(goal, "mix-targets")

    # k: sizes from the largest down are certain while (rest - certain words) / (sum of squares below) * size >= 1
    k = by_size.alias("b").join(goal.alias("g"), _same(F.col("b.source"), F.col("g.source"))).where("size > 0")
    w = Window.partitionBy("source").orderBy(F.col("size").desc())
    k = (
        k.select("g.source", "size", "n", "rest")
        .withColumn("above", F.coalesce(F.sum(F.col("size") * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("squares", F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("k", F.greatest(F.col("rest") - F.col("above"), F.lit(0.0)) / F.col("squares"))
        .where(F.col("k") * F.col("size") < 1)
        .groupBy("source")
        .agg(F.max_by(F.struct("k", "size"), F.col("size")).alias("m"))
        .select(F.col("source").alias("k_source"), F.col("m.k").alias("k"), F.col("m.size").alias("below"))
    )
    odds = goal.join(k, _same(goal["source"], k["k_source"]), "left").drop("k_source")
    odds = materialize(odds.withColumns({"source_size": F.col("source_size").cast("bigint"), "target": F.col("target").cast("double")}), "mix-odds")
    discard(goal, by_size)

    per = lambda t: bounded_broadcast(t.select(F.col("source").alias("p_source"), F.struct(*[c for c in t.columns if c != "source"]).alias("p")), BROADCAST_ROWS)
    rank, mass = _rank(F.col("id"), F.col("size"), F.col("p"), seed), F.col("size") * F.col("dup")
    d = small.join(per(odds), _same(F.col("source"), F.col("p_source"))).select("id", "source", "size", mass.alias("mass"), rank.alias("rank"), F.col("p.rest").alias("rest"))
    d = materialize(d.where("rank is not null").withColumn("step", F.floor(F.col("rank") * RANK_STEP)), "mix-ranks")

    up = Window.partitionBy("source").orderBy("step")
    cut = (
        d.groupBy("source", "step").agg(F.sum("mass").alias("mass"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("mass").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("upto") >= F.col("rest"))
        .groupBy("source").agg(F.min_by(F.struct("step", (F.col("upto") - F.col("mass")).alias("before")), F.col("step")).alias("c"))
        .select(F.col("source").alias("c_source"), F.col("c.step").alias("c_step"), "c.before")
    )
    cut = materialize(cut, "mix-cuts")
    # exact order inside the crossing step alone; the nearer side of the crossing document is the cut
    order = _order(F.col("rank"), F.col("id"), F.col("size"), seed)
    inside = d.join(bounded_broadcast(cut, BROADCAST_ROWS), _same(F.col("source"), F.col("c_source")) & (F.col("step") == F.col("c_step"))).withColumn("key", order)
    inside = inside.withColumn("upto", F.col("before") + F.sum("mass").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = inside.where(F.abs(F.col("upto") - F.col("rest")) <= F.abs(F.col("upto") - F.col("mass") - F.col("rest")))
    edge = inside.groupBy("source").agg(F.max("key").alias("edge")).withColumnRenamed("source", "e_source")
    edges = odds.join(cut.drop("before"), _same(odds["source"], cut["c_source"]), "left").drop("c_source")
    edges = materialize(edges.join(edge, _same(F.col("source"), F.col("e_source")), "left").drop("e_source"), "mix-edges")

    # one document outside may close the gap that is left
    at = d.select("id", "source", "size", "mass").join(per(edges), _same(F.col("source"), F.col("p_source")))
    at = at.withColumn("picked", _picked(F.col("id"), F.col("size"), F.col("p"), seed))
    got = at.groupBy("source").agg((F.first("p.rest") - F.sum(F.when(F.col("picked"), F.col("mass")).otherwise(F.lit(0)))).alias("gap")).where("gap > 0.5")
    got = bounded_broadcast(materialize(got.select(F.col("source").alias("g_source"), "gap"), "mix-gaps"), BROADCAST_ROWS)
    fill = at.where("not picked").join(got, _same(F.col("source"), F.col("g_source"))).where(F.col("mass") < 2 * F.col("gap"))
    fill = fill.groupBy("g_source").agg(F.min_by(F.struct("id", "size"), F.struct(F.abs(F.col("mass") - F.col("gap")), F.col("id").isNull(), F.col("id"), F.col("size"))).alias("f"))
    fill = fill.select(F.col("g_source").alias("f_source"), F.col("f.id").alias("f_id"), F.col("f.size").alias("f_size"))
    out = materialize(edges.join(fill, _same(F.col("source"), F.col("f_source")), "left").drop("f_source"), "mix-params")
    discard(d, edges, cut, odds)
    return per(out).withColumnsRenamed({"p_source": OWN + "p_source", "p": OWN + "p"})


def op4_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """Query: the mix of all documents, one row each."""
    from seqlake.llm.common import table

    p = plan_copies(table(spark, sf_dir, "documents"))
    # equal rows stand once in the plan; give each its row again
    each = p.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("dup"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
