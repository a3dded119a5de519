"""Evidence by source: precedence, multi-source tables, lineage fallback, agreement, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions import genome_of, or_dash
from seqlake.operators.besthit import first_per_key, spacer_hits, trna_hits
from seqlake.operators.numbering import number_rows

#: Order of trust of the host evidence: earlier wins.
METHODS = ("CRISPR-based (MAG)", "BLASTN-based", "tRNA-based", "k-mer-based", "AAI-based", "CRISPR-based (DB)")


def evidence(hits: DataFrame, method: str) -> DataFrame:
    return hits.select("accession", "host", F.col("score").cast("double").alias("score"), F.lit(method).alias("method"), F.lit(METHODS.index(method)).alias("priority"))


def crispr(hits: DataFrame, identity: float, cover: float) -> DataFrame:
    """Best spacer hit for each contig; the host is what stands before `_CRISPR_`, score 0 to 1."""
    h = spacer_hits(hits, identity, cover)
    best = first_per_key(h, ["qseqid"], [F.col("pident").desc(), F.col("cov").desc(), F.col("sseqid")])
    return best.select(F.col("qseqid").alias("accession"), F.substring_index("sseqid", "_CRISPR_", 1).alias("host"), (F.col("pident") / 100).alias("score"))


def crispr_db(hits: DataFrame, identity: float, cover: float) -> DataFrame:
    """As crispr(), for reference spacers: the host's assembly is the first `|` item with `GC`, cut at its version."""
    h = spacer_hits(hits, identity, cover)
    best = first_per_key(h, ["qseqid"], [F.col("pident").desc(), F.col("cov").desc(), F.col("sseqid")])
    item = F.get(F.filter(F.split("sseqid", "[|]"), lambda x: x.contains("GC")), F.lit(0))
    return best.select(F.col("qseqid").alias("accession"), F.substring_index(item, ".", 1).alias("host"), (F.col("pident") / 100).alias("score"))


def prophage(hits: DataFrame, least: int) -> DataFrame:
    """Longest prophage hit of at least `least` bases for each contig (qseqid), with its MAG."""
    best = first_per_key(hits.where(F.col("length") >= least), ["qseqid"], [F.col("length").desc(), F.col("pident").desc(), F.col("mag")])
    return best.select(F.col("qseqid").alias("accession"), F.col("mag").alias("host"), (F.col("pident") / 100).alias("score"))


def trna(hits: DataFrame, cover: float) -> DataFrame:
    best = first_per_key(trna_hits(hits, cover), ["virus"], [F.col("pident").desc(), F.col("cov").desc(), F.col("mag")])
    return best.select(F.col("virus").alias("accession"), F.col("mag").alias("host"), (F.col("pident") / 100).alias("score"))


def by_genus(calls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Host of each contig's genus: calls (accession, genus, scores), hosts (genus, host). The score is the last of the
    `;`-joined scores, 1 where there is none."""
    last = F.element_at(F.split("scores", ";"), -1).try_cast("double")
    return calls.join(hosts.select("genus", "host"), "genus").select("accession", "host", F.coalesce(last, F.lit(1.0)).alias("score"))


def by_precedence(rows: DataFrame) -> DataFrame:
    """One host for each accession: of the most trusted method, then the best score, then the host's name."""
    return first_per_key(rows, ["accession"], [F.col("priority"), F.col("score").desc(), F.col("host")])


def multi(*parts: DataFrame) -> DataFrame:
    """All evidence, columns united, one row for each (accession, host, method), the best score first."""
    every = None
    for p in parts:
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    return first_per_key(every, ["accession", "host", "method"], [F.col("score").desc()])


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str = "-") -> DataFrame:
    """Left join with a dimension (key, value); a missing value becomes the default. Spark broadcasts a small dimension."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(default)))


def fallback(df: DataFrame, dims: list[tuple[str, DataFrame, str, str]], out: str, default: str = "-") -> DataFrame:
    """The first value that the (column, dimension, key, value) lookups find, in their order, as `out`."""
    found = []
    for k, (column, dim, key, value) in enumerate(dims):
        d = dim.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}"))
        df = df.join(d, F.col(column) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        found.append(F.col(f"_v{k}"))
    return df.withColumn(out, F.coalesce(*found, F.lit(default))).drop(*[f"_v{k}" for k in range(len(dims))])


def agreement(calls: DataFrame, ranks: tuple[str, ...] = ("species", "genus", "family")) -> DataFrame:
    """Accept a k-mer host if the aligned one is the same genome, else report the lowest rank on which both agree.

    calls: host, other, and for each rank `<rank>_host`, `<rank>_other`. Adds agreed: genome, a rank, or null.
    """
    out: Column = F.when(F.col("host") == F.col("other"), F.lit("genome"))
    for r in ranks:
        out = out.when(F.col(f"{r}_host") == F.col(f"{r}_other"), F.lit(r))
    return calls.withColumn("agreed", out)


def mag_identity(hits: DataFrame) -> DataFrame:
    """(phage, mag, ident): the largest identity, 0 to 1, of any protein hit (qseqid, mag, pident) of a phage in each MAG."""
    return hits.groupBy(genome_of(F.col("qseqid")).alias("phage"), "mag").agg((F.max("pident") / 100).alias("ident"))


def mean_identity(phages: DataFrame, per_mag: DataFrame) -> DataFrame:
    """(phage, mean): the mean of a phage's largest identities, 0 where it has none; summed exactly, so reruns agree to the last digit."""
    exact = F.col("ident").try_cast("decimal(28,18)")
    m = per_mag.groupBy("phage").agg(F.try_divide(F.sum(exact).cast("double"), F.count(exact)).alias("mean"))
    return phages.select("phage").join(m, "phage", "left").select("phage", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def kmer_gate(calls: DataFrame, per_mag: DataFrame, taxa: DataFrame | None = None) -> DataFrame:
    """(accession, host, score): k-mer calls (accession, host) that protein hits bear out.

    A MAG with a hit stays, with its identity. Else, if taxa (mag, species, genus, family) are given, the lowest rank is
    reported on which the MAG agrees with the last hit MAG (by name) that has that rank, with the mean identity. Calls of
    phages without any hit, and those that agree on nothing, are dropped.
    """
    own = per_mag.select(F.col("phage").alias("accession"), F.col("mag").alias("host"), F.col("ident").alias("exact"))
    j = calls.select("accession", "host").join(own, ["accession", "host"], "left")
    mean = mean_identity(calls.select(F.col("accession").alias("phage")).distinct(), per_mag).withColumnRenamed("phage", "accession")
    j = j.join(mean, "accession").join(per_mag.select(F.col("phage").alias("accession")).distinct(), "accession", "left_semi")
    host = F.when(F.col("exact").isNotNull(), F.col("host"))
    if taxa is not None:
        ranks = ("species", "genus", "family")
        known = per_mag.join(taxa, "mag")
        last = known.groupBy(F.col("phage").alias("accession")).agg(*[F.max_by(r, F.when(F.col(r).isNotNull(), F.col("mag"))).alias("o_" + r) for r in ranks])
        j = j.join(last, "accession", "left").join(taxa.select(F.col("mag").alias("host"), *ranks), "host", "left")
        for r in ranks:
            host = host.when(F.col(r) == F.col("o_" + r), F.col(r))
    return j.select("accession", host.alias("host"), F.round(F.coalesce("exact", "mean"), 2).alias("score")).where("host is not null")


def strict_lookup(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join with a dimension (key, value) that must know every key: names some that it lacks and raises otherwise."""
    missing = [str(r[0]) for r in df.select(key).distinct().join(dim.select(key), key, "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"no {value} for {key} {', '.join(missing)}")
    return df.join(dim.select(key, value), key)


def check_complete(names: DataFrame, known: DataFrame, what: str = "MAGs") -> None:
    """Raise unless every name of the first one-column table is in the second."""
    n = names.join(known.toDF(*names.columns), names.columns, "left_anti").limit(1).count()
    if n:
        raise ValueError(f"not all {what} have an annotation; names carry no file suffix")


def with_reason(inputs: DataFrame, results: DataFrame, key: str, value: str, least: int, length: str = "length") -> DataFrame:
    """Every input row: its result, or why there is none (`filtered by length`, or `-`)."""
    j = inputs.join(results.select(key, value), key, "left")
    return j.withColumn(value, F.coalesce(F.col(value).cast("string"), F.when(F.col(length) < least, F.lit("filtered by length")).otherwise(F.lit("-"))))


def summary(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of prediction tables; what a table lacks is `-`."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out.select(*keys, *[or_dash(F.col(c)).alias(c) for c in out.columns if c not in keys])


def any_substring(text: Column, groups: list[str]) -> Column:
    """'Y' if the text holds any of the groups, else 'N'; null text holds none."""
    hit = F.lit(False)
    for g in groups:
        hit = hit | F.coalesce(F.contains(text, F.lit(g)), F.lit(False))
    return F.when(hit, "Y").otherwise("N")


def continuous_ids(clustered: DataFrame, every: DataFrame, node: str = "node") -> DataFrame:
    """(node, cluster_no): given numbers stay; nodes without one get the next numbers in order of their name."""
    top = clustered.agg(F.coalesce(F.max("cluster_no"), F.lit(0)).alias("top"))
    free = every.join(clustered, node, "left_anti")
    free = number_rows(free.select(node), [F.col(node)], "no")
    free = free.join(F.broadcast(top), F.lit(True)).select(node, (F.col("top") + F.col("no")).cast("bigint").alias("cluster_no"))  # top is one row
    return clustered.select(node, F.col("cluster_no").cast("bigint").alias("cluster_no")).unionByName(free)
