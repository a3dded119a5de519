"""Protein annotation: best hit, its description and identifiers, and the annotated share of each genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import genome_of

NO_HIT, NO_NAME = "hypothetical protein (no hit)", "hypothetical protein"


def annotate(genes: DataFrame, best_hits: DataFrame, names: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """genes (orf_id, …) with annotation, pident, coverage of the best hit (qseqid, sseqid, pident, coverage); names: (protein, description).

    With references (protein, reference), inference is the reference's accession of the hit, `-` if it has none.
    """
    h = best_hits.select(F.col("qseqid").alias("orf_id"), "sseqid", "pident", "coverage")
    j = genes.join(h, "orf_id", "left").join(names, F.col("sseqid") == F.col("protein"), "left")
    text = F.when(F.col("sseqid").isNull(), NO_HIT).otherwise(F.coalesce("description", F.lit(NO_NAME)))
    j = j.withColumn("annotation", text).drop("protein", "description")
    if references is None:
        return j
    r = references.select(F.col("protein").alias("_protein"), "reference")
    return j.join(r, F.col("sseqid") == F.col("_protein"), "left").withColumn("inference", F.coalesce("reference", F.lit("-"))).drop("_protein", "reference")


def annotation_rate(annotated: DataFrame) -> DataFrame:
    """(accession, proteins, annotated, rate): genes whose annotation is a name."""
    named = ~F.col("annotation").isin(NO_HIT, NO_NAME)
    g = annotated.groupBy(genome_of(F.col("orf_id")).alias("accession")).agg(F.count("*").alias("proteins"), F.count_if(named).alias("annotated"))
    return g.withColumn("rate", F.round(F.try_divide(F.col("annotated").cast("double"), "proteins"), 2))
