"""Writers: tab-separated tables, FASTA, alignments, model text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import or_dash


def tsv(df: DataFrame, path: str, dash: bool = True) -> None:
    """A tab-separated table with a header; nulls become `-` only here."""
    out = df.select(*[or_dash(F.col(f"`{c}`")).alias(c) if dash else F.col(f"`{c}`") for c in df.columns])
    out.write.mode("overwrite").csv(path, sep="\t", header=True)


def fasta(df: DataFrame, path: str, accession: str = "accession", seq: str = "seq", by: str | None = None) -> None:
    """FASTA records, in one folder or one folder for each value of `by`."""
    text = F.concat(F.lit(">"), F.col(accession), F.lit("\n"), F.col(seq)).alias("value")
    w = (df.select(text, F.col(by)) if by else df.select(text)).write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def model_text(sentences: DataFrame, path: str) -> None:
    """(label, text) rows for a text model."""
    sentences.select("label", "text").write.mode("overwrite").csv(path, header=True)


def kmer_table(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)
