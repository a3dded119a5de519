"""Scalar column functions: ids, sequences, formats. All built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def genome_of(orf_id: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_replace(orf_id, "_[^_]*$", "")


def orf_index(orf_id: Column) -> Column:
    return F.substring_index(orf_id, "_", -1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def is_dna(seq: Column, strict: bool = False) -> Column:
    return seq.rlike("^[ACGT]*$" if strict else "^(?i)[ATCGN]*$")


def windows(seq: Column, k: int) -> Column:
    """All substrings of length k; none for a shorter sequence.

    One pass of a look-ahead: substring() by position would count code points from the start for each window.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(xs: Column) -> Column:
    """Position (0, 1, ...) of the first largest value."""
    return F.array_position(xs, F.array_max(xs)) - 1


def coverage_to_qend(length: Column, qend: Column) -> Column:
    """Aligned length over the query end, at most 1 (the end of the match stands in for the query length)."""
    return F.least(F.try_divide(length.cast("double"), qend), F.lit(1.0))


def sort_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def gtdb_rank(classification: Column, prefix: str) -> Column:
    """`prefix` and the name after it up to `;`; null where blank or absent."""
    name = F.regexp_extract(classification, prefix + "([^;]*)", 1)
    return F.when(name != "", F.concat(F.lit(prefix), name))


def format_value(x: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", x)


def or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))
