"""Table functions for SQL: open frames of a sequence, called laterally for each row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="start int, end int, strand int, partial_left boolean, partial_right boolean")
class OpenFrames:
    """All longest open frames of at least `least` letters (stop included) on both strands of a sequence.

    Places are from 1, both ends included. A frame runs from its first start codon, or from the contig's edge where no stop
    stands before, to its stop or the contig's other edge. A null or short sequence has none.
    """

    def eval(self, seq: str, least: int) -> Iterator[tuple]:
        from seqlake.operators.genes import codons, open_frames, strand_codes

        if not seq:
            return
        raw = seq.encode()
        for strand in (1, -1):
            frames, first = open_frames(codons(strand_codes(raw, strand)), least), {}
            for a, e, kind, closed in zip(frames.start.tolist(), frames.end.tolist(), frames.kind.tolist(), frames.closed.tolist(), strict=True):
                if (e, a % 3) not in first or a < first[e, a % 3][0]:
                    first[e, a % 3] = (a, kind == 3, not closed)
            for (e, _), (a, no_start, no_stop) in sorted(first.items()):
                lo, hi = (a + 1, e) if strand > 0 else (len(raw) - e + 1, len(raw) - a)
                yield lo, hi, strand, no_start if strand > 0 else no_stop, no_stop if strand > 0 else no_start


def register(spark: SparkSession) -> None:
    """Make open_frames(seq, least) known to spark.sql()."""
    spark.udtf.register("open_frames", OpenFrames)
