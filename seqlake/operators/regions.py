"""Viral and host regions along a contig: marker labels, window contrasts, boundaries, quality, extraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the boundary search.
MIN_DELTA, GC_WEIGHT, MIN_HOST, MIN_VIRAL, SMALL_CONTIG, MIN_HOST_SHARE = 1.2, 0.02, 2, 2, 10, 0.30


def label_genes(genes: DataFrame, marker_hits: DataFrame, markers: DataFrame) -> DataFrame:
    """genes with label 1 (viral marker), -1 (microbial) or 0; marker_hits: (orf_id, target), markers: (domain, category)."""
    value = F.when(F.col("category") == "viral", 1).when(F.col("category") == "microbial", -1)
    known = marker_hits.join(markers.withColumn("_label", value), marker_hits["target"] == markers["domain"]).groupBy("orf_id").agg(F.max("_label").alias("_label"))
    return genes.join(known, "orf_id", "left").withColumn("label", F.coalesce("_label", F.lit(0))).drop("_label")


def marker_counts(genes: DataFrame) -> DataFrame:
    return genes.groupBy("accession").agg(F.count("*").alias("genes"), F.count_if(F.col("label") == 1).alias("viral"), F.count_if(F.col("label") == -1).alias("host"))


def window_size(n: Column) -> Column:
    """A window of three tenths of the genes, halves to even, but at least 15 and at most 50."""
    return F.least(F.greatest(F.lit(15), F.bround(F.lit(0.3) * n, 0).cast("int")), F.lit(50))


def window_delta(genes: DataFrame, size: int = 15) -> DataFrame:
    """Contrast of the mean label before and after each gene boundary, over `size` genes either side, by prefix frames.

    Genes without a label on a side give 0 there.
    """
    w = Window.partitionBy("accession").orderBy("gene_no")
    mean = lambda f: F.avg(F.when(F.col("label") != 0, F.col("label"))).over(f)
    a, b = mean(w.rowsBetween(-(size - 1), 0)), mean(w.rowsBetween(1, size))
    delta = F.coalesce(F.abs(a - b) * F.signum(a - b), F.lit(0.0))
    return genes.withColumn("delta", F.round(delta, 6))


class _Genes:
    """One contig's genes in order, with running sums so that any window's contrast is a few lookups."""

    def __init__(self, label: list[int], gc: list[float], end: list[int]):
        self.n, self.label, self.end = len(label), np.array(label), end
        run = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.viral, self.host, self.gc = run(self.label == 1), run(self.label == -1), run(np.array(gc, dtype=float))
        self.labelled = np.flatnonzero(self.label)

    def counts(self, s: int, e: int) -> tuple[int, int]:
        return int(self.viral[e] - self.viral[s]), int(self.host[e] - self.host[s])

    def contrast(self, s1: int, e1: int, s2: int, e2: int) -> tuple[float, tuple[int, int, int, int]]:
        """Signed contrast of two windows [s1, e1) and [s2, e2) and the windows as they then are.

        A window without a labelled gene grows outwards: the left one to the nearest labelled gene; the right one up to,
        but not with, the nearest labelled gene that is at least one past its end.
        """
        if sum(self.counts(s1, e1)) == 0:
            k = np.searchsorted(self.labelled, s1)
            s1 = int(self.labelled[k - 1]) if k else s1
        if sum(self.counts(s2, e2)) == 0:
            k = np.searchsorted(self.labelled, e2 + 1)
            e2 = int(self.labelled[k]) if k < len(self.labelled) else e2
        (v1, h1), (v2, h2) = self.counts(s1, e1), self.counts(s2, e2)
        delta = 0.0
        if v1 + h1 and v2 + h2:
            by = (v1 - h1) / (v1 + h1) - (v2 - h2) / (v2 + h2)
            gc = abs((self.gc[e1] - self.gc[s1]) / (e1 - s1) - (self.gc[e2] - self.gc[s2]) / (e2 - s2))
            delta = float((abs(by) + gc * GC_WEIGHT) * np.sign(by))
        return delta, (s1, e1, s2, e2)

    def admissible(self, delta: float, w: tuple[int, int, int, int]) -> bool:
        """Strong enough, with host and viral genes on the sides that the sign names, and enough host genes in a window."""
        s1, e1, s2, e2 = w
        (v1, h1), (v2, h2) = self.counts(s1, e1), self.counts(s2, e2)
        host, viral = (h1, v2) if delta < 0 else (h2, v1)
        enough = self.n <= SMALL_CONTIG or (host >= MIN_HOST and viral >= MIN_VIRAL)
        share = max(h1 / (e1 - s1), h2 / (e2 - s2) if e2 > s2 else 0.0)
        return abs(delta) >= MIN_DELTA and host > 0 and viral > 0 and enough and share >= MIN_HOST_SHARE

    def breaks(self) -> list[tuple[int, int, int, int]]:
        """Windows of the boundaries, found one after the other: each search starts at the last boundary, leaves a full
        window behind it, and climbs from the first admissible boundary while the next one is of its sign and stronger."""
        size = min(max(15, round(0.3 * self.n)), 50)
        found: list[tuple[int, int, int, int]] = []
        while True:
            s, top = found[-1][2] if found else 0, None
            for i in range(s + size if s else 1, self.n):
                d, w = self.contrast(s, i, i, min(i + size, self.n))
                if not self.admissible(d, w):
                    continue
                if top is not None and not (np.sign(d) == np.sign(top[0]) and abs(d) > abs(top[0])):
                    break
                top = (d, w)
            if top is None:
                return found
            found.append(top[1])


def _regions(pdf: pd.DataFrame) -> pd.DataFrame:
    """The regions of one contig: one up to each boundary, and the rest of the contig, of the other kind."""
    p = pdf.sort_values("gene_no")
    g = _Genes(p["label"].tolist(), p["gc"].tolist(), p["end"].tolist())
    length = int(p["contig_length"].iloc[0])
    cuts = g.breaks()
    if cuts:  # the last boundary is judged against all that follows it
        cuts[-1] = (*cuts[-1][:3], g.n)
    rows, at = [], 1
    for c in cuts:
        d, w = g.contrast(*c)
        viral, host = g.counts(w[0], w[1])
        kind, stop = "host" if d < 0 else "viral", g.end[c[1] - 1]
        rows.append((kind, c[0], c[1], at, stop, c[1] - c[0], stop - at + 1, host, viral, round(d, 6)))
        at = stop + 1
    if cuts:
        _, s1, e1 = rows[-1][:3]
        _, w = g.contrast(s1, e1, e1, g.n)
        viral, host = g.counts(w[2], w[3])
        rows.append(("viral" if rows[-1][0] == "host" else "host", e1, g.n, at, length, g.n - e1, length - at + 1, host, viral, None))
    names = ["type", "start_gene", "end_gene", "start_pos", "end_pos", "size", "length", "host_genes", "viral_genes", "delta"]
    out = pd.DataFrame(rows, columns=names)
    out.insert(0, "accession", p["accession"].iloc[0])
    return out.astype({"delta": "float64"})


REGION = "accession string, type string, start_gene int, end_gene int, start_pos int, end_pos int, size int, length int, host_genes int, viral_genes int, delta double"


def define_regions(genes: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Alternating viral and host regions of (accession, gene_no, start, end, gc, label) genes.

    start_gene counts from 0 and end_gene is exclusive; positions count from 1, regions adjoin, and the last one ends with
    the contig: contigs is (accession, length), without it the last gene's end. delta is null for the last region.
    The search depends on its own earlier choices, so each contig is one group of a Pandas kernel; a contig's genes
    are bounded by its length (some thousands).
    """
    g = genes.select(F.col("accession").cast("string"), "gene_no", F.col("end").cast("int"), F.col("gc").cast("double"), F.col("label").cast("int"))
    if contigs is None:
        sizes = g.groupBy("accession").agg(F.max("end").alias("contig_length"))
    else:
        sizes = contigs.select(F.col("accession").cast("string"), F.col("length").cast("int").alias("contig_length"))
    return g.join(sizes, "accession").groupBy("accession").applyInPandas(lambda pdf: _regions(pdf), REGION)


def region_summary(regions: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Lengths by type and the host share in percent of the contig (accession, length), with the regions listed in order.

    Without contigs the share is of the regions' own sum.
    """
    by = lambda t: F.sum(F.when(F.col("type") == t, F.col("length")).otherwise(0))
    g = regions.groupBy("accession").agg(by("host").alias("host_length"), by("viral").alias("viral_length"), F.sum("length").alias("total"), F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "type"))).alias("r"))
    if contigs is not None:
        g = g.drop("total").join(contigs.select("accession", F.col("length").alias("total")), "accession")
    text = F.array_join(F.transform("r", lambda x: F.concat(x["type"], F.lit(":"), x["start_pos"].cast("string"), F.lit("-"), x["end_pos"].cast("string"))), ";")
    return g.select("accession", "host_length", "viral_length", F.round(100 * F.try_divide(F.col("host_length").cast("double"), "total"), 2).alias("contamination"), text.alias("regions"))


def quality(n_regions: Column, viral: Column, host: Column, kmer_freq: Column) -> Column:
    """Low with regions or host genes alone; medium if host outnumbers viral; else high unless the depth is 1.25 or more."""
    return (
        F.when(n_regions > 0, "Low quality").when((viral == 0) & (host > 0), "Low quality").when((host > viral) & (viral > 0), "Medium quality")
        .when(kmer_freq < 1.25, "High quality").otherwise("Medium quality")
    )


def provirus(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """(accession, start_pos, end_pos, seq): viral regions cut out, or all regions of a contig that has no viral one."""
    w = Window.partitionBy("accession")
    some = F.max((F.col("type") == "viral").cast("int")).over(w)
    r = regions.withColumn("_viral", some).where((F.col("type") == "viral") | (F.col("_viral") == 0))
    return r.join(contigs, "accession").select("accession", "start_pos", "end_pos", F.substring("seq", F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1).alias("seq"))
