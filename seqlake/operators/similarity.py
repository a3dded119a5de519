"""Similarity join of sequences: minimizer seeds, bands of diagonals, gapped alignment in vectorised tasks.

Seeds meet in an equi-join; a pair goes on only with bands of diagonals that hold enough of them; each band is aligned by an
affine-gap local alignment that many pairs take at once, row by row, as arrays. A hot seed's rows are one key of a plain
join, whose skewed partitions Spark splits on either side; equal sequences are aligned once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.storage import materialize

# A seed is two polynomials of its letters modulo a prime, with these bases.
PRIME, BASES = 2**31 - 1, (1_812_433_253 % (2**31 - 1), 1_664_525)
#: Seeds of the queries up to which they (some 60 bytes each) are broadcast; with more, both sides are shuffled by seed.
SEEDS = 200_000
#: Cells of direction codes that a task holds for the pairs it aligns together.
CELLS = 24_000_000
#: Rows of a batch that a task holds as Python objects at once: to find seeds, and to align.
SEEDING, ALIGNING = 256, 2048
_NEVER = -(10**6)
HITS = "pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, score int"


@dataclass(frozen=True)
class Scoring:
    """Scores of a match and a mismatch, or of letter pairs by `matrix` (others mismatch); a gap of n letters costs open + n * extend.

    `letters` is the size of the alphabet, assumed even, from which the scale of the bit score follows; `k` is the second
    constant of the extreme-value distribution.
    """

    match: int = 2
    mismatch: int = -3
    open: int = 3
    extend: int = 2
    letters: int = 4
    k: float = 0.1
    matrix: tuple[tuple[str, str, int], ...] = ()

    def table(self) -> np.ndarray:
        """Scores by byte; byte 0 stands for places outside a sequence."""
        t = np.full((256, 256), self.mismatch, np.int32)
        np.fill_diagonal(t, self.match)
        for a, b, s in self.matrix:
            t[ord(a), ord(b)] = t[ord(b), ord(a)] = s
        t[0, :] = t[:, 0] = _NEVER
        return t

    @functools.cached_property
    def scale(self) -> float:
        """The positive root of sum p_i p_j exp(x s_ij) = 1 over an even alphabet."""
        if self.matrix:
            own = sorted({x for a, b, _ in self.matrix for x in (a, b)})
            s = np.array([[self.table()[ord(a), ord(b)] for b in own] for a in own], float)
        else:
            s = np.full((self.letters, self.letters), float(self.mismatch))
            np.fill_diagonal(s, self.match)
        lo, hi = 0.0, 1.0
        mean = lambda x: float(np.exp(x * s).mean())
        while mean(hi) < 1:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
        return hi

    def bits(self, score: Column) -> Column:
        return (F.lit(self.scale) * score - F.lit(math.log(self.k))) / F.lit(math.log(2))

    def expected(self, score: Column, space: Column) -> Column:
        """Chance alignments of such a score in a search space of so many letter pairs."""
        return F.lit(self.k) * space * F.exp(F.lit(-self.scale) * score)


def seed_weights(k: int) -> list[list[int]]:
    return [[pow(m, i, PRIME) for i in range(k)] for m in BASES]


def minimizers(seq: bytes, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions from 0) of the seeds that are the least of some w neighbouring windows of k letters, equals included."""
    x = np.frombuffer(seq, np.uint8).astype(np.int64)
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high, low = (sum(x[i : i + n] * c for i, c in enumerate(weights)) % PRIME for weights in seed_weights(k))
    key = (high << 31) | low
    w = min(w, n)
    least = np.lib.stride_tricks.sliding_window_view(key, w).min(1)
    wide = np.concatenate([np.full(w - 1, -1), least, np.full(w - 1, -1)])
    at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(wide, w).max(1) == key)
    return key[at], at


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _seeds(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, SEEDING):
            keys, at = zip(*(minimizers(seq, k, w) for seq in b.column("seq").to_pylist()), strict=True)
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in keys])
            if len(row):
                yield pa.RecordBatch.from_arrays([b.column("no").take(pa.array(row)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32))], ["no", "seed", "at"])

    return run


def align_band(queries: list[bytes], targets: list[bytes], starts: list[int], width: int, scores: np.ndarray, opening: int, extend: int) -> list[tuple[int, ...]]:
    """Best local alignment of each pair with all cells on diagonals (target less query place) start .. start + width - 1.

    Gives (matches, length, mismatches, gap openings, query start, query end, target start, target end, score), places from
    1, both ends included; zeros where nothing scores. Of equal ends the least in query, then target, counts; going back, a
    step along both sequences comes before one along the query, that before one along the target, and closing a gap
    before lengthening it.
    """
    n, rows = len(queries), max(map(len, queries))
    q, t = np.zeros((n, rows), np.uint8), np.zeros((n, rows + width), np.uint8)
    for k, (a, b, lo) in enumerate(zip(queries, targets, starts, strict=True)):
        q[k, : len(a)] = np.frombuffer(a, np.uint8)
        first, last = max(0, lo), min(len(b), lo + rows + width)
        if last > first:
            t[k, first - lo : last - lo] = np.frombuffer(b, np.uint8)[first:last]
    flat, column = scores.ravel(), np.arange(width, dtype=np.int32) * extend
    codes = np.zeros((rows, n, width), np.uint8)
    h, down = np.zeros((n, width), np.int32), np.full((n, width), _NEVER, np.int32)
    best, best_row, best_column = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for i in range(rows):
        diagonal = h + flat[q[:, i, None].astype(np.int32) * 256 + t[:, i : i + width]]
        opened, longer = np.full_like(down, _NEVER), np.full_like(down, _NEVER)
        opened[:, :-1], longer[:, :-1] = h[:, 1:] - (opening + extend), down[:, 1:] - extend
        down = np.maximum(opened, longer)
        closed = np.maximum(np.maximum(diagonal, down), 0)
        right = np.full_like(down, _NEVER)
        right[:, 1:] = np.maximum.accumulate(closed + column, axis=1)[:, :-1] - column[1:] - opening
        h = np.maximum(closed, right)
        code = np.where(h == 0, 0, np.where(h == diagonal, 1, np.where(h == down, 2, 3))).astype(np.uint8)
        code |= (down > opened).astype(np.uint8) << 2
        code[:, 1:] |= (right[:, 1:] > h[:, :-1] - (opening + extend)).astype(np.uint8) << 3
        codes[i] = code
        at = h.argmax(1)
        top = h[every, at]
        better = top > best
        best[better], best_row[better], best_column[better] = top[better], i, at[better]
    found = np.zeros((n, 9), np.int64)
    live = best > 0
    i, c, state = best_row.copy(), best_column.copy(), np.zeros(n, np.int8)
    offset = np.array(starts, np.int64)
    found[:, 5], found[:, 7], found[:, 8] = best_row + 1, best_row + offset + best_column + 1, best
    while live.any():
        k = np.flatnonzero(live)
        code, now = codes[i[k], k, c[k]], state[k]
        kind = code & 3
        over = (now == 0) & (kind == 0)
        gap = (now == 0) & (kind >= 2)
        found[k[gap], 3] += 1
        now = np.where(gap, kind - 1, now)
        along = (now == 0) & ~over
        m = k[along]
        same = q[m, i[m]] == t[m, i[m] + c[m]]
        found[m, 0] += same
        found[m, 2] += ~same
        found[m, 4], found[m, 6] = i[m] + 1, i[m] + offset[m] + c[m] + 1
        found[k[~over], 1] += 1
        stays = np.where(now == 1, code & 4, code & 8) > 0
        i[k] -= np.where(over, 0, np.where(now == 2, 0, 1))
        c[k] += np.where(now == 1, 1, np.where(now == 2, -1, 0))
        state[k] = np.where((now > 0) & stays, now, 0)
        live[k[over]] = False
        live &= i >= 0
    found[best == 0] = 0
    return [tuple(map(int, r)) for r in found]


def _aligner(width: int, pad: int, scoring: Scoring):
    """Rows with qseq, sseq, band and other columns: the other columns and HITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, wide = scoring.table(), 2 * width + 2 * pad
        for b in _slices(batches, ALIGNING):
            queries, targets, bands = (b.column(c).to_pylist() for c in ("qseq", "sseq", "band"))
            done: list = [None] * b.num_rows
            left = sorted(range(b.num_rows), key=lambda k: len(queries[k]))
            while left:
                size = max(1, CELLS // (wide * len(queries[left[-1]])))
                own, left = left[-size:], left[:-size]
                for k, r in zip(own, align_band([queries[k] for k in own], [targets[k] for k in own], [bands[k] * width - pad for k in own], wide, scores, scoring.open, scoring.extend), strict=True):
                    done[k] = r
            matches, length, mismatches, gaps, qstart, qend, sstart, send, score = (np.array(x, np.int32) for x in zip(*done, strict=True))
            pident = 100.0 * matches / np.maximum(length, 1)
            rest = [k for k, c in enumerate(b.schema.names) if c not in ("qseq", "sseq", "band")]
            names = ["pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "score"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), *map(pa.array, (pident, length, mismatches, gaps, qstart, qend, sstart, send, score))], [*(b.schema.names[k] for k in rest), *names])

    return run


def similarity_join(queries: DataFrame, targets: DataFrame, k: int = 12, w: int = 6, least: int = 2, width: int = 32, scoring: Scoring = Scoring(), evalue: float = 1e-3, best_only: bool = False, same: bool = False) -> DataFrame:
    """Alignments between two tables of (id, seq): qseqid, sseqid, pident, length, mismatch, gapopen, qstart, qend, sstart,
    send, evalue, bitscore, qlen, slen, qcov, scov, as far as they are expected at most `evalue` times by chance.

    A pair is a candidate if `least` seeds (minimizers of k letters, one in w windows) lie on diagonals of one band of
    2 * width; a band that a neighbour outnumbers is left to the neighbour. Each candidate band gives its best local
    alignment over the whole of both sequences, with width / 2 more diagonals on either side; `best_only` keeps one of each
    pair. `same` leaves out a sequence's alignment with itself (equal ids). Sequences are bytes: letters count as they are.

    No seed, pair or partner is capped. Equal sequences of a side (by their MD5) are one until the end, where ids come back. Null
    sequences, and those shorter than k, align with nothing; null ids stay. Columns other than id and seq are not read.
    """
    side = lambda d, id_, no: d.select(F.col("id").alias(id_), F.col("seq").cast("binary").alias("seq")).where("length(seq) > 0").withColumn(no, F.unhex(F.md5("seq")))
    q, t = side(queries, "qseqid", "qno"), side(targets, "sseqid", "sno")
    qs = q.groupBy("qno").agg(F.any_value("seq").alias("qseq"))
    seeds = lambda d, no, seq, at: d.select(F.col(no).alias("no"), F.col(seq).alias("seq")).mapInArrow(_seeds(k, w), "no binary, seed long, at int").select(F.col("no").alias(no), "seed", F.col("at").alias(at))
    asked = seeds(qs, "qno", "qseq", "qat")
    asked = F.broadcast(asked) if asked.limit(SEEDS + 1).count() <= SEEDS else asked
    met = seeds(t, "sno", "seq", "sat").join(asked, "seed").select("qno", "sno", "qat", "sat").distinct()
    band = F.floor((F.col("sat") - F.col("qat")) / width)
    bands = met.select("qno", "sno", F.explode(F.array(band, band - 1)).alias("band")).groupBy("qno", "sno", "band").agg(F.count("*").alias("n"))
    by = Window.partitionBy("qno", "sno").orderBy("band")
    beside = lambda f: F.when(f("band").over(by) == F.col("band") + (1 if f is F.lead else -1), f("n").over(by)).otherwise(0)
    bands = bands.withColumn("beside", F.greatest(beside(F.lag), beside(F.lead))).where((F.col("n") >= least) & (F.col("n") >= F.col("beside"))).select("qno", "sno", "band")
    bands = materialize(bands, "similarity-bands")

    wanted = bands.select("sno").distinct()
    wanted = F.broadcast(wanted) if bands.count() <= SEEDS else wanted
    own = materialize(t.join(wanted, "sno", "left_semi"), "similarity-targets")
    ts = own.groupBy("sno").agg(F.any_value("seq").alias("sseq"))
    rows = bands.join(qs, "qno").join(ts, "sno").select("qno", "sno", F.length("qseq").alias("qlen"), F.length("sseq").alias("slen"), "qseq", "sseq", F.col("band").cast("long"))
    hits = rows.mapInArrow(_aligner(width, width // 2, scoring), f"qno binary, sno binary, qlen int, slen int, {HITS}").where("score > 0").distinct()
    space = t.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("space"))
    hits = hits.join(F.broadcast(space)).withColumn("evalue", scoring.expected(F.col("score"), F.col("qlen").cast("double") * F.col("space"))).where(F.col("evalue") <= evalue)
    if best_only:
        first = F.row_number().over(Window.partitionBy("qno", "sno").orderBy(F.desc("score"), "qend", "send"))
        hits = hits.withColumn("_first", first).where("_first = 1")
    named = hits.join(q.select("qno", "qseqid"), "qno").join(own.select("sno", "sseqid"), "sno")
    if same:
        named = named.where("qseqid <> sseqid")
    share = lambda a, b, n: (100.0 * (F.col(b) - F.col(a) + 1) / F.col(n)).alias
    return named.select(
        "qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", scoring.bits(F.col("score")).alias("bitscore"), "qlen", "slen",
        share("qstart", "qend", "qlen")("qcov"), share("sstart", "send", "slen")("scov"), "score",
    )
