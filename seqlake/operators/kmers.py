"""k-mer profiles and the density-based host score."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqlake.operators.density import Mixture, best_reference, fit_mixtures, gaussian

__all__ = ["Mixture", "canonical_depth", "counts", "density_argmax", "fit_mixtures", "frequencies", "gaussian", "length_model", "pair_differences", "profiles", "scaled_profiles", "vector_argmax"]


#: Ids whose counts a task holds before it hands them on.
HELD = 2000
#: References of known pairs (about 2 kB each) that are broadcast.
KNOWN = 1000


def _tally(k: int, kind: pa.DataType):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of all 4**k words of A, C, G and T alone, summed by id as far as a task's memory bound lets it."""
        size, code = 4**k, np.full(256, -1, np.int64)
        for i, c in enumerate("ACGT"):
            code[ord(c)] = code[ord(c.lower())] = i
        held: dict = {}

        def out() -> pa.RecordBatch:
            ids, rows = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["id", "over", "n"])

        for b in batches:
            for name, seq in zip(b.column("id").to_pylist(), b.column("seq").to_pylist(), strict=True):
                x = code[np.frombuffer(seq, np.uint8)]
                n = max(0, len(x) - k + 1)
                word, known = np.zeros(n, np.int64), np.ones(n, bool)
                for j in range(k):
                    word = 4 * word + x[j : j + n]
                    known &= x[j : j + n] >= 0
                over, old = held.get(name, (0, 0))
                held[name] = max(over, len(x) - 1), old + np.bincount(word[known], minlength=size)
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return tally


def _words(k: int) -> Column:
    return F.array(*[F.lit("".join(x)) for x in itertools.product("ACGT", repeat=k)])


def _tallies(seqs: DataFrame, k: int) -> DataFrame:
    """(id, over, n): counts of all words in alphabetical order and the length less one, of the rows of an id together.

    Tasks sum first, so an id has a row for each task at most; null sequences are left out.
    """
    if k > 6:
        raise ValueError("words of up to 6 letters are counted; canonical_depth takes longer ones")
    kind = seqs.schema["id"].dataType
    rows = seqs.where("seq IS NOT NULL").select("id", F.col("seq").cast("binary").alias("seq")).mapInArrow(_tally(k, to_arrow_type(kind)), f"id {kind.simpleString()}, over long, n array<long>")
    every = F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    return rows.groupBy("id").agg(F.max("over").alias("over"), F.collect_list("n").alias("all")).select("id", "over", every.alias("n"))


def counts(seqs: DataFrame, k: int = 4) -> DataFrame:
    """(id, kmer, n) of windows of A, C, G, T alone."""
    return frequencies(seqs, k).select("id", "kmer", "n")


def frequencies(seqs: DataFrame, k: int = 4) -> DataFrame:
    """(id, kmer, n, freq): counts over sequence length less one, of the words that occur."""
    each = F.filter(F.arrays_zip(_words(k).alias("kmer"), F.col("n").alias("n")), lambda x: x["n"] > 0)
    one = _tallies(seqs, k).select("id", "over", F.explode(each).alias("x"))
    return one.select("id", "x.kmer", "x.n", F.try_divide(F.col("x.n").cast("double"), "over").alias("freq"))


def distinct_canonical(seq: str, k: int) -> int:
    """How many different words of k letters a sequence has, each taken as the lesser of itself and its reverse complement.

    Words are whole numbers: letters by rank, as many to a number as fit 62 bits, so numbers compare as the words do.
    """
    x = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(x) - k + 1
    if n < 1:
        return 0
    other = x.copy()
    for a, b in zip("ACGTacgt", "TGCAtgca", strict=True):
        other[x == ord(a)] = ord(b)
    letters = np.union1d(x, other)
    bits = max(1, int(len(letters) - 1).bit_length())
    step = min(k, 62 // bits)
    parts = [(at, min(step, k - at)) for at in range(0, k, step)]

    def words(y: np.ndarray) -> list[np.ndarray]:
        """By part of the word, the number of each window's letters there."""
        power, size = {1: np.searchsorted(letters, y).astype(np.int64)}, 1
        while 2 * size <= step:
            own = power[size]
            power[2 * size] = (own[: len(own) - size] << bits * size) | own[size:]
            size *= 2
        out = []
        for at, length in parts:
            made, done = np.zeros(n, np.int64), 0
            for size in sorted(power, reverse=True):
                if size <= length - done:
                    made = (made << bits * size) | power[size][at + done : at + done + n]
                    done += size
            out.append(made)
        return out

    plain, back = words(x), [w[::-1] for w in words(other[::-1])]
    less, same = np.zeros(n, bool), np.ones(n, bool)
    for a, b in zip(plain, back, strict=True):
        less |= same & (b < a)
        same &= a == b
    least = [np.where(less, b, a) for a, b in zip(plain, back, strict=True)]
    order = [np.sort(least[0])] if len(least) == 1 else [w[np.lexsort(least)] for w in least]
    return 1 + int(np.logical_or.reduce([w[1:] != w[:-1] for w in order]).sum())


def _distinct(k: int):
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column("seq").to_pylist()
            n = [None if s is None else distinct_canonical(s, k) for s in seqs]
            size = [None if s is None else max(0, len(s) - k + 1) for s in seqs]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["id", "size", "n"])

    return distinct


def canonical_depth(seqs: DataFrame, k: int = 21) -> DataFrame:
    """(id, kmer_freq): mean multiplicity of canonical k-mers, computed within the row; null without one."""
    s = seqs.select("id", "seq").mapInArrow(_distinct(k), f"id {seqs.schema['id'].dataType.simpleString()}, size long, n long")
    return s.select("id", F.round(F.try_divide(F.col("size").cast("double"), "n"), 2).alias("kmer_freq"))


def length_model(length: Column) -> Column:
    """Which of the length models scores a contig; null up to 4 bases."""
    return F.when(length > 12500, 1).when(length > 7500, 2).when(length > 4000, 3).when(length > 2000, 4).when(length > 4, 5)


def profiles(seqs: DataFrame, k: int = 4) -> DataFrame:
    """(id, v): frequencies of all 4**k words in alphabetical order, 0 where a word does not occur; ids with no word have no row."""
    v = F.transform("n", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("over")), F.lit(0.0)))
    return _tallies(seqs, k).where(F.exists("n", lambda x: x > 0)).select("id", v.alias("v"))


def scaled_profiles(seqs: DataFrame, k: int = 4) -> DataFrame:
    """(id, v): counts of all words scaled to 0..1 within the id; null where all counts are equal."""
    low, high = F.array_min("n"), F.array_max("n")
    return _tallies(seqs, k).select("id", F.when(high > low, F.transform("n", lambda x: (x - low) / (high - low))).alias("v"))


def vector_argmax(queries: DataFrame, refs: DataFrame, skip_same: bool = False) -> DataFrame:
    """(id, best, score): for each query vector (id, v) the reference of the largest dot product. See best_reference()."""
    return best_reference(queries.select("id", "v", F.lit(0).alias("model")), refs, {0: None}, skip_same)


def density_argmax(queries: DataFrame, refs: DataFrame, models: dict[int, Callable], skip_same: bool = False) -> DataFrame:
    """(id, best, score): for each query (id, v, model) the reference whose difference to it the model finds likeliest.

    models: number -> fitted Mixture, or a function from rows of differences (query less reference) to log-densities. A
    query whose model is null or unknown gets no row.
    """
    return best_reference(queries, refs, models, skip_same)


def pair_differences(pairs: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(model, x) of known pairs (id, ref): profile of the query (id, v, model) less that of the reference (id, v).

    Few references (KNOWN at most), which many pairs may share, are broadcast; more are joined by a shuffle.
    """
    wanted = pairs.select("ref").distinct()
    r = refs.select(F.col("id").alias("ref"), F.col("v").alias("_r"))
    if wanted.limit(KNOWN + 1).count() <= KNOWN:
        r = F.broadcast(r.join(F.broadcast(wanted), "ref", "left_semi"))
    return pairs.join(queries.select("id", "v", "model"), "id").join(r, "ref").select("model", F.zip_with("v", "_r", lambda a, b: a - b).alias("x"))
