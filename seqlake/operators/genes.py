"""Gene caller: open frames of both strands scored by a coding model of their group, chosen by dynamic programming.

The first pass over the contigs counts, for each group of them, six-letter words in frame within long open frames and
anywhere, start codons and the letters before them. A further pass scores every start of every open frame by these counts and
keeps, for each contig, the set of genes of the highest total, neighbours overlapping by a bounded number of letters; a pass
in between may count the genes so found instead of long frames.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.storage import materialize

# Letters by number, stop and start codons, amino acids of the 64 codons in the order of the letters ACGT.
LETTERS, STOPS, STARTS = "ACGT", ("TAA", "TAG", "TGA"), ("ATG", "GTG", "TTG")
AMINO = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
#: Letters before a start that its context looks at.
UPSTREAM = 18
#: Groups whose models (about 17 kB each) are broadcast; more are joined by a shuffle.
MODELS = 512
#: Groups whose counts a task holds before it hands them on.
HELD = 200
#: Letters that are searched at once, many contigs together.
LETTERS_AT_ONCE = 1 << 18
#: One in sums of word weights, which are whole numbers.
_UNIT = 2.0**40

_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_codon = lambda c: sum(LETTERS.index(x) * 4 ** (2 - i) for i, x in enumerate(c))
_STOP, _START = np.array([_codon(c) for c in STOPS]), np.array([_codon(c) for c in STARTS])
#: By codon, the last entry for unknown letters: whether it is a stop; which start it is, or -1.
_IS_STOP, _KIND = np.zeros(65, bool), np.full(65, -1)
_IS_STOP[_STOP], _KIND[_START] = True, np.arange(3)
_OTHER, _ACID = np.array([3, 2, 1, 0, 4], np.int8), np.frombuffer((AMINO + "X").encode(), np.uint8)
#: For words of 3 and of 6 letters, the number of each one's reverse complement.
_REVERSE = {k: sum((3 - np.arange(4**k) // 4**i % 4) * 4 ** (k - 1 - i) for i in range(k)) for k in (3, 6)}
#: Where each kind of count begins: words in frame, words anywhere, starts of genes, start codons anywhere, letters before starts, letters.
_AT = np.cumsum([0, 4096, 4096, 3, 3, 4 * UPSTREAM, 4])


@dataclass(frozen=True)
class Frames:
    """The open frames of one strand: for each candidate its first letter, its end (exclusive), its start codon (0, 1, 2;
    3: open at the contig's edge) and whether it ends with a stop."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    closed: np.ndarray


def strand_codes(seq: bytes, strand: int) -> np.ndarray:
    x = _CODE[np.frombuffer(seq, np.uint8)]
    return x if strand > 0 else np.where(x < 4, 3 - x, 4)[::-1]


def codons(x: np.ndarray) -> np.ndarray:
    """The number of the codon at each place; -1 where a letter is unknown."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    c = 16 * x[:-2] + 4 * x[1:-1] + x[2:]
    c[(x[:-2] > 3) | (x[1:-1] > 3) | (x[2:] > 3)] = -1
    return c


def open_frames(c: np.ndarray, least: int) -> Frames:
    """All starts of all stretches between stops that leave at least `least` letters, stop included."""
    stop, kind = _IS_STOP[c], _KIND[c]
    out = []
    for frame in range(3):
        at = np.arange(frame, len(c), 3)
        if not len(at):
            continue
        stops = at[stop[at]]
        last = at[-1] + 3  # the end of the last whole codon
        ends = np.append(stops + 3, last)
        closed = np.append(np.ones(len(stops), bool), False)
        starts = at[(kind[at] >= 0) & ~stop[at]]
        region = np.searchsorted(stops, starts)
        first = np.array([frame]) if not stop[frame] else np.zeros(0, np.int64)
        s = np.concatenate([first[kind[first] < 0], starts])  # an edge that is a start counts as one
        r = np.concatenate([np.zeros(len(s) - len(starts), np.int64), region])
        keep = ends[r] - s >= least
        out.append((s[keep], ends[r][keep], np.where(kind[s] < 0, 3, kind[s])[keep], closed[r][keep]))
    return Frames(*(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), (), ()))))


def best_chain(starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, overlap: int) -> list[int]:
    """Of intervals (first letter, end exclusive) the set of the highest total score whose neighbours share at most
    `overlap` letters, which must be less than half of any interval; the least places in order of (end, start) on ties."""
    use = np.flatnonzero(scores > 0)
    order = use[np.lexsort((use, starts[use], ends[use]))]
    end, total, back, top = ends[order].tolist(), [0.0], [], [-1]
    for k, i in enumerate(order.tolist()):
        before = bisect_right(end, int(starts[i]) + overlap, 0, k)
        back.append(top[before])
        own = float(scores[i]) + total[before]
        total.append(max(total[-1], own))
        top.append(k if own > total[-2] else top[-1])
    chosen, k = [], top[-1]
    while k >= 0:
        chosen.append(int(order[k]))
        k = back[k]
    return chosen[::-1]


def _words(c: np.ndarray) -> np.ndarray:
    """Numbers of the six-letter words at each place; -1 where a letter is unknown."""
    return np.where((c[:-3] < 0) | (c[3:] < 0), -1, c[:-3] * 64 + c[3:]) if len(c) > 3 else np.zeros(0, np.int64)


def weights(counts: np.ndarray) -> np.ndarray:
    """Log odds of coding against anywhere: words, start codons, letters before a start; add-one counts."""
    part = lambda k: counts[_AT[k] : _AT[k + 1]].astype(float)
    share = lambda n, axis=None: np.log((n + 1) / (n + 1).sum(axis, keepdims=axis is not None))
    before = share(part(4).reshape(UPSTREAM, 4), 1) - share(part(5))[None, :]
    return np.concatenate([share(part(0)) - share(part(1)), share(part(2)) - share(part(3)), before.ravel()]).astype(np.float32)


def score_frames(x: np.ndarray, c: np.ndarray, f: Frames, w: np.ndarray, prior: float) -> np.ndarray:
    """Score of each candidate: the words in frame before its stop, its start codon and what stands before it, and the prior."""
    words, n = _words(c), len(f.start)
    own = np.where(words >= 0, w[np.maximum(words, 0)], 0.0).astype(float)
    total = np.zeros(len(own) + 3)
    for frame in range(3):
        total[frame + 3 : len(own) + 3 : 3] = np.cumsum(own[frame::3])
    stop = np.where(f.closed, f.end - 3, f.end)  # the last letters of what codes
    last = np.maximum(stop - 3, f.start)  # one after the place of the last word
    score = total[np.minimum(last, len(total) - 1)] - total[f.start] if n else np.zeros(0)
    score = score + np.append(w[4096:4099], 0.0)[f.kind] + prior
    before = np.zeros((UPSTREAM, 5))
    before[:, :4] = w[4099:].reshape(UPSTREAM, 4)
    at = f.start[:, None] - 1 - np.arange(UPSTREAM)
    letter = np.where((at >= 0) & (f.kind < 3)[:, None], x[np.maximum(at, 0)], 4) if n else np.zeros((0, UPSTREAM), np.int64)
    score += before[np.arange(UPSTREAM), letter].sum(1)
    return score


class Batch:
    """Many contigs in one array of letters, each from a multiple of three and followed by three unknown letters or more, so
    that places count frames for all of them and no word runs over."""

    def __init__(self, seqs: list[bytes]):
        self.size = np.array([len(x) for x in seqs], np.int64)
        room = (self.size + 5) // 3 * 3
        self.at = np.cumsum(room) - room
        self.owner = np.repeat(np.arange(len(seqs), dtype=np.int32), room // 3)  # of each three letters
        self.x = _CODE[np.frombuffer(b"".join(x.ljust(n) for x, n in zip(seqs, room.tolist(), strict=True)), np.uint8)].astype(np.int8)

        place, room = np.arange(len(self.x)), np.diff(np.append(self.at, len(self.x)))
        back = np.repeat(2 * self.at + self.size - 1, room) - place
        self.strands = {1: self.x, -1: np.where(back >= np.repeat(self.at, room), _OTHER[self.x[np.maximum(back, 0)]], np.int8(4))}


@dataclass(frozen=True)
class Found:
    """Candidates of one strand of a batch: contig, first letter and end on the strand, kind, whether closed, score."""

    contig: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    closed: np.ndarray
    score: np.ndarray


def _codons(x: np.ndarray) -> np.ndarray:
    c = np.full(len(x), -1, np.int16)
    c[:-2] = np.where((x[:-2] > 3) | (x[1:-1] > 3) | (x[2:] > 3), -1, 16 * x[:-2].astype(np.int16) + 4 * x[1:-1] + x[2:])
    return c


def find(b: Batch, x: np.ndarray, c: np.ndarray, least: int, models: np.ndarray | None, model: np.ndarray | None, prior: float) -> Found:
    """Every start of every open frame of at least `least` letters, as open_frames() and score_frames() have them contig by
    contig; scored by its contig's row of models, or by its length without models. Words are added up as whole numbers, so a
    score doesn't depend on the batch."""
    if models is not None:
        whole = np.zeros((len(models), 4097), np.int64)
        whole[:, :4096] = np.rint(models[:, :4096].astype(float) * _UNIT)
        base = (model * 4097)[b.owner]
    parts = []
    for frame in range(3):
        cf = c[frame::3]
        stop, kind = _IS_STOP[cf], _KIND[cf]
        many = np.maximum((b.size - frame) // 3, 0)  # whole codons
        has = many > 0
        bound = stop.copy()
        bound[(b.at // 3 + many)[has]] = True
        bounds = np.flatnonzero(bound)
        ends = 3 * (bounds + stop[bounds])
        first = (b.at // 3)[has]
        first = first[~stop[first] & (kind[first] < 0)]  # an edge that is a start counts as one
        start = np.concatenate([first, np.flatnonzero(kind >= 0)])
        region = np.searchsorted(bounds, start)
        keep = ends[region] - 3 * start >= least
        start, region = start[keep], region[keep]
        end, closed = ends[region], stop[bounds[region]]
        k = np.where(kind[start] < 0, 3, kind[start])
        if models is None:
            value = (end - 3 * start).astype(float)
        else:
            word = np.full(len(cf), 4096, np.int64)
            word[:-1] = np.where((cf[:-1] < 0) | (cf[1:] < 0), 4096, 64 * cf[:-1].astype(np.int64) + cf[1:])
            total = np.zeros(len(cf) + 1, np.int64)
            np.cumsum(whole.ravel()[base + word], out=total[1:])
            last = np.maximum(end // 3 - closed - 1, start)
            value = (total[last] - total[start]) / _UNIT
        parts.append((b.owner[start], 3 * start + frame, end + frame, k, closed, value))
    contig, start, end, kind, closed, score = (np.concatenate(y) for y in zip(*parts, strict=True))
    if models is not None:
        own = model[contig]
        score = score + np.concatenate([models[:, 4096:4099], np.zeros((len(models), 1), np.float32)], axis=1)[own, kind] + prior
        before = np.zeros((len(models), UPSTREAM, 5))
        before[:, :, :4] = models[:, 4099:].reshape(len(models), UPSTREAM, 4)
        at = start[:, None] - 1 - np.arange(UPSTREAM)
        letter = np.where((at >= b.at[contig][:, None]) & (kind < 3)[:, None], x[np.maximum(at, 0)], 4)
        score += before[own[:, None], np.arange(UPSTREAM), letter].sum(1)
    return Found(contig, start - b.at[contig], end - b.at[contig], kind, closed, score)


def _chains(b: Batch, both: list[Found], whole: bool, overlap: int) -> tuple[Found, np.ndarray]:
    """The best chain of each contig, by contig and place, and the strand of each gene; `whole`: of genes with start and stop."""
    strand = np.repeat([1, -1], [len(f.contig) for f in both])
    f = Found(*(np.concatenate([getattr(y, n) for y in both]) for n in ("contig", "start", "end", "kind", "closed", "score")))
    size = b.size[f.contig]
    low, high = np.where(strand > 0, f.start, size - f.end), np.where(strand > 0, f.end, size - f.start)
    order = np.lexsort((-strand, low, high, f.contig))
    order = order[(f.score > 0)[order] & ((f.closed & (f.kind < 3))[order] | (not whole))]
    edge = np.searchsorted(f.contig[order], np.arange(len(b.size) + 1))
    chosen = []
    for i in np.flatnonzero(np.diff(edge)).tolist():
        own = order[edge[i] : edge[i + 1]]
        chosen.append(own[best_chain(low[own], high[own], f.score[own], overlap)])
    at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    at = at[np.lexsort((strand[at], high[at], low[at], f.contig[at]))]
    return Found(f.contig[at], f.start[at], f.end[at], f.kind[at], f.closed[at], f.score[at]), strand[at]


def count_batch(seqs: list[bytes], groups: np.ndarray, n_groups: int, train: int, overlap: int, models: np.ndarray | None = None, model: np.ndarray | None = None, prior: float = 0.0) -> np.ndarray:
    """Counts of contigs by group. Without models each contig's longest whole open frames of at least `train` letters stand for
    its genes; with models, the best whole genes by score do."""
    into, b = np.zeros((n_groups, _AT[-1]), np.int64), Batch(seqs)
    coded = {s: _codons(x) for s, x in b.strands.items()}
    found, strand = _chains(b, [find(b, b.strands[s], c, train, models, model, prior) for s, c in coded.items()], True, overlap)
    of = np.repeat(groups[b.owner], 3)

    def sums(group: np.ndarray, value: np.ndarray, wide: int) -> np.ndarray:
        return np.bincount(group * wide + value, minlength=n_groups * wide).reshape(n_groups, wide)

    def add(part: int, n: np.ndarray) -> None:
        into[:, _AT[part] : _AT[part + 1]] += n

    # of one strand; on the other each word is its reverse complement
    c = coded[1]
    k = np.flatnonzero((c[:-3] >= 0) & (c[3:] >= 0))
    n = sums(of[k], 64 * c[k].astype(np.int64) + c[k + 3], 4096)
    add(1, n + n[:, _REVERSE[6]])
    k = np.flatnonzero(c >= 0)
    n = sums(of[k], c[k], 64)
    add(3, n[:, _START] + n[:, _REVERSE[3][_START]])
    k = np.flatnonzero(b.x < 4)
    n = sums(of[k], b.x[k], 4)
    add(5, n + n[:, ::-1])
    for s, c in coded.items():
        own = np.flatnonzero(strand == s)
        g, begin = groups[found.contig[own]], b.at[found.contig[own]] + found.start[own]
        words = np.maximum(0, (found.end[own] - found.start[own]) // 3 - 2)  # before the stop
        place = np.repeat(begin - 3 * (np.cumsum(words) - words), words) + 3 * np.arange(words.sum())
        left, right = c[place].astype(np.int64), c[place + 3]
        good = (left >= 0) & (right >= 0)
        add(0, sums(np.repeat(g, words)[good], (64 * left + right)[good], 4096))
        add(2, sums(g, found.kind[own], 3))
        at = begin[:, None] - 1 - np.arange(UPSTREAM)
        letter = np.where(at >= (begin - found.start[own])[:, None], b.strands[s][np.maximum(at, 0)], 4)
        i, k = np.nonzero(letter < 4)
        add(4, sums(g[i], 4 * k + letter[i, k], 4 * UPSTREAM))
    return into


def call_batch(seqs: list[bytes], models: np.ndarray, model: np.ndarray, least: int, overlap: int, prior: float) -> tuple[Found, np.ndarray, list[str]]:
    """Genes of contigs by contig and place, their strands and proteins; model: the row of models of each contig."""
    b = Batch(seqs)
    coded = {s: _codons(x) for s, x in b.strands.items()}
    f, strand = _chains(b, [find(b, b.strands[s], c, least, models, model, prior) for s, c in coded.items()], False, overlap)
    proteins = []
    for s, a, n, kind in zip(strand.tolist(), (b.at[f.contig] + f.start).tolist(), (f.end - f.start).tolist(), f.kind.tolist(), strict=True):
        p = _ACID[coded[s][a : a + n - 2 : 3]].tobytes().decode()
        proteins.append(p if kind == 3 else "M" + p[1:])
    return f, strand, proteins


def _slices(seqs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of contigs of about LETTERS_AT_ONCE letters; a longer contig is a run of its own."""
    at, size = 0, 0
    for k, x in enumerate(seqs):
        if size and size + len(x) > LETTERS_AT_ONCE:
            yield at, k
            at, size = k, 0
        size += len(x)
    if at < len(seqs):
        yield at, len(seqs)


def _models(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The different weights of a batch's rows, and which each row has."""
    w = b.column("weights").dictionary_encode()
    return np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in w.dictionary]), w.indices.to_numpy()


def _count(train: int, overlap: int, prior: float, kind: pa.DataType):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), kind), pa.array(at.astype(np.int32)), pa.array(n[at])], ["grp", "code", "n"])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            rows, models, model = b.column("seq").to_pylist(), None, None
            if "weights" in b.schema.names:
                models, model = _models(b)
            names = b.column("grp").to_pylist()
            for i, j in _slices(rows):
                code: dict = {}
                groups = np.array([code.setdefault(g, len(code)) for g in names[i:j]])
                for g, n in zip(code, count_batch(rows[i:j], groups, len(code), train, overlap, models, model[i:j] if models is not None else None, prior), strict=True):
                    held[g] = held[g] + n if g in held else n.copy()
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return count


def _model(rows: pa.Table) -> pa.Table:
    counts = np.zeros(_AT[-1], np.int64)
    counts[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return pa.table({"grp": rows["grp"].slice(0, 1), "weights": pa.array([weights(counts).tobytes()], pa.binary())})


def _call(least: int, overlap: int, prior: float):
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("weights")))
            if not b.num_rows:
                continue
            names, rows, (models, model) = b.column("accession"), b.column("seq").to_pylist(), _models(b)
            for i, j in _slices(rows):
                f, strand, proteins = call_batch(rows[i:j], models, model[i:j], least, overlap, prior)
                if not proteins:
                    continue
                who = names.take(pa.array(i + f.contig))
                first = np.searchsorted(f.contig, f.contig)
                size = np.array([len(x) for x in rows[i:j]])[f.contig]
                low, high = np.where(strand > 0, f.start, size - f.end), np.where(strand > 0, f.end, size - f.start)
                no_start, no_stop = f.kind == 3, ~f.closed
                ids = pa.array([f"{n}_{k}" for n, k in zip(who.to_pylist(), (np.arange(len(first)) - first + 1).tolist(), strict=True)], pa.string())
                left, right = np.where(strand > 0, no_start, no_stop), np.where(strand > 0, no_stop, no_start)
                whole = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, who.cast(pa.string()), whole(low + 1), whole(high), whole(strand), pa.array(left), pa.array(right), pa.array(f.score), pa.array(proteins, pa.string())], ["orf_id", "accession", "start", "end", "strand", "partial_left", "partial_right", "score", "protein"])

    return call


def gc_percent(contigs: DataFrame) -> DataFrame:
    """Contigs with their share of G and C, in whole percent, as group: at most 101 groups, as contigs of one kind are alike in it."""
    of = lambda letters: F.length("seq") - F.length(F.translate("seq", letters, ""))
    gc, at = of("GCgc"), of("ATat")
    return contigs.withColumn("grp", F.coalesce(F.floor(100 * F.try_divide(gc.cast("double"), gc + at)), F.lit(0)).cast("int"))


def call_genes(contigs: DataFrame, group: str | None = None, least: int = 90, train: int = 300, overlap: int = 40, prior: float = -2.0, rounds: int = 1) -> DataFrame:
    """(orf_id, accession, start, end, strand, partial_left, partial_right, score, protein) of contigs (accession, seq).

    `group` names the column whose contigs share a model (a genome, for one); without it, contigs of equal GC percent do.
    Models come from open frames of at least `train` letters and then, `rounds` times, from the genes that the model
    before finds among them; genes have at least `least` letters. A gene may run over a contig's edge. Places are from 1, both ends included; ids count the genes of a contig by place; the protein includes `*` for
    its stop. Null and empty contigs have no genes; unknown letters break no frame and score nothing. Contigs of a null
    group share one. Repeated rows are called each. Other columns are not read.
    """
    if not 0 <= 2 * overlap < least:
        raise ValueError("overlap must be less than half of the least length")
    named = gc_percent(contigs) if group is None else contigs.withColumn("grp", F.col(group))
    own = materialize(named.where("length(seq) > 0").select("accession", "grp", F.col("seq").cast("binary").alias("seq")), "gene-contigs")
    from pyspark.sql.pandas.types import to_arrow_type

    kind, ddl = to_arrow_type(own.schema["grp"].dataType), own.schema["grp"].dataType.simpleString()
    few = own.select("grp").distinct().limit(MODELS + 1).count() <= MODELS
    scored = own
    for _ in range(rounds + 1):
        counts = scored.drop("accession").mapInArrow(_count(train, overlap, prior, kind), f"grp {ddl}, code int, n long").groupBy("grp", "code").agg(F.sum("n").alias("n"))
        models = materialize(counts.groupBy("grp").applyInArrow(_model, f"grp {ddl}, weights binary"), "gene-models").withColumnRenamed("grp", "of")
        scored = own.join(F.broadcast(models) if few else models, F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    return scored.drop("grp").mapInArrow(_call(least, overlap, prior), "orf_id string, accession string, start int, end int, strand int, partial_left boolean, partial_right boolean, score double, protein string")
