"""Gene caller: dynamic programming against every subset, plain scores, planted genes, odd rows."""

import itertools
import math
import random

import numpy as np

from seqlake import sources
from seqlake.operators import genes


def _best_of_all(starts, ends, scores, overlap):
    best = (0.0, ())
    for n in range(len(starts) + 1):
        for own in itertools.combinations(range(len(starts)), n):
            order = sorted(own, key=lambda i: (ends[i], starts[i]))
            if all(ends[x] - starts[y] <= overlap for x, y in itertools.combinations(order, 2)):
                best = max(best, (sum(scores[i] for i in own), ()))
    return best[0]


def test_chain_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(0, 9)
        starts = [rng.randint(0, 60) for _ in range(n)]
        ends = [a + rng.randint(9, 30) for a in starts]
        scores = [rng.choice([-1.0, 0.0, 1.0, 2.0, 3.5, rng.random() * 4]) for _ in range(n)]
        overlap = rng.randint(0, 4)
        got = genes.best_chain(np.array(starts, int), np.array(ends, int), np.array(scores, float), overlap)
        assert abs(sum(scores[i] for i in got) - _best_of_all(starts, ends, scores, overlap)) < 1e-9
        assert all(ends[x] - starts[y] <= overlap for x, y in zip(got, got[1:]))


def _plain_candidates(seq, least, w, prior):
    """(first letter, end, score) on the strand of every gene that could be, letter by letter."""
    out, n = [], len(seq)
    for a in range(n - 2):
        edge = a < 3 and seq[a : a + 3] not in genes.STARTS
        if seq[a : a + 3] not in genes.STARTS and not edge:
            continue
        e, closed = a, False
        while e + 3 <= n and not closed:
            closed = seq[e : e + 3] in genes.STOPS
            e += 3
        if e - a < least:
            continue
        score = prior
        for i in range(a, e - (9 if closed else 6) + 1, 3):
            if set(seq[i : i + 6]) <= set("ACGT"):
                score += w[sum("ACGT".index(x) * 4 ** (5 - k) for k, x in enumerate(seq[i : i + 6]))]
        if not edge:
            score += w[4096 + genes.STARTS.index(seq[a : a + 3])]
            for k in range(genes.UPSTREAM):
                if a - 1 - k >= 0 and seq[a - 1 - k] in "ACGT":
                    score += w[4099 + 4 * k + "ACGT".index(seq[a - 1 - k])]
        out.append((a, e, round(float(score), 3)))
    return sorted(out)


def test_candidates_and_scores_are_those_of_a_plain_walk():
    rng = random.Random(5)
    w = np.array([rng.uniform(-1, 1) for _ in range(4099 + 4 * genes.UPSTREAM)], np.float32)
    for _ in range(60):
        seq = "".join(rng.choice("ACGTTAGN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randint(0, 150)))
        x = genes.strand_codes(seq.encode(), 1)
        c = genes.codons(x)
        f = genes.open_frames(c, 9)
        s = genes.score_frames(x, c, f, w, -0.5)
        got = sorted((int(a), int(e), round(float(v), 3)) for a, e, v in zip(f.start, f.end, s))
        want = _plain_candidates(seq, 9, w, -0.5)
        assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(x[2] - y[2]) < 3e-3 for x, y in zip(got, want))


def test_weights_are_log_odds():
    n = np.arange(genes._AT[-1])
    w = genes.weights(n)
    part = lambda k: n[genes._AT[k] : genes._AT[k + 1]]
    odds = lambda a, b, i: math.log((a[i] + 1) / (a + 1).sum()) - math.log((b[i] + 1) / (b + 1).sum())
    assert abs(w[7] - odds(part(0), part(1), 7)) < 1e-5 and abs(w[4097] - odds(part(2), part(3), 1)) < 1e-5
    assert abs(w[4099 + 4 * 2 + 3] - odds(part(4)[8:12], part(5), 3)) < 1e-5


def _genome(rng, n_genes):
    """A genome with genes of skewed codons on either strand, and where they are: (start, end, strand), places from 1."""
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    liked = ["GCT", "CTT", "GAA", "AAA", "GGT", "ACT", "ATT", "GTT", "AGA", "GAT", "AAT", "TCA", "CTA"]
    seq, at = "", []
    for _ in range(n_genes):
        seq += "".join(rng.choice("ACGT") for _ in range(rng.randint(60, 150)))
        gene = "ATG" + "".join(rng.choice(liked) if rng.random() < 0.85 else rng.choice(["TTT", "CAC", "AGC", "CCA", "TGG"]) for _ in range(rng.randint(110, 260))) + rng.choice(genes.STOPS)
        strand, before = rng.choice([1, -1]), "AGGAGGTAACAA"
        at.append((len(seq) + 1 + 12 * (strand > 0), len(seq) + len(gene) + 12 * (strand > 0), strand))
        seq += before + gene if strand > 0 else flip(before + gene)
    return seq + "".join(rng.choice("ACGT") for _ in range(100)), at


def test_planted_genes_are_found(spark):
    rng = random.Random(11)
    made = {f"c{k}": _genome(rng, 12) for k in range(6)}
    rows = spark.createDataFrame([(n, s, "g") for n, (s, _) in made.items()], "accession string, seq string, genome string").repartition(3)
    got = {}
    for r in genes.call_genes(rows, group="genome").collect():
        got.setdefault(r.accession, []).append(r)
    stop_of = lambda a, b, s: (b if s > 0 else a, s)
    planted = {(n, *stop_of(*g)) for n, (_, own) in made.items() for g in own}
    found = {(n, *stop_of(r.start, r.end, r.strand)) for n, own in got.items() for r in own}
    assert len(planted & found) >= 0.95 * len(planted) and len(planted & found) >= 0.7 * len(found)
    exact = {(n, *g) for n, (_, own) in made.items() for g in own} & {(n, r.start, r.end, r.strand) for n, own in got.items() for r in own}
    assert len(exact) >= 0.8 * len(planted)
    for n, own in got.items():
        own.sort(key=lambda r: int(r.orf_id.rsplit("_", 1)[1]))
        assert [r.orf_id for r in own] == [f"{n}_{k + 1}" for k in range(len(own))] and [r.start for r in own] == sorted(r.start for r in own)
        for r in own:
            assert (r.end - r.start + 1) % 3 == 0 and "*" not in r.protein[:-1] and (r.protein[0] == "M" or r.partial_left or r.partial_right)


def test_genes_of_odd_rows(spark):
    rng = random.Random(2)
    seq, _ = _genome(rng, 4)
    rows = [("a", seq, "x"), ("a", seq, "x"), ("n", None, "x"), ("e", "", None), ("s", "AC", None), (None, seq.lower(), None), ("N", "N" * 500, "x"), ("long", seq * 10, "y")]
    df = spark.createDataFrame(rows, "accession string, seq string, grp string").repartition(3)
    got = genes.call_genes(df).collect()
    by = lambda n: sorted((r.start, r.end) for r in got if r.accession == n)
    assert by("a") and len(by("a")) == 2 * len(set(by("a"))) and not by("n") and not by("e") and not by("s")
    assert all(set(r.protein) == {"X"} for r in got if r.accession == "N")
    assert genes.call_genes(df.limit(0)).count() == 0
    assert genes.call_genes(df, group="grp").where("accession = 'a'").count() > 0
    assert [(r.start, r.end) for r in got if r.accession is None]


def test_models_joined_beyond_the_bound(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(f"c{k}", _genome(rng, 2)[0], f"g{k}") for k in range(4)], "accession string, seq string, genome string")
    want = sorted(tuple(r) for r in genes.call_genes(df, group="genome").collect())
    monkeypatch.setattr(genes, "MODELS", 2)
    assert sorted(tuple(r) for r in genes.call_genes(df, group="genome").collect()) == want


def test_translated_genomes_and_proteins_of_users(spark, tmp_path):
    rng = random.Random(4)
    made = [(f"m{k % 2}", f"c{k}", _genome(rng, 5)[0]) for k in range(4)]
    at = str(tmp_path / "mags")
    (tmp_path / "mags").mkdir()
    for mag in ("m0", "m1"):
        (tmp_path / "mags" / f"{mag}.fa").write_text("".join(f">{a}\n{s}\n" for m, a, s in made if m == mag))
    df = spark.createDataFrame(made, "mag string, accession string, seq string")
    want = sorted((r.mag, r.orf_id, r.start, r.end, r.protein) for r in genes.call_genes(df, group="mag").join(df.select("mag", "accession"), "accession").collect())
    assert sorted((r.mag, r.orf_id, r.start, r.end, r.protein) for r in sources.translated_genomes(spark, at).collect()) == want
    contigs = df.select("accession", "seq")
    called = sources.proteins_or_genes(spark, None, contigs)
    assert called.count() == genes.call_genes(contigs).count() and called.columns == ["orf_id", "start", "end", "strand"]
    own = tmp_path / "own.faa"
    own.write_text(">c1_1 # 3 # 92 # 1 # ID=1;gc_cont=0.5\nMK\n>other_1 # 3 # 92 # 1 # ID=1;gc_cont=0.5\nMK\n")
    assert [tuple(r) for r in sources.proteins_or_genes(spark, str(own), contigs).collect()] == [("c1_1", 3, 92, 1)]
    own.write_text(">other_1 # 3 # 92 # 1 # ID=1;gc_cont=0.5\nMK\n")
    assert sources.proteins_or_genes(spark, str(own), contigs).count() == called.count()


def test_open_frames_as_a_table_function(spark):
    from seqlake.functions import tables

    tables.register(spark)
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 400))) for _ in range(20)] + [None, "", "ATGAAATAA"]
    spark.createDataFrame(list(enumerate(seqs)), "id int, seq string").createOrReplaceTempView("some_contigs")
    got = {}
    for r in spark.sql("SELECT id, f.* FROM some_contigs, LATERAL open_frames(seq, 30) f").collect():
        got.setdefault(r.id, set()).add((r.start, r.end, r.strand, r.partial_left, r.partial_right))
    flip = str.maketrans("ACGT", "TGCA")
    for i, s in enumerate(seqs):
        want, n = set(), len(s or "")
        for strand, x in ((1, s or ""), (-1, (s or "")[::-1].translate(flip))):
            for frame in range(3):
                at, begin = frame, frame
                start = None
                while at + 3 <= n:
                    c = x[at : at + 3]
                    if start is None and (c in genes.STARTS or begin == frame == at):
                        start = (at, c not in genes.STARTS)
                    stop = c in genes.STOPS
                    if stop or at + 6 > n:
                        if start and at + 3 - start[0] >= 30 and not (stop and begin == frame == at):
                            a, e = start[0], at + 3
                            lo, hi = (a + 1, e) if strand > 0 else (n - e + 1, n - a)
                            edges = (start[1], not stop)
                            want.add((lo, hi, strand, *(edges if strand > 0 else edges[::-1])))
                        start, begin = None, at + 3
                    at += 3
        assert got.get(i, set()) == want, i


def _plain_count(seq: bytes, train: int, overlap: int, into: np.ndarray, w=None, prior: float = 0.0) -> None:
    """Add one contig's counts. Without weights its longest whole open frames of at least `train` letters stand for its
    genes; with weights, the best whole genes by score do."""
    n, every = len(seq), []
    for strand in (1, -1):
        x = genes.strand_codes(seq, strand)
        c = genes.codons(x)
        words = genes._words(c)
        into[genes._AT[1] : genes._AT[2]] += np.bincount(words[words >= 0], minlength=4096)
        for k, s in enumerate(genes._START):
            into[genes._AT[3] + k] += int((c == s).sum())
        into[genes._AT[5] : genes._AT[6]] += np.bincount(x[x < 4], minlength=4)
        f = genes.open_frames(c, train)
        value = f.end - f.start if w is None else genes.score_frames(x, c, f, w, prior)
        for i in np.flatnonzero(f.closed & (f.kind < 3)).tolist():
            a, e = int(f.start[i]), int(f.end[i])
            every.append((a, e, a if strand > 0 else n - e, e if strand > 0 else n - a, int(f.kind[i]), x, words, float(value[i])))
    if not every:
        return
    starts, ends, value = (np.array([r[k] for r in every]) for k in (2, 3, 7))
    for i in genes.best_chain(starts, ends, value, overlap):
        a, e, _, _, kind, x, words, _ = every[i]
        own = words[a : e - 8 : 3]
        into[genes._AT[0] : genes._AT[1]] += np.bincount(own[own >= 0], minlength=4096)
        into[genes._AT[2] + kind] += 1
        for k in range(genes.UPSTREAM):
            if a - 1 - k >= 0 and x[a - 1 - k] < 4:
                into[genes._AT[4] + 4 * k + x[a - 1 - k]] += 1


def _plain_call(seq: bytes, w: np.ndarray, least: int, overlap: int, prior: float) -> list[tuple]:
    """(start, end, strand, partial at the left, partial at the right, score, protein) of one contig's genes, by place from 1."""
    n, rows = len(seq), []
    for strand in (1, -1):
        x = genes.strand_codes(seq, strand)
        c = genes.codons(x)
        f = genes.open_frames(c, least)
        for a, e, kind, closed, s in zip(f.start.tolist(), f.end.tolist(), f.kind.tolist(), f.closed.tolist(), genes.score_frames(x, c, f, w, prior).tolist(), strict=True):
            rows.append((a if strand > 0 else n - e, e if strand > 0 else n - a, strand, kind == 3, not closed, s, a, e))
    if not rows:
        return []
    found = genes.best_chain(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[5] for r in rows]), overlap)
    both = {s: genes.codons(genes.strand_codes(seq, s)) for s in (1, -1)}
    out = []
    for i in sorted(found, key=lambda i: rows[i][:3]):
        lo, hi, strand, no_start, no_stop, s, a, e = rows[i]
        own = both[strand][a : e - 2 : 3].tolist()
        protein = "".join("X" if c < 0 else genes.AMINO[c] for c in own)
        if not no_start:
            protein = "M" + protein[1:]
        left, right = (no_start, no_stop) if strand > 0 else (no_stop, no_start)
        out.append((lo + 1, hi, strand, left, right, s, protein))
    return out


def test_batches_equal_contigs_one_by_one():
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGTacgt") for _ in range(n)).encode() for n in [*range(1, 13), 0, 700, 90, *(rng.randint(20, 900) for _ in range(60)), 5, 4]]
    groups = np.array([rng.randrange(3) for _ in seqs])
    models = np.array([[rng.uniform(-1, 1.2) for _ in range(4099 + 4 * genes.UPSTREAM)] for _ in range(3)], np.float32)
    for w in (None, models):
        want = np.zeros((3, genes._AT[-1]), np.int64)
        for g, x in zip(groups, seqs):
            _plain_count(x, 60, 20, want[g], None if w is None else w[g], -0.5)
        assert want[:, : genes._AT[1]].sum() > 0 and (genes.count_batch(seqs, groups, 3, 60, 20, w, groups, -0.5) == want).all()
    f, strand, proteins = genes.call_batch(seqs, models, groups, 50, 20, -0.5)
    got = list(zip(f.contig.tolist(), strand.tolist(), f.start.tolist(), f.end.tolist(), f.kind.tolist(), f.closed.tolist(), f.score.tolist(), proteins))
    want = [(i, *r) for i, (g, x) in enumerate(zip(groups, seqs)) for r in _plain_call(x, models[g], 50, 20, -0.5)]
    assert len(got) == len(want) > 50
    for (i, s, a, e, kind, closed, score, protein), (j, lo, hi, strand_, left, right, v, p) in zip(got, want):
        n = len(seqs[i])
        assert (i, s, protein) == (j, strand_, p) and abs(score - v) < 1e-9 and (lo, hi) == ((a + 1, e) if s > 0 else (n - e + 1, n - a))
        assert (left, right) == ((kind == 3, not closed) if s > 0 else (not closed, kind == 3))
