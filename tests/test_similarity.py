"""Similarity join: equal to plain full-matrix alignment, recall on mutated sequences, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqlake.operators import pairs, similarity
from seqlake.operators.similarity import Scoring


def plain(q: str, t: str, s: Scoring):
    """Affine-gap local alignment over the whole matrix, cell by cell, with the same order of choices."""
    table, low = s.table(), -(10**9)
    n, m = len(q), len(t)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e, f = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
    best = (0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            f[i][j] = max(h[i - 1][j] - s.open - s.extend, f[i - 1][j] - s.extend)
            e[i][j] = max(h[i][j - 1] - s.open - s.extend, e[i][j - 1] - s.extend)
            h[i][j] = max(0, h[i - 1][j - 1] + int(table[ord(q[i - 1]), ord(t[j - 1])]), f[i][j], e[i][j])
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    score, i, j = best
    if not score:
        return (0,) * 9
    out, state = [0, 0, 0, 0, 0, i, 0, j, score], "h"
    while True:
        if state == "h":
            if h[i][j] == 0:
                return tuple(out)
            if h[i][j] == h[i - 1][j - 1] + table[ord(q[i - 1]), ord(t[j - 1])]:
                out[1] += 1
                out[0 if q[i - 1] == t[j - 1] else 2] += 1
                out[4], out[6] = i, j
                i, j = i - 1, j - 1
                continue
            state = "f" if h[i][j] == f[i][j] else "e"
            out[3] += 1
        out[1] += 1
        if state == "f":
            state = "f" if f[i][j] > h[i - 1][j] - s.open - s.extend else "h"
            i -= 1
        else:
            state = "e" if e[i][j] > h[i][j - 1] - s.open - s.extend else "h"
            j -= 1


def mutate(rng, s, letters, share):
    out = []
    for c in s:
        x = rng.random()
        if x < share * 0.7:
            out.append(rng.choice(letters))
        elif x < share * 0.85:
            out.append(c + rng.choice(letters) * rng.randint(1, 3))
        elif x >= share:
            out.append(c)
    return "".join(out)


@pytest.mark.parametrize("scoring", [Scoring(), Scoring(5, -4, 10, 1, 20), Scoring(1, -1, 0, 1, 4), Scoring(3, -2, 4, 1, 4, matrix=(("A", "A", 6), ("A", "C", 1)))])
def test_bands_equal_the_whole_matrix(scoring):
    rng = random.Random(2)
    qs, ts = [], []
    for _ in range(120):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        b = mutate(rng, a, "ACGT", rng.choice([0.1, 0.4, 1.0])) or "A"
        qs.append(a)
        ts.append("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 10))) + b)
    got = similarity.align_band([x.encode() for x in qs], [x.encode() for x in ts], [-60] * len(qs), 200, scoring.table(), scoring.open, scoring.extend)
    for a, b, g in zip(qs, ts, got, strict=True):
        assert g == plain(a, b, scoring), (a, b)


def test_minimizers_are_the_least_of_some_window():
    rng = random.Random(4)
    for _ in range(60):
        s, k, w = "".join(rng.choice("AC") for _ in range(rng.randint(0, 30))).encode(), rng.randint(1, 5), rng.randint(1, 6)
        every = [tuple(sum(s[p + i] * c for i, c in enumerate(x)) % similarity.PRIME for x in similarity.seed_weights(k)) for p in range(len(s) - k + 1)]
        want = set()
        for p in range(max(1, len(every) - w + 1) if every else 0):
            own = every[p : p + w]
            want |= {p + i for i, x in enumerate(own) if x == min(own)}
        keys, at = similarity.minimizers(s, k, w)
        assert list(at) == sorted(want) and [int(x) for x in keys] == [(every[p][0] << 31) | every[p][1] for p in at]


def test_scale_solves_its_equation():
    for s in (Scoring(), Scoring(5, -4, 10, 1, 20)):
        assert abs(np.exp(s.scale * s.match) / s.letters + np.exp(s.scale * s.mismatch) * (1 - 1 / s.letters) - 1) < 1e-9


def _made(spark, rows):
    return spark.createDataFrame(rows, "id string, seq string").repartition(3)


def test_join_finds_mutated_sequences(spark):
    """Recall against plain alignment of every pair, at up to a sixth of the letters changed."""
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(120, 200))) for _ in range(12)]
    targets = [(f"t{i}", b) for i, b in enumerate(base)]
    queries = [(f"q{i}_{j}", mutate(rng, b[20 * j :], "ACGT", share)) for i, b in enumerate(base) for j, share in enumerate((0.03, 0.08, 0.16))]
    scoring = Scoring()
    got = {(r.qseqid, r.sseqid): r for r in similarity.similarity_join(_made(spark, queries), _made(spark, targets), 8, 4, 2, best_only=True).collect()}
    want = {(q, t): plain(a, b, scoring) for q, a in queries for t, b in targets}
    space = sum(len(b) for _, b in targets)
    good = {p: x for p, x in want.items() if scoring.k * len(dict(queries)[p[0]]) * space * np.exp(-scoring.scale * x[8]) <= 1e-3}
    assert len(good) >= 36 and len(good.keys() & got.keys()) >= 0.9 * len(good) and got.keys() <= good.keys()
    for p, r in got.items():
        m, length, mis, gaps, a, b, c, d, score = want[p]
        assert (r.length, r.mismatch, r.gapopen, r.qstart, r.qend, r.sstart, r.send, r.score) == (length, mis, gaps, a, b, c, d, score)
        q, t = dict(queries)[p[0]], dict(targets)[p[1]]
        assert abs(r.pident - 100 * m / length) < 1e-9 and abs(r.qcov - 100 * (b - a + 1) / len(q)) < 1e-9 and abs(r.scov - 100 * (d - c + 1) / len(t)) < 1e-9
        assert abs(r.bitscore - (scoring.scale * score - np.log(scoring.k)) / np.log(2)) < 1e-9


def test_join_on_odd_rows(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(100))
    rows = [("a", s), ("a", s), (None, s), ("b", s[:50]), ("n", None), ("e", ""), ("x", "ACG"), ("r", "AC" * 60)]
    got = similarity.similarity_join(_made(spark, rows), _made(spark, rows), best_only=True)
    n = {}
    for r in got.collect():
        n[r.qseqid, r.sseqid] = n.get((r.qseqid, r.sseqid), 0) + 1
    assert n["a", "a"] == 4 and n["a", None] == 2 and n["a", "b"] == 2 and n["b", "a"] == 2 and n["r", "r"] == 1 and not {k for k in n if {"n", "e", "x"} & set(k)}
    assert similarity.similarity_join(_made(spark, []), _made(spark, rows)).count() == 0 and similarity.similarity_join(_made(spark, rows), _made(spark, [])).count() == 0
    assert all(r.qseqid != r.sseqid for r in similarity.similarity_join(_made(spark, rows), _made(spark, rows), same=True).collect())


def test_alignments_feed_the_pair_table(spark):
    """Two passages far apart on one target are two alignments, and the pair table joins them."""
    rng = random.Random(6)
    a, b, gap = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (80, 90, 400))
    hits = similarity.similarity_join(_made(spark, [("q", a + b)]), _made(spark, [("t", a + gap + b)]))
    assert sorted((r.qstart, r.qend, r.sstart, r.send) for r in hits.collect()) == [(1, 80, 1, 80), (81, 170, 481, 570)]
    one = pairs.nucleotide_pairs(hits).first()
    assert (one.num_alns, one.pid, one.qcov, one.tcov) == (2, 100.0, 100.0, round(100 * 170 / 570, 2))


def test_tasks_hold_part_of_a_batch(monkeypatch):
    """However many rows a batch has, a task turns a bounded number of them into Python objects at once, with equal results."""
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(0, 90))).encode() for _ in range(700)]
    batch = pa.RecordBatch.from_pydict({"no": [str(i).encode() for i in range(700)], "seq": seqs})
    made = list(similarity._seeds(8, 4)(iter([batch])))
    want = [(str(i).encode(), key, at) for i, s in enumerate(seqs) for key, at in zip(*map(np.ndarray.tolist, similarity.minimizers(s, 8, 4)))]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want and len(made) == 3
    seen = []
    keep = similarity.align_band
    monkeypatch.setattr(similarity, "align_band", lambda q, *rest: seen.append(len(q)) or keep(q, *rest))
    rows = pa.RecordBatch.from_pydict({"k": list(range(5000)), "qseq": [b"ACGTTGCAAC"] * 5000, "sseq": [b"ACGTTGC" + b"A" * (i % 5) for i in range(5000)], "band": [0] * 5000})
    found = list(similarity._aligner(4, 2, similarity.Scoring())(iter([rows])))
    assert max(seen) <= 2048 and [x for b in found for x in b.column("k").to_pylist()] == list(range(5000))
    assert {(i % 5, s) for i, s in enumerate(x for b in found for x in b.column("score").to_pylist())} == {(0, 14), (1, 16), (2, 18), (3, 18), (4, 18)}
