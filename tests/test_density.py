"""Fitted densities against plain numpy, and the block-wise search against all pairs."""

import math
import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import density, evidence, kmers
from seqlake.plans import tasks


def _plain_log_density(x, weights, means, variances):
    total = 0.0
    for w, m, v in zip(weights, means, variances):
        one = w
        for a, b, c in zip(x, m, v):
            one *= math.exp(-0.5 * (a - b) ** 2 / c) / math.sqrt(2 * math.pi * c)
        total += one
    return math.log(total)


def _made(rng, n, d, centres):
    return np.array([[rng.gauss(c, 0.5) for c in centres[k % len(centres)][:d]] for k in range(n)]).round(6)


def test_mixture_density_is_its_definition():
    rng = np.random.default_rng(1)
    m = density.Mixture(np.array([0.3, 0.7]), rng.normal(size=(2, 3)), rng.uniform(0.2, 1, (2, 3)))
    q, r = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    between = m.between(q, r)
    for i in range(5):
        for j in range(4):
            want = _plain_log_density(q[i] - r[j], m.weights, m.means, m.variances)
            assert abs(between[i, j] - want) < 1e-9 and abs(m(q[i : i + 1] - r[j])[0] - want) < 1e-9
    assert abs(density.gaussian(0.5)(np.array([[0.5, 0.0]]))[0] - _plain_log_density([0.5, 0.0], [1], [[0, 0]], [[0.25, 0.25]])) < 1e-12


def test_fit_is_plain_expectation_maximisation(spark):
    rng = random.Random(3)
    data = {1: _made(rng, 80, 3, [(0, 0, 0), (4, 4, 4)]), 4: _made(rng, 31, 3, [(1, -1, 0)])}
    rows = [(k, x.tolist()) for k, xs in data.items() for x in xs] + [(None, [0.0] * 3), (1, None)]
    df = spark.createDataFrame(rows, "model int, x array<double>").repartition(4)
    got = density.fit_mixtures(df, components=2, rounds=6, gain=-1)
    order = {tuple(r.x): r.h for r in df.where("x is not null").selectExpr("x", "xxhash64(x) AS h").collect()}
    for k, xs in data.items():
        means = np.array(sorted(xs.tolist(), key=lambda x: (order[tuple(x)], x))[:2])
        weights, variances = np.full(2, 0.5), np.tile(xs.var(0), (2, 1))
        for _ in range(6):
            p = np.array([[w * math.exp(_plain_log_density(x, [1], [m], [v])) for w, m, v in zip(weights, means, variances)] for x in xs])
            r = p / p.sum(1, keepdims=True)
            mass = r.sum(0)
            weights, means = mass / len(xs), (r.T @ xs) / mass[:, None]
            variances = np.maximum((r.T @ xs**2) / mass[:, None] - means**2, 1e-6)
        for a, b in ((got[k].weights, weights), (got[k].means, means), (got[k].variances, variances)):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)
    assert abs(sorted(got[1].means[:, 0])[0]) < 0.5 and abs(sorted(got[1].means[:, 0])[1] - 4) < 0.5
    assert density.fit_mixtures(df.limit(0)) == {} and len(density.fit_mixtures(spark.createDataFrame([(2, [1.0])], "model int, x array<double>"), 3)[2].weights) == 1


@pytest.mark.parametrize("numbers", [12, 1 << 18])
def test_search_is_that_over_all_pairs(spark, numbers):
    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(40, 3)).round(3), rng.normal(size=(25, 3)).round(3)
    r[7] = r[3]  # a tie
    models = {1: density.Mixture(np.array([0.5, 0.5]), rng.normal(size=(2, 3)), rng.uniform(0.2, 1, (2, 3))), 2: density.gaussian(0.7), 3: lambda x: -np.abs(x).sum(1)}
    kind = [None if i % 9 == 0 else 9 if i % 9 == 1 else 1 + i % 3 for i in range(40)]
    qs = spark.createDataFrame([(f"x{i:02}", q[i].tolist(), kind[i]) for i in range(40)] + [(None, [0.0] * 3, 1), ("none", None, 1)], "id string, v array<double>, model int").repartition(3)
    rs = spark.createDataFrame([(f"x{i:02}", r[i].tolist()) for i in range(25)] + [("y", None), (None, [9.0] * 3)], "id string, v array<double>").repartition(3)
    for same in (False, True):
        with mock.patch.object(density, "NUMBERS", numbers):
            got = {x.id: (x.best, x.score) for x in density.best_reference(qs, rs, models, same).collect()}
        assert set(got) == {f"x{i:02}" for i in range(40) if kind[i] in models}
        for name, (best, score) in got.items():
            i = int(name[1:])
            every = [models[kind[i]](q[i : i + 1] - r[j])[0] if not (same and i == j) else -np.inf for j in range(25)]
            assert abs(score - max(every)) < 1e-6 and best == f"x{int(np.argmax(np.round(every, 9))):02}"
    assert density.best_reference(qs.limit(0), rs, models).count() == 0 and density.best_reference(qs, rs.limit(0), models).count() == 0


def test_hosts_by_five_length_models(spark):
    """Contigs of all five lengths find the host they were cut from, with densities fitted to other known pairs."""
    rng = random.Random(2)
    hosts = {f"h{k}": "".join(rng.choices("ACGT", [rng.uniform(0.5, 2) for _ in range(4)], k=40000)) for k in range(6)}
    cut = lambda h, n: hosts[h][(at := rng.randrange(40000 - n)) : at + n]
    lengths = [1500, 3000, 6000, 10000, 14000]
    train = [(f"t{h}_{i}", n, h, cut(h, n)) for h in hosts for i, n in enumerate(lengths)]
    test = [(f"v{h}_{i}", n, h, cut(h, n)) for h in hosts for i, n in enumerate(lengths)]
    table = lambda rows: spark.createDataFrame([(a, n, s) for a, n, _, s in rows], "accession string, length int, seq string")
    h = spark.createDataFrame(list(hosts.items()), "accession string, seq string")
    known = spark.createDataFrame([(a, x) for a, _, x, _ in train], "accession string, host string")
    own = table(train)
    q = kmers.profiles(own.selectExpr("accession AS id", "seq")).join(own.select(F.col("accession").alias("id"), kmers.length_model(F.col("length")).alias("model")), "id")
    refs = kmers.profiles(h.selectExpr("accession AS id", "seq"))
    fitted = kmers.fit_mixtures(kmers.pair_differences(known.selectExpr("accession AS id", "host AS ref"), q, refs))
    assert sorted(fitted) == [1, 2, 3, 4, 5]
    got = {r.accession: r.host for r in tasks.kmer_host(table(test), h, densities=fitted).collect()}
    assert sum(got[a] == x for a, _, x, _ in test) >= 0.9 * len(test)
    hits = spark.createDataFrame([(f"{test[0][0]}_1", test[0][2], 80.0)], "qseqid string, mag string, pident double")
    assert [(r.accession, r.host, r.score) for r in tasks.kmer_host(table(test), h, densities=fitted, protein_hits=hits).collect()] == [(test[0][0], test[0][2], 0.8)]


@pytest.mark.parametrize("tile", [30, 1 << 23])
def test_search_in_tiles_with_copies_and_odd_vectors(spark, tile):
    """One Gaussian, references in copies and close to each other, outliers, and vectors that are not finite."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 5)).round(2)
    r = np.concatenate([base[rng.integers(0, 6, 60)], base + rng.normal(size=(6, 5)) * 1e-7, rng.normal(size=(3, 5)) * 1e4])
    q = np.concatenate([base[rng.integers(0, 6, 8)], rng.normal(size=(4, 5)), r[-2:] + 1])
    rule = density.Mixture(np.ones(1), rng.normal(size=(1, 5)) * 0.1, rng.uniform(0.01, 1, (1, 5)))
    qs = spark.createDataFrame([(i, q[i].tolist(), 1) for i in range(len(q))] + [(900, [math.nan] * 5, 1)], "id long, v array<double>, model int").repartition(3)
    odd = [(901, [math.nan] * 5), (902, [math.inf] * 5), (0, r[0].tolist()), (0, r[0].tolist())]
    rs = spark.createDataFrame([(i, r[i].tolist()) for i in range(len(r))] + odd, "id long, v array<double>").repartition(3)
    for same in (False, True):
        with mock.patch.object(density, "NUMBERS", 40), mock.patch.object(density, "TILE", tile), mock.patch.object(density, "SPREAD", 2):
            got = {x.id: (x.best, x.score) for x in density.best_reference(qs, rs, {1: rule}, same).collect()}
        assert set(got) == set(range(len(q)))
        for i, (best, score) in got.items():
            every = np.round([rule(q[i : i + 1] - r[j])[0] if not (same and i == j) else -np.inf for j in range(len(r))], 7)
            assert best == int(every.argmax()) and abs(score - every.max()) < 1e-6


def test_references_are_sent_once_for_many_blocks_of_queries(spark):
    """Each reference goes to one group for each tile of queries, not to one for each of their blocks."""
    q = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(40)], "id long, v array<double>, model int").repartition(8)
    r = q.drop("model").repartition(2)
    real = density._best_of_tiles
    seen = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = real(*args)

        def best(left, right):
            seen.add(sum(len(x) for x in right["rids"]))
            return run(left, right)

        return best

    with mock.patch.object(density, "_best_of_tiles", counted):
        found = density.best_reference(q, r, {1: density.gaussian(1.0)}).collect()
    assert len(found) == 40 and all(x.id == x.best for x in found) and seen.value == 40


@pytest.mark.parametrize("same", [False, True])
def test_search_stores_small_rows_and_scores_references_in_chunks(spark, same):
    """No stored block is a row of megabytes, and no call gets a whole tile of references; copies of a vector lie in different chunks."""
    x = np.random.default_rng(6).normal(size=(1500, 64)).round(3)
    every = np.concatenate([x, x])
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "id long, v array<double>").repartition(2)
    queries = refs.where("id % 100 = 0").withColumn("model", F.lit(1))
    real, store, stored = density._best_of_tiles, density.materialize, []

    def bounded(*args):
        run = real(*args)

        def best(left, right):
            if sum(len(r) for r in right["rids"]) > 256:
                raise ValueError("too many references at once")
            return run(left, right)

        return best

    def kept(df, label):
        out = store(df, label)
        stored.append(out.agg(F.max(F.length("v"))).first()[0])
        return out

    with mock.patch.object(density, "CHUNK", 1 << 14, create=True), mock.patch.object(density, "SPREAD", 2), mock.patch.object(density, "_best_of_tiles", bounded), mock.patch.object(density, "materialize", kept):
        found = density.best_reference(queries, refs, {1: density.gaussian(0.5)}, same)
        assert len(stored) == 2 and max(stored) <= 1 << 14
        got = {r.id: r.best for r in found.collect()}
    assert got == {i: (i + 1500) % 3000 if same else i % 1500 for i in range(0, 3000, 100)}


def test_one_gaussian_is_fitted_in_one_pass(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    df = spark.createDataFrame([(2, v.tolist()) for v in x] + [(None, [0.0] * 3), (2, None)], "model int, x array<double>")
    with mock.patch.object(density, "materialize", side_effect=AssertionError):
        got = density.fit_mixtures(df)
    assert sorted(got) == [2] and np.allclose(got[2].means, x.mean(0)) and np.allclose(got[2].variances, x.var(0)) and got[2].weights.tolist() == [1.0]
    assert density.fit_mixtures(df.limit(0)) == {}


def test_mean_identity_does_not_depend_on_the_order(spark):
    rows = [("a", x) for x in (0.49, 0.88, 0.42, 0.87)] + [("b", x) for x in (0.42, 0.88, 0.49, 0.87)]
    got = set()
    for order in (rows, rows[::-1], sorted(rows, key=lambda x: x[1])):
        df = spark.createDataFrame([(p, f"m{k}", x) for k, (p, x) in enumerate(order)], "phage string, mag string, ident double").coalesce(1)
        got |= {r["mean"] for r in evidence.mean_identity(df.select("phage").distinct(), df).collect()}
    assert got == {2.66 / 4}
