"""Cluster profiles, shared items and their tail probabilities against brute force."""

import itertools
import math
import random
from unittest import mock

import numpy as np
import pytest

from seqlake.operators import kmers, network


@pytest.mark.parametrize("least,block", [(1, 1000), (3, 1000), (3, 2), (5, 3)])
def test_shared_items_are_all_pairs_in_common(spark, least, block):
    rng = random.Random(7)
    common = ["everywhere", "often", "much"]  # items of nearly all sets
    rows = [(i, x) for i in range(60) for x in common + [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))] if rng.random() < 0.9]
    rows += [(i, f"copy{k}") for i in range(100, 106) for k in range(8)] + [(None, "often"), (3, None), (200, "alone")] + rows[:20]
    sets = {}
    for i, x in rows:
        if i is not None and x is not None:
            sets.setdefault(i, set()).add(x)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    df = spark.createDataFrame(rows, "id long, item string").repartition(4)
    with mock.patch.object(network, "BLOCK", block):
        got = [tuple(r) for r in network.shared_items(df, least).collect()]
    assert {(a, b): n for a, b, n in got} == want and len(got) == len(want)
    needs = spark.createDataFrame([(i, 1 + i % 4) for i in sets], "id long, least int")
    own = {p: len(sets[p[0]] & sets[p[1]]) for p in itertools.combinations(sorted(sets), 2)}
    own = {p: n for p, n in own.items() if n >= max(1 + p[0] % 4, 1 + p[1] % 4)}
    with mock.patch.object(network, "BLOCK", block):
        assert {(r.a, r.b): r.shared for r in network.shared_items(df, needs).collect()} == own
    assert network.shared_items(df.limit(0), least).count() == 0


def test_common_items_cost_no_pairs(spark):
    """A thousand sets with two items that all have, and one of their own pair: only the pairs are joined."""
    rows = [(i, x) for i in range(1000) for x in ("all", "every", f"own{i // 2}")]
    df = spark.createDataFrame(rows, "id long, item string")
    met = []
    real = network.F.array_intersect
    with mock.patch.object(network.F, "array_intersect", side_effect=lambda *a: met.append(1) or real(*a)):
        got = network.shared_items(df, 3)
    assert met and {(r.a, r.b) for r in got.collect()} == {(i, i + 1) for i in range(0, 1000, 2)}


def test_tail_is_the_hypergeometric_sum():
    rng = random.Random(3)
    rows = [(rng.randint(0, 12), rng.randint(1, 60), rng.randint(1, 60)) for _ in range(300)]
    total = 70
    want = []
    for k, a, b in rows:
        p = sum(math.comb(a, i) * math.comb(total - a, b - i) for i in range(max(k, a + b - total, 0), min(a, b) + 1)) if k <= min(a, b) else 0
        want.append(math.log(p / math.comb(total, b)) if p else -math.inf)
    got = network.log_tail(*(np.array([r[j] for r in rows]) if j != 3 else total for j in (0, 3, 1, 2)))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    big = network.log_tail(np.array([30, 200]), 5_000_000, np.array([400, 3000]), np.array([500, 3000]))
    exact = []
    for k, a, b in ((30, 400, 500), (200, 3000, 3000)):
        top = sum(math.comb(a, i) * math.comb(5_000_000 - a, b - i) for i in range(k, k + 60))
        exact.append((top.bit_length() - math.comb(5_000_000, b).bit_length()) * math.log(2) + math.log(top / (1 << top.bit_length())) - math.log(math.comb(5_000_000, b) / (1 << math.comb(5_000_000, b).bit_length())))
    assert np.allclose(big, exact, rtol=1e-9)
    assert np.allclose(network.log_factorial(np.array([0, 1, 5, 1024, 1025, 10**6])), [math.lgamma(n + 1) for n in (0, 1, 5, 1024, 1025, 10**6)], rtol=1e-13)


def test_network_of_profiles(spark):
    genes = [(f"a{i}", "A", None) for i in range(6)] + [(f"b{i}", "B", "portal; tail") for i in range(6)] + [(f"c{i}", "C", " tail ") for i in range(4)] + [("d0", "D", None), ("n", None, "x")]
    members = [(f"k{i}", f"{g}{i}") for i in range(5) for g in "ab"] + [("k0", "c0"), ("k0", "gone"), (None, "c1"), ("k0", "a1"), ("k9", "n")]
    g, m = spark.createDataFrame(genes, "gene string, genome string, keywords string"), spark.createDataFrame(members, "cluster string, gene string")
    profiles, genomes, clusters = network.cluster_profiles(g, m)
    assert {tuple(r) for r in genomes.select("genome", "proteins", "clusters", "singletons").collect()} == {("A", 6, 5, 1), ("B", 6, 5, 1), ("C", 4, 1, 3), ("D", 1, 0, 1)}
    by = {r.cluster: r for r in clusters.collect()}
    assert (by["k0"].size, by["k0"].annotated, by["k0"]["keys"]) == (5, 2, "tail (2); portal (1)") and (by["k9"].size, by["k9"].annotated, by["k9"]["keys"]) == (1, 0, None)
    total = 5 + 6
    p = sum(math.comb(6, i) * math.comb(total - 6, 6 - i) for i in range(5, 7)) / math.comb(total, 6)
    edges = network.shared_cluster_edges(profiles, genomes, least=-5).collect()
    weight = {(r.a, r.b): (r.shared, r.weight) for r in edges}
    assert weight["A", "B"][0] == 5 and abs(weight["A", "B"][1] - (-math.log10(p) - math.log10(6))) < 1e-9 and set(weight) == {("A", "B"), ("A", "C"), ("B", "C")}
    assert {(r.a, r.b) for r in network.shared_cluster_edges(profiles, genomes, least=0.3).collect()} == {k for k, v in weight.items() if v[1] > 0.3}
    assert network.shared_cluster_edges(profiles.limit(0), genomes.limit(0)).count() == 0
    at = {(r.row, r.column) for r in network.incidence(profiles).collect()}
    assert at == {(0, i) for i in range(5)} | {(1, i) for i in range(5)} | {(2, 0)}


def test_scaled_profiles(spark):
    df = spark.createDataFrame([("a", "AAAAACGTACGT"), ("b", "AC"), ("c", None)], "id string, seq string")
    got = {r.id: r.v for r in kmers.scaled_profiles(df).collect()}
    assert set(got) == {"a", "b"} and got["b"] is None and max(got["a"]) == 1.0 and min(got["a"]) == 0.0 and got["a"][0] == 1.0
