"""Hand-computed expectations, with a case on the line of every threshold."""

import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake import functions as fn
from seqlake.config import Config
from seqlake.operators import annotation, besthit, density, evidence, graph, kmers, models, msa, network, pairs, ranks, regions, taxonomy


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_ids_and_sequences(spark):
    df = spark.createDataFrame([("a_b_c_12", "AACGT")], "o string, s string")
    r = df.select(fn.genome_of(F.col("o")), fn.orf_index(F.col("o")), fn.reverse_complement(F.col("s")), fn.windows(F.col("s"), 4), fn.windows(F.col("s"), 6), fn.is_dna(F.col("s"), True)).first()
    assert tuple(r) == ("a_b_c", "12", "ACGTT", ["AACG", "ACGT"], [], True)


@pytest.mark.parametrize("iv,want", [([(1, 10), (11, 20), (30, 35)], 26), ([(1, 10), (12, 20)], 19), ([(5, 9), (1, 20), (2, 3)], 20), ([(4, 4)], 1)])
def test_interval_union(spark, iv, want):
    df = spark.createDataFrame([("k", a, b) for a, b in iv], "k string, start int, stop int")
    assert pairs.interval_union(df, ["k"]).first()["covered"] == want


def test_interval_union_against_sets(spark):
    rng = random.Random(3)
    data = [(k, a, a + rng.randrange(30)) for k in "xyz" for a in rng.choices(range(200), k=25)]
    want = sorted((k, len({p for q, a, b in data if q == k for p in range(a, b + 1)})) for k in "xyz")
    assert rows(pairs.interval_union(spark.createDataFrame(data, "k string, start int, stop int"), ["k"])) == want


def test_weighted_identity(spark):
    df = spark.createDataFrame([("a", 100, 90.0), ("a", 300, 98.0)], "q string, length int, pident double")
    assert pairs.weighted_identity(df, ["q"]).first()["pid"] == 96.0


def test_pair_table(spark):
    h = spark.createDataFrame([("A_1", "B_1", 80.0, 50.0), ("A_2", "B_2", 90.0, 40.0), ("A_2", "B_3", 70.0, 30.0)], "qseqid string, sseqid string, pident double, bitscore double")
    q, t = spark.createDataFrame([("A", 4)], "genome string, genes int"), spark.createDataFrame([("B", 5)], "genome string, genes int")
    assert rows(pairs.amino_acid_identity(h, q, t), "aai", "sgenes", "qcov", "tcov") == [(85.0, 2, 50.0, 40.0)]
    none = pairs.amino_acid_identity(h, q.limit(0), t)
    assert none.first()["qcov"] is None and pairs.edges(none).count() == 0
    assert pairs.amino_acid_identity(h, q, t, both_ways=True).count() == 2


def test_edges_are_inclusive(spark):
    p = spark.createDataFrame([("a", "b", 75.0, 1, 79.9, 80.0), ("a", "c", 74.9, 99, 100.0, 100.0), ("a", "d", 75.0, 14, 79.9, 79.9), ("a", "e", 75.0, 15, 1.0, 1.0)], "query string, target string, aai double, sgenes int, qcov double, tcov double")
    got = {r["target"]: r["score"] for r in pairs.edges(p).collect()}
    assert set(got) == {"b", "e"} and abs(got["b"] - 0.6) < 1e-9


def test_near_top_and_best(spark):
    h = spark.createDataFrame([("q", x, 50.0, b) for x, b in (("a", 100.0), ("b", 90.0), ("c", 89.0), ("d", 100.0))], "qseqid string, sseqid string, pident double, bitscore double")
    assert rows(besthit.near_top(h), "sseqid") == [("a",), ("b",), ("d",)]
    assert rows(besthit.near_top(h, strict=True), "sseqid") == [("a",), ("d",)]
    assert rows(besthit.best_hit(h), "sseqid") == [("a",)]
    assert rows(besthit.top_k(h, 2), "sseqid", "rank") == [("a", 1), ("d", 2)]


def test_spacer_and_trna_thresholds(spark):
    h = spark.createDataFrame([("v1", "m_CRISPR_1", 90.0, 95, 100), ("v2", "m_CRISPR_1", 90.1, 91, 100), ("v3", "m_CRISPR_1", 99.0, 90, 100)], "qseqid string, sseqid string, pident double, length int, slen int")
    assert rows(evidence.crispr(h, 90, 90), "accession", "host") == [("v2", "m")]
    t = spark.createDataFrame([("v", "a", 90.0, 95, 100), ("v", "b", 91.0, 94, 100), ("w", "c", 80.0, 300, 100)], "virus string, mag string, pident double, length int, slen int")
    assert rows(evidence.trna(t, 0.95), "accession", "host") == [("v", "a"), ("w", "c")]
    db = spark.createDataFrame([("v", "x|GCF_1.2|y", 99.0, 99, 100)], h.schema)
    assert rows(evidence.crispr_db(db, 90, 90), "accession", "host") == [("v", "GCF_1")]


def test_taxonomy(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)], "taxid int, parent int")
    tree = taxonomy.closure(nodes)
    assert rows(tree.where("taxid = 4"), "ancestor", "depth") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    hits = spark.createDataFrame([("o", 4, 9.0), ("o", 5, 7.0), ("p", 99, 3.0)], "orf string, taxid int, bitscore double")
    assert rows(taxonomy.orf_lca(hits, tree)) == [("o", 3, 9.0), ("p", None, 3.0)]
    orfs = spark.createDataFrame([("c", 4, 60.0), ("c", 5, 40.0), ("d", 4, 50.0), ("d", 5, 50.0)], "contig string, taxid int, bits double")
    got = rows(taxonomy.weighted_lca(orfs, tree), "contig", "ancestor", "score")
    assert got == [("c", 1, 1.0), ("c", 2, 1.0), ("c", 3, 1.0), ("c", 4, 0.6), ("d", 1, 1.0), ("d", 2, 1.0), ("d", 3, 1.0)]


def test_best_lineage(spark):
    tree = taxonomy.closure(spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1), (5, 4), (6, 5)], "taxid int, parent int"))
    orfs = spark.createDataFrame([("c", 3, 40.0), ("c", 6, 30.0), ("c", 5, 30.0), ("d", 3, 50.0), ("d", 5, 50.0), ("e", 2, 1.0), ("e", None, 9.0)], "contig string, taxid int, bits double")
    got = rows(taxonomy.weighted_lca(orfs, tree, 0.25), "contig", "ancestor", "score")
    assert got == [("c", 1, 1.0), ("c", 4, 0.6), ("c", 5, 0.6), ("c", 6, 0.3), ("d", 1, 1.0), ("d", 4, 0.5), ("d", 5, 0.5), ("e", 1, 1.0), ("e", 2, 1.0)]
    names = spark.createDataFrame([(1, "no rank", "root"), (4, "class", "Tailed phages")], "taxid int, rank string, name string")
    text = {r["contig"]: r["lineage"] for r in taxonomy.lineage_strings(taxonomy.weighted_lca(orfs, tree, 0.25), names, 1).collect()}
    assert text["d"] == "class:Caudoviricetes;unknown:unknown" and text["e"] == "unknown:unknown"
    with pytest.raises(ValueError):
        taxonomy.closure(spark.createDataFrame([(1, 2), (2, 1)], "taxid int, parent int"))


def test_closure_of_a_long_chain(spark):
    n = 150
    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(n)], "taxid int, parent int")
    assert taxonomy.closure(chain).count() == n * (n + 1) // 2


@pytest.mark.parametrize("whole", [500_000, 2])
def test_greedy_clusters_match_the_sequential_rule(spark, monkeypatch, whole):
    monkeypatch.setattr(graph, "WHOLE", whole)
    rng = random.Random(5)
    for _ in range(2):
        size = {i: rng.randrange(6) for i in range(14)}
        edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(25)})
        want, out = {}, {i: [b for a, b in edges if a == i] for i in size}
        for i in sorted(size, key=lambda i: (-size[i], i)):
            if i not in want:
                want[i] = i
                for j in out[i]:
                    want.setdefault(j, i)
        got = graph.greedy_clusters(spark.createDataFrame(list(size.items()), "node int, length int"), spark.createDataFrame(edges, "src int, dst int"))
        assert dict(rows(got, "node", "rep")) == want


def test_a_long_chain_of_greedy_clusters_takes_few_rounds(spark):
    n, tables = 10_000, []
    real = graph.materialize
    nodes, edges = spark.range(n).selectExpr("id AS node", "10000 - id AS length"), spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    with mock.patch.object(graph, "materialize", side_effect=lambda df, label: tables.append(label) or real(df, label)):
        got = graph.greedy_clusters(nodes, edges)
    assert got.where("rep = node AND node % 2 = 0 OR rep = node - 1 AND node % 2 = 1").count() == n == got.count()
    assert tables.count("graph-stars") <= 20 and tables.count("greedy-held") == 1


def test_components_markov_and_names(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7)], "a int, b int")
    assert dict(rows(graph.components(links))) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    e = [(a, b, 1.0) for a in range(4) for b in range(a)] + [(a, b, 1.0) for a in range(10, 14) for b in range(10, a)] + [(3, 10, 0.05), (20, 20, 1.0)]
    assert dict(rows(graph.markov_clusters(spark.createDataFrame(e, "a int, b int, w double")))) == {**{i: 0 for i in range(4)}, **{i: 10 for i in range(10, 14)}, 20: 20}
    named = graph.number_clusters(spark.createDataFrame([(1, 1), (2, 1), (5, 5), (8, 7), (9, 7)], "node int, cluster int"))
    assert dict(rows(named, "node", "name")) == {1: "group_1", 2: "group_1", 5: "singleton", 8: "group_2", 9: "group_2"}


def test_markov_beyond_the_bound(spark):
    e = [(a, b, 1.0 + (a * b) % 3) for a in range(12) for b in range(a)] + [(a, b, 1.0) for a in range(20, 30) for b in range(20, a)] + [(3, 20, 0.05), (20, 20, 3.0), (40, 41, 1.0), (50, 50, 1.0)]
    df = spark.createDataFrame(e, "a int, b int, w double")
    want = {**{i: 0 for i in range(12)}, **{i: 20 for i in range(20, 30)}, 40: 40, 41: 40, 50: 50}
    assert dict(rows(graph.markov_clusters(df))) == want
    assert dict(rows(graph.markov_clusters(df, max_nodes=10))) == want


def test_markov_large_clique_is_one_cluster(spark):
    e = spark.range(330).toDF("a").crossJoin(spark.range(330).toDF("b")).where("a < b").withColumn("w", F.lit(1.0))
    assert {c for _, c in rows(graph.markov_clusters(e))} == {0}


def test_matrix_square_by_blocks_and_by_join(spark):
    m = spark.range(900).selectExpr("id div 30 + 1 as i", "id % 30 + 1 as j", "(id * 7 % 11) / 10D as v")
    dense = np.array([[(k * 7 % 11) / 10 for k in range(30 * r, 30 * r + 30)] for r in range(30)])
    for side in (8, 1):
        got = np.zeros((30, 30))
        for r in graph._squared(m, side).collect():
            got[r["i"] - 1, r["j"] - 1] = r["v"]
        assert np.allclose(got, dense @ dense)


def test_propagation(spark):
    m = spark.createDataFrame(
        [(1, "a", 9, False, None, None), (1, "b", 8, False, "G", "l"), (2, "c", 5, True, "H", "x"), (2, "d", 7, False, None, None), (3, "e", 1, True, "H", "x"), (3, "f", 1, True, "I", "y"), (3, "g", 1, False, None, "z")],
        "cluster int, node string, length int, is_ref boolean, genus string, lineage string",
    )
    got = {r["node"]: (r["new_genus"], r["new_lineage"]) for r in graph.propagate(m).collect()}
    assert got == {"a": ("G", "l"), "b": ("G", "l"), "c": ("H", "x"), "d": ("H", "x"), "e": ("H", "x"), "f": ("I", "y"), "g": (None, "z")}


def test_virus_call(spark):
    df = spark.createDataFrame([(5000, 0.7, 0.05), (5000, 0.9, 0.8), (2999, 0.9, 0.9), (2999, None, 0.9), (5000, 0.4, 0.9), (5000, 0.4, 0.09), (5000, None, 0.76), (5000, None, 0.1), (5000, None, 0.09), (5000, None, None), (5000, 0.5, 0.5)], "length int, score double, proportion double")
    got = [tuple(r) for r in models.virus_call(df).select("pred", "call_score", "confidence").collect()]
    low = "lower than reject threshold"
    assert got == [
        ("non-virus", 0.05, low), ("virus", 0.9, "high-confidence"), ("virus", 0.9, "high-confidence"), ("filtered by length", 0.0, "rejected"), ("non-virus", 0.4, models.LOW_SCORE), ("non-virus", 0.4, low),
        ("virus", 0.76, "high-confidence"), ("virus", 0.1, models.LOW), ("non-virus", 0.0, low), ("non-virus", 0.0, low), ("virus", 0.5, models.LOW),
    ]


def test_evidence(spark):
    a = spark.createDataFrame([("v", "h1", 0.5)], "accession string, host string, score double")
    b = spark.createDataFrame([("v", "h2", 0.9), ("w", "h3", 0.1)], a.schema)
    ev = evidence.evidence(a, "tRNA-based").unionByName(evidence.evidence(b, "AAI-based"))
    assert rows(evidence.by_precedence(ev), "accession", "host") == [("v", "h1"), ("w", "h3")]
    assert evidence.multi(ev, ev.withColumn("cov", F.lit(1))).count() == 3
    c = spark.createDataFrame([("x", 10, "g", "g"), ("y", 9000, "g", "k")], "accession string, length int, host string, other string")
    assert rows(evidence.with_reason(c, a, "accession", "score", 3000), "accession", "score") == [("x", "filtered by length"), ("y", "-")]
    assert rows(evidence.agreement(c, ()), "accession", "agreed") == [("x", "genome"), ("y", None)]


def test_summary_keeps_every_key(spark):
    a = spark.createDataFrame([("x", 1, "p")], "k string, n int, a string")
    b = spark.createDataFrame([("y", 2, 5)], "k string, n int, b int")
    assert rows(evidence.summary([a, b], ["k", "n"])) == [("x", 1, "p", "-"), ("y", 2, "-", "5")]


def test_quality_bins_and_windows(spark):
    df = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 1, 1.24), (0, 2, 1, 1.25), (1, 2, 1, 1.0), (0, 0, 0, 1.0)], "n int, v int, h int, k double")
    got = [r[0] for r in df.select(regions.quality(*(F.col(c) for c in "nvhk"))).collect()]
    assert got == ["Low quality", "Medium quality", "High quality", "Medium quality", "Low quality", "High quality"]
    lens = spark.createDataFrame([(12500,), (12501,), (7500,), (4001,), (2000,), (4,)], "n int")
    assert [r[0] for r in lens.select(kmers.length_model(F.col("n"))).collect()] == [2, 1, 3, 3, 5, None]
    size = spark.createDataFrame([(10,), (75,), (55,), (400,)], "n int")
    assert [r[0] for r in size.select(regions.window_size(F.col("n"))).collect()] == [15, 22, 16, 50]


def plain_regions(label, gc, end, length):
    """The boundary rules word by word, on lists."""
    n = len(label)
    size = min(max(15, round(0.3 * n)), 50)

    def windows(s1, e1, s2, e2):
        if not any(label[s1:e1]):
            s1 = max([j for j in range(s1) if label[j]], default=s1)
        if not any(label[s2:e2]):
            e2 = min([j for j in range(e2 + 1, n) if label[j]], default=e2)
        left, right = [x for x in label[s1:e1] if x], [x for x in label[s2:e2] if x]
        delta = 0
        if left and right:
            by = sum(left) / len(left) - sum(right) / len(right)
            off = abs(sum(gc[s1:e1]) / (e1 - s1) - sum(gc[s2:e2]) / (e2 - s2))
            delta = (abs(by) + 0.02 * off) * ((by > 0) - (by < 0))
        return delta, (s1, e1, s2, e2), left, right

    cuts = []
    while True:
        start = cuts[-1][2] if cuts else 0
        best = None
        for i in range(1, n):
            if start and i - start < size:
                continue
            d, w, left, right = windows(start, i, i, min(i + size, n))
            host, viral = (left, right) if d < 0 else (right, left)
            many = n <= 10 or (host.count(-1) >= 2 and viral.count(1) >= 2)
            rich = left.count(-1) >= 0.3 * (w[1] - w[0]) - 1e-12 or right.count(-1) >= 0.3 * (w[3] - w[2]) - 1e-12
            if abs(d) < 1.2 or not (host.count(-1) and viral.count(1)) or not many or not rich:
                continue
            if best and not (d * best[0] > 0 and abs(d) > abs(best[0])):
                break
            best = (d, w)
        if not best:
            break
        cuts.append(best[1])
    if cuts:
        cuts[-1] = (*cuts[-1][:3], n)
    out, at = [], 1
    for c in cuts:
        d, _, left, _ = windows(*c)
        out.append(("host" if d < 0 else "viral", c[0], c[1], at, end[c[1] - 1], left.count(-1), left.count(1)))
        at = end[c[1] - 1] + 1
    if cuts:
        _, s1, e1 = out[-1][:3]
        right = windows(s1, e1, e1, n)[3]
        out.append(("viral" if out[-1][0] == "host" else "host", e1, n, at, length, right.count(-1), right.count(1)))
    return out


def test_regions_match_the_rules(spark):
    rng = random.Random(8)
    cases = {"even": [1] * 20 + [-1] * 20, "inner": [1] * 20 + [-1] * 10 + [1] * 20, "none": [0] * 40, "short": [1, 1, -1, -1, -1, 0], "gaps": [0] * 30 + [1] * 5 + [0] * 60 + [-1] * 9 + [0] * 40 + [1] * 9}
    for k in range(120):
        parts = [rng.choices([1, 0, -1], weights=w, k=rng.randrange(1, 60)) for w in rng.choices([(6, 3, 1), (1, 3, 6), (1, 9, 1), (8, 1, 0), (0, 1, 8)], k=rng.randrange(1, 7))]
        cases[f"r{k}"] = sum(parts, [])
    genes, sizes, want = [], [], []
    for name, label in cases.items():
        gc = [rng.choice([0.25, 0.5, 0.75]) for _ in label]
        end = [100 * i + 90 for i in range(len(label))]
        genes += [(name, i + 1, end[i] - 89, end[i], gc[i], x) for i, x in enumerate(label)]
        sizes.append((name, end[-1] + 37))
        want += [(name, *r) for r in plain_regions(label, gc, end, end[-1] + 37)]
    g = spark.createDataFrame(genes, "accession string, gene_no int, start int, end int, gc double, label int")
    got = rows(regions.define_regions(g, spark.createDataFrame(sizes, "accession string, length int")), "accession", "type", "start_gene", "end_gene", "start_pos", "end_pos", "host_genes", "viral_genes")
    assert got == sorted(want) and len({r[0] for r in got}) > 30
    # climbing stops at gene 15: one further is no stronger
    assert [r[1:4] for r in sorted((x for x in got if x[0] == "inner"), key=lambda r: r[2])][0] == ("viral", 0, 15)


def test_region_reports(spark):
    g = [("c", i + 1, 100 * i + 1, 100 * i + 90, 0.5, 1 if i < 20 else -1) for i in range(40)]
    size = spark.createDataFrame([("c", 4000)], "accession string, length int")
    r = regions.define_regions(spark.createDataFrame(g, "accession string, gene_no int, start int, end int, gc double, label int"), size)
    seq = spark.createDataFrame([("c", "A" * 2000 + "C" * 2000)], "accession string, seq string")
    assert regions.provirus(r, seq).first()["end_pos"] == 1990
    one = regions.region_summary(r, size).first()
    assert (one["regions"], one["contamination"]) == ("viral:1-1990;host:1991-4000", 50.25)


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8)).round(3)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "id long, v array<double>").repartition(5)
    dot = v @ v.T
    np.fill_diagonal(dot, -np.inf)
    for numbers in (56, 1 << 17):
        with mock.patch.object(density, "NUMBERS", numbers):
            got = {r["id"]: r["best"] for r in kmers.vector_argmax(df, df, skip_same=True).collect()}
        assert got == {i: int(dot[i].argmax()) for i in range(90)}
    assert kmers.vector_argmax(df.limit(0), df).count() == 0 and kmers.vector_argmax(df, df.limit(0)).count() == 0


def test_parameters():
    for bad in ({"task": "x"}, {"mode": "B"}, {"markers": ("terl", "y")}, {"genomes_only": True}, {"genome_taxonomy": "t.tsv"}, {"spacer_identity": 80}, {"reject": 21}, {"spacer_program": "z"}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(genomes="f", genomes_only=True, markers=("head",)).markers == ("head",)


def test_first_hits(spark):
    h = spark.createDataFrame([("q", 1, 100, 1, 200, 0), ("q", 1, 100, 100, 1, 1), ("q", 1, 90, 1, 90, 2), ("r", 1, 9, 5, 5, 0)], "qseqid string, qstart int, qend int, sstart int, send int, n int")
    assert rows(besthit.span_ratio(h, F.col("n"))) == [("q", 1.0)]
    e = spark.createDataFrame([("p", 0.5, 0), ("p", 0.1, 1)], "query string, evalue double, n int")
    assert rows(besthit.first_evalue(e, F.col("n"))) == [("p", 0.5)]


def test_kmer_host_calls(spark):
    hits = spark.createDataFrame([("v1_1", "m1", 80.0), ("v1_2", "m1", 90.0), ("v1_1", "m2", 40.0), ("v2_1", "m3", 55.0)], "qseqid string, mag string, pident double")
    per = evidence.mag_identity(hits)
    assert rows(per) == [("v1", "m1", 0.9), ("v1", "m2", 0.4), ("v2", "m3", 0.55)]
    calls = spark.createDataFrame([("v1", "m1"), ("v2", "m1"), ("v3", "m1")], "accession string, host string")
    assert rows(evidence.mean_identity(calls.select(F.col("accession").alias("phage")), per)) == [("v1", 0.65), ("v2", 0.55), ("v3", 0.0)]
    assert rows(evidence.kmer_gate(calls, per)) == [("v1", "m1", 0.9)]
    taxa = spark.createDataFrame([("m1", "species:a", "genus:g", None), ("m3", "species:b", "genus:g", None)], "mag string, species string, genus string, family string")
    assert rows(evidence.kmer_gate(calls, per, taxa)) == [("v1", "m1", 0.9), ("v2", "genus:g", 0.55)]
    evidence.check_complete(per.select("mag").where("mag <> 'm2'"), taxa.select("mag"))
    with pytest.raises(ValueError):
        evidence.check_complete(per.select("mag"), taxa.select("mag"))
    with pytest.raises(ValueError, match="m2"):
        evidence.strict_lookup(per, taxa, "mag", "genus")


def test_nearest_profile_by_density(spark):
    seqs = spark.createDataFrame([("a", "ACGT" * 30), ("b", "AATT" * 30), ("c", "GGCC" * 30)], "id string, seq string")
    refs = kmers.profiles(seqs)
    assert len(refs.first()["v"]) == 256
    q = kmers.profiles(spark.createDataFrame([("x", "ACGT" * 20 + "AAAA"), ("y", "GGCC" * 25)], "id string, seq string")).withColumn("model", F.lit(3))
    got = rows(kmers.density_argmax(q.union(q.select(F.lit("z"), "v", F.lit(None))), refs, {3: kmers.gaussian(0.01)}), "id", "best")
    assert got == [("x", "a"), ("y", "c")]


def test_msa(spark):
    m = spark.createDataFrame([("m1", "a", "AA-"), ("m2", "a", "CC"), ("m1", "b", "TTT")], "marker string, id string, aln string")
    assert rows(msa.intersection(m)) == [("a", "AA-CC")]
    assert rows(msa.union(m)) == [("a", "AA-CC"), ("b", "TTT--")]
    assert msa.only_references(m.limit(0).withColumn("is_ref", F.lit(True)))


def test_ranks(spark):
    d = spark.createDataFrame([(1, "realm:Duplo:x;family:F", "0.9;")], "id int, lineage string, scores string")
    x = ranks.explode_lineage(d, "id", "lineage", "scores")
    assert rows(x, "rank", "name", "score") == [("family", "F", None), ("realm", "Duplo:x", 0.9)]
    assert rows(ranks.pivot_ranks(x, "id", ["realm", "genus"])) == [(1, "Duplo:x", "NA")]
    valid = spark.createDataFrame([("Realm", "Duplodnaviria", 0), ("Genus", "Duploxvirus", 1), ("Family", "F", 2), ("Order", "Fxvirales", 3)], "rank string, name string, ord int")
    n = spark.createDataFrame([("realm", "Duploviria"), ("genus", "Duploxvirus"), ("family", "Duploxviridae"), ("order", "F"), ("family", "Qviridae"), ("species", "Fx")], "rank string, name string")
    assert rows(ranks.to_valid_rank(n, valid), "name", "valid_rank", "valid_name") == [
        ("Duploviria", "Realm", "Duplodnaviria"), ("Duploxviridae", "Genus", "Duploxvirus"), ("Duploxvirus", "Genus", "Duploxvirus"), ("F", "Family", "F"), ("Fx", "Order", "Fxvirales"), ("Qviridae", None, None),
    ]
    assert rows(ranks.scores_by_rank(x, "id", ["realm", "genus"])) == [(1, "Duplo:x", "0.9", "NA", "NA")]


def test_sentences_and_annotation(spark):
    h = spark.createDataFrame([("c_10", "p", 1.0, 9.0), ("c_2", "r", 1.0, 9.0), ("c_2", "p", 1.0, 8.9), ("c_3", "z", 1.0, 9.0)], "qseqid string, sseqid string, pident double, bitscore double")
    v = spark.createDataFrame([("p", 0), ("r", 4)], "protein string, token int")
    text = lambda lex: models.sentences(h, v, 5, lex).select(models.sentence_text(F.col("tokens"))).first()[0]
    assert text(False) == "5 1" and text(True) == "1 5"
    g = spark.createDataFrame([("c_1",), ("c_2",), ("c_3",)], "orf_id string")
    b = spark.createDataFrame([("c_1", "p", 9.0, 1.0), ("c_2", "q", 9.0, 1.0)], "qseqid string, sseqid string, pident double, coverage double")
    a = annotation.annotate(g, b, spark.createDataFrame([("p", "portal")], "protein string, description string"))
    assert rows(a, "orf_id", "annotation") == [("c_1", "portal"), ("c_2", "hypothetical protein"), ("c_3", "hypothetical protein (no hit)")]
    assert rows(annotation.annotation_rate(a)) == [("c", 3, 1, 0.33)]


def test_config_ranges():
    assert Config().min_length == 3000
    with pytest.raises(ValueError):
        Config(reject=21)
    with pytest.raises(ValueError):
        Config(aai=101)


def test_lifestyle(spark):
    df = spark.createDataFrame([([0.0, 2.0],), ([2.0, 0.0],), (None,)], "logits array<double>")
    assert [r[0] for r in models.lifestyle(df).select("type").collect()] == ["temperate", "virulent", None]


def test_shared_clusters_against_fractions(spark):
    from math import comb, log10

    rows_ = [("a", f"k{i}") for i in range(6)] + [("b", f"k{i}") for i in range(1, 7)] + [("c", f"k{i}") for i in range(20, 26)]
    alone = spark.createDataFrame([("a", 6, 0), ("b", 6, 0), ("c", 6, 27)], "genome string, clusters long, singletons long")  # 13 clusters and 27 singletons
    got = network.shared_cluster_edges(spark.createDataFrame(rows_, "genome string, cluster string"), alone).where("a <> 'c' AND b <> 'c'").collect()
    p = sum(comb(6, i) * comb(34, 6 - i) for i in range(5, 7)) / comb(40, 6)
    assert [(r["a"], r["b"], r["shared"]) for r in got] == [("a", "b", 5)] and abs(got[0]["weight"] - (-log10(p) - log10(3))) < 1e-9


def test_canonical_depth_makes_no_strings(spark):
    """Depths of words of any letters against a plain count, and no text for each window of a contig."""
    flip = str.maketrans("ACGTacgt", "TGCAtgca")
    rng = random.Random(9)
    seqs = ["".join(rng.choices(a, k=n)) for a in ("ACGT", "ACGTN", "ACGTacgtN", "é漢ACGT🎉", "A") for n in (0, 2, 3, 4, 60, 300)]
    seqs += [s + s[::-1].translate(flip) for s in seqs]
    df = spark.createDataFrame([*enumerate(seqs), (-1, None)], "id long, seq string").repartition(3)
    for k in (3, 21, 40):
        found = kmers.canonical_depth(df, k)
        assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
        got = {r.id: r.kmer_freq for r in found.collect()}
        assert len(got) == len(seqs) + 1 and got[-1] is None
        for i, s in enumerate(seqs):
            own = [min(w, w[::-1].translate(flip)) for w in (s[j : j + k] for j in range(len(s) - k + 1))]
            assert got[i] == (pytest.approx(len(own) / len(set(own)), abs=0.0051) if own else None)
