"""The tasks end to end on a small made-up sample."""

import pytest
from pyspark.sql import functions as F

from seqlake.config import Config
from seqlake.plans import tasks

C = Config(min_length=10)


def sample(spark):
    contigs = spark.createDataFrame([("v1", 40, "ACGT" * 10), ("v2", 30, "AACC" * 7 + "GG"), ("m1", 20, "T" * 20), ("s", 5, "ACGTA")], "accession string, length int, seq string")
    orfs = spark.createDataFrame([("v1_1", 1, 9, 1, 0.5), ("v1_2", 10, 20, 1, 0.5), ("v2_1", 1, 9, -1, 0.4), ("m1_1", 1, 9, 1, 0.4)], "orf_id string, start int, end int, strand int, gc double")
    h = [("v1_1", "p1", 90.0, 9, 200.0, 10), ("v1_1", "p2", 80.0, 9, 190.0, 10), ("v1_2", "p2", 70.0, 9, 50.0, 10), ("v2_1", "p3", 99.0, 9, 80.0, 9)]
    hits = spark.createDataFrame(h, "qseqid string, sseqid string, pident double, length int, bitscore double, qend int")
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "taxid int, parent int")
    names = spark.createDataFrame([(1, "no rank", "root"), (2, "realm", "R"), (3, "genus", "G"), (4, "genus", "H")], "taxid int, rank string, name string")
    taxa = spark.createDataFrame([("p1", 3), ("p2", 4), ("p3", 3)], "protein string, taxid int")
    return contigs, orfs, hits, taxa, nodes, names


def test_end_to_end(spark):
    contigs, orfs, hits, taxa, nodes, names = sample(spark)
    spacers = spark.createDataFrame([("v1", "mag7_CRISPR_1", 0.0, 99.0, 30, 30)], "qseqid string, sseqid string, evalue double, pident double, length int, slen int")
    ev = tasks.host_evidence(C, spacers=spacers, kmer=spark.createDataFrame([("v1", "mag9", 1.0), ("v2", "mag9", 0.9)], "accession string, host string, score double"))
    logits = spark.createDataFrame([("v1", [0.0, 3.0]), ("v2", [1.0, 0.0])], "accession string, logits array<double>")
    out = {r["accession"]: r for r in tasks.end_to_end(contigs, orfs, hits, taxa, nodes, names, ev, ["realm:R;genus"], C, logits=logits).collect()}
    assert set(out) == {"v1", "v2", "m1", "s"}
    assert (out["v1"]["pred"], out["v1"]["lineage"], out["v1"]["host"], out["v1"]["type"]) == ("virus", "realm:R", "mag7", "-")
    assert (out["v2"]["lineage"], out["v2"]["host"], out["v2"]["type"]) == ("realm:R;genus:G", "mag9", "virulent")
    assert (out["m1"]["pred"], out["m1"]["lineage"]) == ("non-virus", "-") and out["s"]["pred"] == "filtered by length"
    whole = tasks.taxonomy_calls(contigs, orfs, hits, taxa, nodes, names, C)
    assert {r["accession"]: r["status"] for r in whole.collect()} == {"v1": "ok", "v2": "ok", "m1": "no hits to database", "s": "filtered by length"}


def test_annotate_and_hosts(spark):
    contigs, orfs, hits, *_ = sample(spark)
    genes, rate = tasks.annotate(orfs, hits, spark.createDataFrame([("p1", "portal")], "protein string, description string"))
    assert {r["accession"]: r["rate"] for r in rate.collect()} == {"v1": 0.5, "v2": 0.0, "m1": 0.0}
    assert genes.where("orf_id = 'v1_1'").first()["coverage"] == 0.9
    table = {r.orf_id: r for r in tasks.gene_table(genes).collect()}
    assert (table["v1_1"].pident, table["v1_1"].coverage, table["v1_1"].closest_gene) == ("90.00", "0.90", "portal") and (table["m1_1"].pident, table["m1_1"].closest_gene) == ("0.00", "-")
    named = tasks.annotate(orfs, hits, spark.createDataFrame([("p1", "portal")], "protein string, description string"), spark.createDataFrame([("p1", "YP_1")], "protein string, reference string"))[0]
    assert named.where("orf_id = 'v1_1'").first()["inference"] == "YP_1"
    own = contigs.where("length > 25")
    hosts = own.withColumn("accession", F.concat(F.lit("h_"), "accession"))
    near = {r["accession"]: r["host"] for r in tasks.kmer_host(own, hosts, own.select("accession", F.concat(F.lit("h_"), "accession").alias("host"))).collect()}
    assert near == {"v1": "h_v1", "v2": "h_v2"}
    with pytest.raises(ValueError):
        tasks.kmer_host(own, hosts)


def test_units_and_contamination(spark):
    contigs, orfs, *_ = sample(spark)
    row = lambda q, t, p, n: (q, t, p, n, 0, 0, 1, n, n, 1, 0.0, 1.0, 40 if q == "v1" else 30, 30)
    hits = spark.createDataFrame([row("v1", "v2", 96.0, 29), row("v2", "v1", 96.0, 29), row("v1", "v1", 100.0, 40), row("v1", "m1", 94.0, 29)], "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int")
    got = {r["accession"]: (r["unit"], r["representative"]) for r in tasks.species_units(contigs, hits, C).collect()}
    assert got == {"v1": ("group_1", "v1"), "v2": ("group_1", "v1"), "m1": ("singleton", "m1"), "s": ("singleton", "s")}
    own = spark.createDataFrame([("v1_1", "v2_1", 90.0, 9.0), ("v2_1", "v1_1", 90.0, 9.0), ("v1_2", "v1_2", 100.0, 9.0)], "qseqid string, sseqid string, pident double, bitscore double")
    units = {r["accession"]: r["representative"] for r in tasks.genus_units(contigs, own, orfs, C).collect()}
    assert units == {"v1": "v1", "v2": "v1", "m1": "m1", "s": "s"}
    genes = spark.createDataFrame([("v1", f"v1_{i}", i, i * 2, i * 2 + 1, 0.5) for i in range(1, 31)], "accession string, orf_id string, gene_no int, start int, end int, gc double")
    marks = spark.createDataFrame([(f"v1_{i}", "V" if i <= 15 else "M", 1e-9) for i in range(1, 31)], "orf_id string, target string, evalue double")
    quality, found = tasks.contamination(contigs, genes, marks, spark.createDataFrame([("V", "viral"), ("M", "microbial")], "domain string, category string"))
    q = {r["accession"]: r["quality"] for r in quality.collect()}
    assert q["v1"] == "Low quality" and q["s"] == "High quality" and found.count() == 2
