"""More registered queries: host evidence, regions and markers, sources and sinks by round trip. Same form as catalog.py."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlake import functions as fn
from seqlake import sources
from seqlake.operators import annotation, besthit, evidence, kmers, models, pairs, regions
from seqlake.plans import testbed as tb
from seqlake.plans.catalog import query
from seqlake.sources import sinks
from seqlake.storage import scratch_dir

_TRNA = "tr AS (SELECT 'c' || (l_orderkey % 200) AS virus, 'm' || (l_suppkey % 25) AS mag, 50 + l_quantity AS pident, CAST(60 + l_partkey % 60 AS INT) AS length, 100 AS slen FROM lineitem)"


@query(f"""WITH {_TRNA} SELECT virus AS accession, mag AS host, round(pident / 100, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY virus ORDER BY pident DESC, least(length / 100.0::DOUBLE, 1) DESC, mag) AS rn
FROM tr WHERE length / 100.0::DOUBLE >= 0.95::DOUBLE) WHERE rn = 1""")
def host_by_trna(spark, d):
    t = tb.table(spark, d, "lineitem").select(F.expr("concat('c', l_orderkey % 200)").alias("virus"), F.expr("concat('m', l_suppkey % 25)").alias("mag"), (50 + F.col("l_quantity")).alias("pident"), (60 + F.col("l_partkey") % 60).cast("int").alias("length"), F.lit(100).alias("slen"))
    return evidence.trna(t, 0.95).select("accession", "host", F.round("score", 6).alias("score"))


_MAGS = "mh AS (SELECT 'c' || (l_orderkey % 80) || '_' || l_linenumber AS qseqid, 'm' || (l_suppkey % 30) AS mag, 40 + l_quantity AS pident FROM lineitem WHERE l_orderkey % 80 >= 10)"


def _mag_hits(spark, d):
    return tb.table(spark, d, "lineitem").where("l_orderkey % 80 >= 10").select(F.expr("concat('c', l_orderkey % 80, '_', l_linenumber)").alias("qseqid"), F.expr("concat('m', l_suppkey % 30)").alias("mag"), (40 + F.col("l_quantity")).alias("pident"))


@query(f"WITH {_MAGS} SELECT regexp_replace(qseqid, '_[^_]*$', '') AS phage, mag, round(max(pident) / 100, 6) AS ident FROM mh GROUP BY 1, 2")
def mag_identity(spark, d):
    return evidence.mag_identity(_mag_hits(spark, d)).select("phage", "mag", F.round("ident", 6).alias("ident"))


@query(f"""WITH {_MAGS}, x AS (SELECT regexp_replace(qseqid, '_[^_]*$', '') AS phage, mag, max(pident) / 100 AS ident FROM mh GROUP BY 1, 2), p AS (SELECT 'c' || range AS phage FROM range(80))
SELECT phage, round(coalesce(avg(ident), 0), 6) AS mean FROM p LEFT JOIN x USING (phage) GROUP BY 1""")
def mean_identity(spark, d):
    p = spark.range(80).select(F.expr("concat('c', id)").alias("phage"))
    return evidence.mean_identity(p, evidence.mag_identity(_mag_hits(spark, d))).select("phage", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_MAGS}, x AS (SELECT regexp_replace(qseqid, '_[^_]*$', '') AS phage, mag, max(pident) / 100 AS ident FROM mh GROUP BY 1, 2), taxa AS (SELECT 'm' || range AS mag, CASE WHEN range % 4 <> 0 THEN 'genus:g' || (range % 6) END AS genus FROM range(30)),
calls AS (SELECT 'c' || range AS accession, 'm' || (range % 37) AS host FROM range(80)), m AS (SELECT phage, avg(ident) AS mean FROM x GROUP BY 1),
l AS (SELECT phage, arg_max(genus, mag) AS genus FROM x JOIN taxa USING (mag) WHERE genus IS NOT NULL GROUP BY 1)
SELECT accession, CASE WHEN x.mag IS NOT NULL THEN host ELSE t.genus END AS host, round(coalesce(ident, mean), 2) AS score FROM calls c JOIN m ON m.phage = accession LEFT JOIN x ON x.phage = accession AND x.mag = host
LEFT JOIN taxa t ON t.mag = host LEFT JOIN l ON l.phage = accession WHERE x.mag IS NOT NULL OR t.genus = l.genus""")
def host_by_kmer_gate(spark, d):
    taxa = spark.range(30).select(F.expr("concat('m', id)").alias("mag"), F.lit(None).cast("string").alias("species"), F.expr("CASE WHEN id % 4 <> 0 THEN concat('genus:g', id % 6) END").alias("genus"), F.lit(None).cast("string").alias("family"))
    calls = spark.range(80).select(F.expr("concat('c', id)").alias("accession"), F.expr("concat('m', id % 37)").alias("host"))
    return evidence.kmer_gate(calls, evidence.mag_identity(_mag_hits(spark, d)), taxa)


@query("""WITH q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id AS ref, embedding AS r FROM embeddings),
s AS (SELECT vec_id, ref, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i]::DOUBLE - r[i]::DOUBLE) * (v[i]::DOUBLE - r[i]::DOUBLE))) AS d2 FROM q, r WHERE vec_id <> ref),
w AS (SELECT *, (SELECT any_value(len(v)) FROM q) AS n, CASE WHEN vec_id % 100 = 0 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS h FROM s)
SELECT vec_id AS id, arg_min(ref, d2) AS best, round(max(-0.5 * d2 / (h * h) - n * ln(h * sqrt(2 * pi()))), 5) AS score FROM w GROUP BY 1""")
def host_by_density(spark, d):
    e = tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id % 50 = 0").withColumn("model", F.when(F.col("id") % 100 == 0, 1).otherwise(2))
    return kmers.density_argmax(q, e, {1: kmers.gaussian(0.5), 2: kmers.gaussian(2.0)}, skip_same=True).select("id", "best", F.round("score", 5).alias("score"))


_HITS14 = """h14 AS (SELECT 'v' || (l_orderkey % 40) AS qseqid, 'v' || (l_partkey % 40) AS sseqid, 80 + l_quantity * 0.4 AS pident, CAST(l_quantity * 4 AS INT) AS length,
  CAST(1 + l_suppkey * 7 % 300 AS INT) AS qstart, CAST(1 + l_suppkey * 7 % 300 + l_quantity * 4 AS INT) AS qend, CAST(500 - l_linenumber * 20 AS INT) AS sstart, CAST(500 - l_linenumber * 20 - l_quantity * 4 AS INT) AS send, 600 AS qlen, 700 AS slen FROM lineitem WHERE l_partkey % 5 = 0)"""


def _hits14(spark, d):
    li, i = tb.table(spark, d, "lineitem").where("l_partkey % 5 = 0"), lambda x: F.expr(x).cast("int")
    return li.select(
        F.expr("concat('v', l_orderkey % 40)").alias("qseqid"), F.expr("concat('v', l_partkey % 40)").alias("sseqid"), (80 + F.col("l_quantity") * 0.4).alias("pident"), i("l_quantity * 4").alias("length"),
        i("1 + l_suppkey * 7 % 300").alias("qstart"), i("1 + l_suppkey * 7 % 300 + l_quantity * 4").alias("qend"), i("500 - l_linenumber * 20").alias("sstart"), i("500 - l_linenumber * 20 - l_quantity * 4").alias("send"),
        F.lit(600).alias("qlen"), F.lit(700).alias("slen"),
    )


@query(f"""WITH {_HITS14}, n AS (SELECT * FROM h14 WHERE qseqid <> sseqid),
p AS (SELECT qseqid, sseqid, count(*) AS num_alns, ((2 * sum(CAST(length AS HUGEINT) * CAST(round(pident * 1000000) AS HUGEINT)) + sum(length) * 10000) // (2 * sum(length) * 10000)) / 100.0::DOUBLE AS pid FROM n GROUP BY 1, 2),
pos AS (SELECT DISTINCT qseqid, sseqid, unnest(range(send, sstart + 1)) AS at FROM n), c AS (SELECT qseqid, sseqid, round(100.0::DOUBLE * count(*) / 700, 2) AS tcov FROM pos GROUP BY 1, 2)
SELECT qseqid AS qname, sseqid AS tname, num_alns, pid, tcov FROM p JOIN c USING (qseqid, sseqid) WHERE tcov >= 10 AND pid >= 90""")
def ani_edges(spark, d):
    return pairs.ani_edges(pairs.nucleotide_pairs(_hits14(spark, d)), 90, 10).select("qname", "tname", "num_alns", "pid", "tcov")


@query(f"WITH {tb.HITS_SQL} SELECT qseqid, sseqid, bitscore FROM hits WHERE regexp_replace(qseqid, '^q', '') <> regexp_replace(sseqid, '^t', '')")
def self_exclusion(spark, d):
    h = tb.hits(spark, d).select("qseqid", "sseqid", "bitscore")
    bare = h.withColumn("q", F.regexp_replace("qseqid", "^q", "")).withColumn("t", F.regexp_replace("sseqid", "^t", ""))
    return besthit.no_self(bare, "q", "t").select("qseqid", "sseqid", "bitscore")


@query(f"""WITH {tb.HITS_SQL}, s AS (SELECT qseqid, sseqid, pident, bitscore FROM hits UNION ALL SELECT sseqid, qseqid, pident, bitscore FROM hits),
g AS (SELECT *, regexp_replace(qseqid, '_[^_]*$', '') AS query, regexp_replace(sseqid, '_[^_]*$', '') AS target FROM s),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, target, qseqid ORDER BY bitscore DESC, pident DESC, sseqid) AS rn FROM g) WHERE rn = 1)
SELECT query, target, round(avg(pident), 6) AS aai, count(*) AS sgenes FROM o GROUP BY 1, 2""")
def aai_both_ways(spark, d):
    h = tb.hits(spark, d)
    n = pairs.genome_sizes(h.select(F.col("qseqid").alias("orf_id")))
    return pairs.amino_acid_identity(h, n, n, both_ways=True).select("query", "target", F.round("aai", 6).alias("aai"), "sgenes")


@query(f"WITH {tb.ORFS_SQL}, o AS (SELECT DISTINCT orf_id, regexp_replace(orf_id, '_[^_]*$', '') AS accession, size % 3 = 0 AS hit FROM orfs) SELECT accession, round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 6) AS proportion FROM o GROUP BY 1")
def mapped_share(spark, d):
    o = tb.orfs(spark, d)
    return models.mapped_share(o, o.where("size % 3 = 0").select(F.col("orf_id").alias("qseqid"))).select("accession", F.round("proportion", 6).alias("proportion"))


_MARKERS = "mk AS (SELECT 'k' || range AS domain, CASE WHEN range % 3 = 0 THEN 'viral' WHEN range % 3 = 1 THEN 'microbial' ELSE 'other' END AS category FROM range(12))"


def _markers(spark):
    return spark.range(12).select(F.expr("concat('k', id)").alias("domain"), F.expr("CASE WHEN id % 3 = 0 THEN 'viral' WHEN id % 3 = 1 THEN 'microbial' ELSE 'other' END").alias("category"))


@query(f"""WITH {_MARKERS}, g AS (SELECT event_id AS orf_id, CAST(user_id AS VARCHAR) AS accession, CASE WHEN event_id % 4 <> 0 THEN 'k' || (event_id % 15) END AS target FROM events)
SELECT accession, count(*) AS genes, count(*) FILTER (WHERE category = 'viral') AS viral, count(*) FILTER (WHERE category = 'microbial') AS host FROM g LEFT JOIN mk ON domain = target GROUP BY 1""")
def marker_counts(spark, d):
    e = tb.table(spark, d, "events")
    g = e.select(F.col("event_id").alias("orf_id"), F.col("user_id").cast("string").alias("accession"))
    h = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("orf_id"), F.expr("concat('k', event_id % 15)").alias("target"))
    return regions.marker_counts(regions.label_genes(g, h, _markers(spark)))


@query(f"""WITH {tb.CONTIGS_SQL}, r AS (SELECT accession, 'viral' AS type, 11 AS a, 40 AS b, seq FROM contigs WHERE CAST(accession AS INT) % 2 = 0 UNION ALL SELECT accession, 'host', 41, 60, seq FROM contigs)
SELECT accession, a AS start_pos, b AS end_pos, substr(seq, a, b - a + 1) AS seq FROM r WHERE type = 'viral' OR CAST(accession AS INT) % 2 = 1""")
def provirus_regions(spark, d):
    c = tb.contigs(spark, d)
    two = F.array(F.struct(F.lit("viral").alias("type"), F.lit(11).alias("start_pos"), F.lit(40).alias("end_pos")), F.struct(F.lit("host").alias("type"), F.lit(41).alias("start_pos"), F.lit(60).alias("end_pos")))
    r = c.select("accession", F.explode(two).alias("r")).select("accession", "r.*").where("type = 'host' OR CAST(accession AS INT) % 2 = 0")
    return regions.provirus(r, c.select("accession", "seq"))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity / l_linenumber / 10, 1) AS coverage FROM lineitem")
def capped_coverage(spark, d):
    li = tb.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", fn.coverage_to_qend(F.col("l_quantity"), F.col("l_linenumber") * 10).alias("coverage"))


@query(f"WITH {tb.CONTIGS_SQL} SELECT accession FROM contigs WHERE regexp_full_match(upper(lang || source), '[ATCGN]*') OR regexp_full_match(seq, '[ACGT]*')")
def dna_alphabet(spark, d):
    c = tb.contigs(spark, d)
    return c.where(fn.is_dna(F.concat("lang", "source")) | fn.is_dna(F.col("seq"), True)).select("accession")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def semi_join(spark, d):
    c = tb.table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return tb.table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query(f"""WITH {tb.ORFS_SQL} SELECT orf_id, CASE WHEN size % 4 = 0 THEN 'hypothetical protein (no hit)' WHEN size % 4 = 3 THEN 'hypothetical protein' ELSE 'name' || (size % 4) END AS annotation, CASE WHEN size % 4 = 2 THEN 'ref2' ELSE '-' END AS inference FROM orfs""")
def annotation_references(spark, d):
    o = tb.orfs(spark, d)
    best = o.where("size % 4 > 0").select(F.col("orf_id").alias("qseqid"), F.expr("concat('p', size % 4)").alias("sseqid"), F.lit(90.0).alias("pident"), F.lit(1.0).alias("coverage"))
    names = spark.createDataFrame([("p1", "name1"), ("p2", "name2")], "protein string, description string")
    refs = spark.createDataFrame([("p2", "ref2")], "protein string, reference string")
    return annotation.annotate(o.select("orf_id"), best, names, refs).select("orf_id", "annotation", "inference")


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {tb.CONTIGS_SQL} SELECT accession, seq FROM contigs WHERE seq <> ''")
def fasta_round_trip(spark, d):
    """Contigs written as FASTA, one folder for each language, and read back."""
    at = _folder(spark, "fasta")
    sinks.fasta(tb.contigs(spark, d).where("seq <> ''").withColumn("kind", F.coalesce("lang", F.lit("none"))), at, by="kind")
    return sources.fasta(spark, f"{at}/*").select("accession", "seq")


@query(f"WITH {tb.HITS_SQL} SELECT qseqid, sseqid, pident, length, bitscore FROM hits")
def hits_round_trip(spark, d):
    """An alignment table in the 12-column format, written and read under its schema."""
    at, h = _folder(spark, "hits"), tb.hits(spark, d)
    zero = F.lit(0)
    h.select("qseqid", "sseqid", "pident", "length", zero, zero, zero, zero, zero, zero, "evalue", "bitscore").write.csv(at, sep="\t")
    return sources.hits(spark, at).select("qseqid", "sseqid", "pident", "length", "bitscore")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN '-' ELSE c_name END AS name FROM customer")
def tsv_round_trip(spark, d):
    """A table with `-` for null, written and read back."""
    at = _folder(spark, "tsv")
    c = tb.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).alias("name"))
    sinks.tsv(c, at)
    return sources.dimension(spark, at, "c_custkey string, name string", sep="\t")


@query(f"WITH {tb.CONTIGS_SQL} SELECT count(*) AS records FROM contigs WHERE seq <> ''")
def sequence_count(spark, d):
    at = _folder(spark, "count")
    sinks.fasta(tb.contigs(spark, d).where("seq <> ''"), at)
    return spark.range(1).select(F.lit(sources.count_records(spark, at)).cast("bigint").alias("records"))
