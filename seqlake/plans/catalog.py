"""The registered queries of the metagenomics operators, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake import functions as fn
from seqlake.operators import annotation, besthit, evidence, graph, kmers, models, msa, pairs, ranks, regions, taxonomy
from seqlake.plans import testbed as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {tb.CONTIGS_SQL} SELECT accession, length FROM contigs WHERE length >= 3000")
def length_filter(spark, d):
    return tb.contigs(spark, d).where("length >= 3000").select("accession", "length")


@query(f"WITH {tb.ORFS_SQL} SELECT orf_id, regexp_replace(orf_id, '_[^_]*$', '') AS genome, string_split(orf_id, '_')[-1] AS idx, length(clean) AS size FROM orfs")
def orf_ids(spark, d):
    o = tb.orfs(spark, d)
    return o.select("orf_id", fn.genome_of(F.col("orf_id")).alias("genome"), fn.orf_index(F.col("orf_id")).alias("idx"), F.length("clean").alias("size"))


@query(f"WITH {tb.ORFS_SQL} SELECT regexp_replace(orf_id, '_[^_]*$', '') AS genome, count(*) AS genes FROM orfs GROUP BY 1")
def genome_size(spark, d):
    return pairs.genome_sizes(tb.orfs(spark, d))


_BEST = "row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, pident DESC, sseqid) AS rank"


@query(f"WITH {tb.HITS_SQL} SELECT qseqid, sseqid, pident, bitscore FROM (SELECT *, {_BEST} FROM hits) WHERE rank = 1")
def best_hit(spark, d):
    return besthit.best_hit(tb.hits(spark, d)).select("qseqid", "sseqid", "pident", "bitscore")


@query(f"WITH {tb.HITS_SQL} SELECT qseqid, sseqid, pident, bitscore FROM (SELECT *, max(bitscore) OVER (PARTITION BY qseqid) AS top FROM hits) WHERE bitscore >= top * 0.9::DOUBLE")
def near_top_inclusive(spark, d):
    return besthit.near_top(tb.hits(spark, d)).select("qseqid", "sseqid", "pident", "bitscore")


@query(f"WITH {tb.HITS_SQL} SELECT qseqid, sseqid, pident, bitscore FROM (SELECT *, max(bitscore) OVER (PARTITION BY qseqid) AS top FROM hits) WHERE bitscore > top * 0.9::DOUBLE")
def near_top_strict(spark, d):
    return besthit.near_top(tb.hits(spark, d), strict=True).select("qseqid", "sseqid", "pident", "bitscore")


@query(f"WITH {tb.HITS_SQL} SELECT qseqid, sseqid, bitscore, rank FROM (SELECT *, {_BEST} FROM hits) WHERE rank <= 5")
def topk_hits(spark, d):
    return besthit.top_k(tb.hits(spark, d), 5).select("qseqid", "sseqid", "bitscore", "rank")


_AAI = f"""{tb.HITS_SQL},
g AS (SELECT *, regexp_replace(qseqid, '_[^_]*$', '') AS query, regexp_replace(sseqid, '_[^_]*$', '') AS target FROM hits),
o AS (SELECT query, target, pident FROM (SELECT *, row_number() OVER (PARTITION BY query, target, qseqid ORDER BY bitscore DESC, pident DESC, sseqid) AS rn FROM g) WHERE rn = 1),
qs AS (SELECT query, count(DISTINCT qseqid) AS qgenes FROM g GROUP BY 1), ts AS (SELECT target, count(DISTINCT sseqid) AS tgenes FROM g GROUP BY 1),
p AS (SELECT query, target, avg(pident) AS aai, count(*) AS sgenes FROM o GROUP BY 1, 2),
aai AS (SELECT query, target, aai, sgenes, 100.0::DOUBLE * sgenes / qgenes AS qcov, 100.0::DOUBLE * sgenes / tgenes AS tcov, qgenes, tgenes FROM p JOIN qs USING (query) JOIN ts USING (target))"""""


def _pairs(spark, d):
    h = tb.hits(spark, d)
    q = pairs.genome_sizes(h.select(F.col("qseqid").alias("orf_id")))
    t = pairs.genome_sizes(h.select(F.col("sseqid").alias("orf_id")))
    return pairs.amino_acid_identity(h, q, t)


@query(f"WITH {_AAI} SELECT query, target, round(aai, 6) AS aai, sgenes, round(qcov, 6) AS qcov, round(tcov, 6) AS tcov, qgenes, tgenes FROM aai")
def aai_pairs(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _pairs(spark, d).select("query", "target", r("aai"), "sgenes", r("qcov"), r("tcov"), "qgenes", "tgenes")


@query(f"WITH {_AAI} SELECT query, target, round(score, 6) AS score FROM (SELECT *, aai / 100 * greatest(qcov, tcov) / 100 AS score FROM aai WHERE aai >= 50 AND (qcov >= 60 OR tcov >= 60 OR sgenes >= 7))")
def edge_filter_score(spark, d):
    return pairs.edges(_pairs(spark, d), 50, 60, 7).select("query", "target", F.round("score", 6).alias("score"))


@query(f"WITH {tb.HITS_SQL} SELECT regexp_replace(qseqid, '_[^_]*$', '') AS qname, regexp_replace(sseqid, '_[^_]*$', '') AS tname, count(*) AS num_alns, ((2 * sum(CAST(length AS HUGEINT) * CAST(round(pident * 1000000) AS HUGEINT)) + sum(length) * 10000) // (2 * sum(length) * 10000)) / 100.0::DOUBLE AS pid FROM hits GROUP BY 1, 2")
def weighted_identity(spark, d):
    h = tb.hits(spark, d).select(fn.genome_of(F.col("qseqid")).alias("qname"), fn.genome_of(F.col("sseqid")).alias("tname"), "length", "pident")
    return pairs.weighted_identity(h, ["qname", "tname"])


@query(f"""WITH {tb.INTERVALS_SQL}, m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM iv),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(sum(b - a + 1) AS BIGINT) AS covered FROM (SELECT user_id, island, min(start) AS a, max(stop) AS b FROM i GROUP BY 1, 2) GROUP BY 1""")
def interval_coverage(spark, d):
    return pairs.interval_union(tb.intervals(spark, d), ["user_id"])


@query("""WITH s AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents), b AS (SELECT item_id AS id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM benchmark),
sx AS (SELECT DISTINCT id, substr(t, CAST(i AS BIGINT), 24) AS seed FROM (SELECT id, t, unnest(range(1, length(t) - 22)) AS i FROM s WHERE length(t) >= 24)),
bx AS (SELECT DISTINCT id, substr(t, CAST(i AS BIGINT), 24) AS seed FROM (SELECT id, t, unnest(range(1, length(t) - 22)) AS i FROM b WHERE length(t) >= 24))
SELECT sx.id AS a_id, bx.id AS b_id, count(*) AS seeds FROM sx JOIN bx USING (seed) GROUP BY 1, 2 HAVING count(*) >= 5""")
def seed_similarity_join(spark, d):
    clean = F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("seq")
    a, b = tb.table(spark, d, "documents").select(F.col("doc_id").alias("id"), clean), tb.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), clean)
    return pairs.seed_join(a, b, 24, 5)


@query(f"WITH {tb.SHARED_SQL} SELECT a, b, lines FROM shared")
def self_similarity_pairs(spark, d):
    return tb.shared_lines(spark, d)


_KMER = "list_filter(list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, CAST(i AS BIGINT), {k})), lambda x: true)"


@query(f"WITH {tb.CONTIGS_SQL}, k AS (SELECT accession AS id, length(seq) - 1 AS n, unnest({_KMER.format(k=4)}) AS kmer FROM contigs WHERE length(seq) >= 4) SELECT id, kmer, count(*) AS n, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS freq FROM k GROUP BY id, kmer")
def tetranuc_freq(spark, d):
    f = kmers.frequencies(tb.contigs(spark, d).select(F.col("accession").alias("id"), "seq"))
    return f.select("id", "kmer", "n", F.round("freq", 6).alias("freq"))


@query(f"WITH {tb.CONTIGS_SQL}, k AS (SELECT accession AS id, unnest({_KMER.format(k=21)}) AS kmer FROM contigs WHERE length(seq) >= 21) SELECT id, round(count(*) / CAST(count(DISTINCT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))) AS DOUBLE), 2) AS kmer_freq FROM k GROUP BY id")
def canonical_kmer_depth(spark, d):
    return kmers.canonical_depth(tb.contigs(spark, d).select(F.col("accession").alias("id"), "seq")).where("kmer_freq is not null")


@query(f"WITH {tb.NODES_SQL} SELECT taxid, ancestor, depth FROM tree")
def lineage_closure(spark, d):
    return taxonomy.closure(tb.nodes(spark, d)).select("taxid", "ancestor", F.col("depth").cast("int").alias("depth"))


_LCA = f"""{tb.NODES_SQL}, {tb.TAX_HITS_SQL},
ob AS (SELECT contig, orf, max(bitscore) AS bits FROM th GROUP BY 1, 2), hn AS (SELECT orf, count(DISTINCT taxid) AS n FROM th GROUP BY 1),
pa AS (SELECT orf, ancestor, depth, count(DISTINCT th.taxid) AS k FROM th JOIN tree ON tree.taxid = th.taxid GROUP BY 1, 2, 3),
lca AS (SELECT contig, orf, max_by(ancestor, depth) AS lca, max(bits) AS bits FROM pa JOIN hn USING (orf) JOIN ob USING (orf) WHERE k = n GROUP BY 1, 2)"""


def _tree(spark, d):
    return taxonomy.closure(tb.nodes(spark, d))


def _orf_lca(spark, d, tree):
    h = besthit.near_top(tb.tax_hits(spark, d)).select(F.concat_ws("|", "contig", "qseqid").alias("orf"), F.col("sseqid").alias("taxid"), "bitscore")
    r = taxonomy.orf_lca(h, tree)
    return r.select(F.substring_index("orf", "|", 1).alias("contig"), F.substring_index("orf", "|", -1).alias("orf"), "lca", "bits")


@query(f"WITH {_LCA} SELECT orf, lca, bits FROM lca")
def orf_lca(spark, d):
    return _orf_lca(spark, d, _tree(spark, d)).select("orf", "lca", "bits")


_WLCA = f"""{_LCA}, tot AS (SELECT contig, sum(bits) AS total FROM lca WHERE lca IS NOT NULL GROUP BY 1),
sc AS (SELECT contig, ancestor, max(depth) AS depth, sum(bits) / any_value(total) AS score FROM lca JOIN tree ON tree.taxid = lca.lca JOIN tot USING (contig) GROUP BY 1, 2),
lin AS (SELECT c.contig, c.ancestor AS taxid, c.depth, sum(w.score) AS along FROM sc c JOIN tree t ON t.taxid = c.ancestor JOIN sc w ON w.contig = c.contig AND w.ancestor = t.ancestor WHERE c.score > 0.1 GROUP BY ALL),
top AS (SELECT contig, taxid FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY depth DESC, round(along, 9) DESC, taxid DESC) AS rn FROM lin) WHERE rn = 1),
wl AS (SELECT sc.* FROM top JOIN tree USING (taxid) JOIN sc ON sc.contig = top.contig AND sc.ancestor = tree.ancestor)"""


def _paths(spark, d):
    tree = _tree(spark, d)
    o = _orf_lca(spark, d, tree).select("contig", F.col("lca").alias("taxid"), "bits")
    return taxonomy.weighted_lca(o, tree, 0.1)


@query(f"WITH {_WLCA} SELECT contig, ancestor, CAST(depth AS INT) AS depth, round(score, 6) AS score FROM wl")
def weighted_lca(spark, d):
    return _paths(spark, d).select("contig", "ancestor", F.col("depth").cast("int").alias("depth"), F.round("score", 6).alias("score"))


@query(f"""WITH {tb.NODES_SQL} SELECT taxid, string_agg(rank || ':' || name, ';' ORDER BY depth) AS lineage, string_agg(printf('%.2f', 1.0 / depth), ';' ORDER BY depth) AS scores
FROM (SELECT tree.taxid, depth, n.rank, n.name FROM tree JOIN nodes n ON n.taxid = tree.ancestor WHERE n.rank <> 'no rank') GROUP BY taxid""")
def lineage_string(spark, d):
    path = _tree(spark, d).select(F.col("taxid").alias("contig"), "ancestor", "depth", (F.lit(1.0) / F.col("depth")).alias("score"))
    return taxonomy.lineage_strings(path, tb.nodes(spark, d).select("taxid", "rank", "name"), "root").withColumnRenamed("contig", "taxid")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, coalesce(p_name, 'hypothetical protein (no hit)') AS annotation, coalesce(p_brand, '-') AS brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) p ON l_partkey = p_partkey""")
def map_lookup_default(spark, d):
    p = tb.table(spark, d, "part").where("p_partkey % 3 <> 0").withColumnRenamed("p_partkey", "l_partkey")
    x = evidence.lookup(tb.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), p, "l_partkey", "p_name", annotation.NO_HIT)
    x = evidence.lookup(x, p, "l_partkey", "p_brand")
    return x.select("l_orderkey", "l_partkey", "l_linenumber", F.col("p_name").alias("annotation"), F.col("p_brand").alias("brand"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS accession, n_chars AS length, coalesce(CAST(quality AS VARCHAR), CASE WHEN n_chars < 3000 THEN 'filtered by length' ELSE '-' END) AS pred FROM documents d LEFT JOIN labels l USING (doc_id)")
def anti_reason(spark, d):
    c = tb.contigs(spark, d).select("accession", "length")
    lab = tb.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("accession"), F.col("quality").alias("pred"))
    return evidence.with_reason(c, lab, "accession", "pred", 3000)


@query(f"""WITH {tb.CALLS_SQL}, a AS (SELECT accession, length, score FROM calls WHERE length >= 3000), b AS (SELECT CAST(doc_id AS VARCHAR) AS accession, n_chars AS length, quality FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CAST(doc_id AS VARCHAR) AS accession, n_chars AS length, lang FROM documents WHERE doc_id % 3 = 0), e AS (SELECT CAST(doc_id AS VARCHAR) AS accession, n_chars AS length, source FROM documents WHERE doc_id % 4 = 1)
SELECT accession, length, coalesce(CAST(CAST(round(score * 100) AS INT) AS VARCHAR), '-') AS score, coalesce(CAST(quality AS VARCHAR), '-') AS quality, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source
FROM a FULL JOIN b USING (accession, length) FULL JOIN c USING (accession, length) FULL JOIN e USING (accession, length)""")
def outer_summary(spark, d):
    c, doc = tb.calls(spark, d), tb.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("accession"), F.col("n_chars").alias("length"), "lang", "source")
    a = c.where("length >= 3000").select("accession", "length", F.round(F.col("score") * 100).cast("int").alias("score"))
    b = doc.join(tb.table(spark, d, "labels"), "doc_id").select("accession", "length", "quality")
    return evidence.summary([a, b, doc.where("doc_id % 3 = 0").select("accession", "length", "lang"), doc.where("doc_id % 4 = 1").select("accession", "length", "source")], ["accession", "length"])


@query("""SELECT CAST(l.doc_id AS VARCHAR) AS accession, CASE WHEN contains(coalesce(lang || ':' || source, ''), 'en:src1') OR contains(coalesce(lang || ':' || source, ''), 'de') THEN 'Y' ELSE 'N' END AS prokaryotic,
CASE WHEN contains(coalesce(lang || ':' || source, ''), 'en:src1') OR contains(coalesce(lang || ':' || source, ''), 'de') THEN CASE WHEN toxic = 1 THEN 'temperate' ELSE 'virulent' END ELSE '-' END AS type FROM labels l LEFT JOIN documents d USING (doc_id)""")
def lifestyle_mask(spark, d):
    lab = tb.table(spark, d, "labels").join(tb.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", "left")
    lab = models.lifestyle(lab.withColumn("logits", F.array(1 - 2.0 * F.col("toxic"), 2.0 * F.col("toxic") - 1)))
    ok = evidence.any_substring(F.concat("lang", F.lit(":"), "source"), ["en:src1", "de"])
    return lab.select(F.col("doc_id").cast("string").alias("accession"), ok.alias("prokaryotic"), F.when(ok == "Y", F.col("type")).otherwise("-").alias("type"))


@query(f"WITH {tb.EVIDENCE_SQL} SELECT accession, host, score, method FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY priority, score DESC, host) AS rn FROM ev) WHERE rn = 1")
def evidence_precedence(spark, d):
    return evidence.by_precedence(tb.evidence_rows(spark, d)).select("accession", "host", "score", "method")


@query(f"WITH {tb.EVIDENCE_SQL} SELECT accession, host, method, max(score) AS score FROM ev GROUP BY 1, 2, 3 ORDER BY accession, score DESC")
def evidence_multi(spark, d):
    ev = tb.evidence_rows(spark, d)
    a, b = ev.where("priority = 1").withColumn("cov", F.lit(1.0)), ev.where("priority > 1")
    return evidence.multi(a, b).select("accession", "host", "method", "score").orderBy("accession", F.col("score").desc())


@query("""SELECT c_custkey, coalesce(a.n_name, b.r_name, '-') AS lineage FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) a ON a.n_nationkey = c_nationkey
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 0) b ON b.n_nationkey = c_nationkey""")
def lineage_fallback(spark, d):
    n = tb.table(spark, d, "nation")
    r = n.where("n_nationkey % 3 = 0").join(tb.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = tb.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return evidence.fallback(c, [("c_nationkey", n.where("n_nationkey % 2 = 0"), "n_nationkey", "n_name"), ("c_nationkey", r, "n_nationkey", "r_name")], "lineage").select("c_custkey", "lineage")


_GATE = """cs AS (SELECT c_custkey, s_suppkey, c_nationkey, s_nationkey, cn.n_regionkey AS cr, sn.n_regionkey AS sr FROM customer JOIN supplier ON s_suppkey = c_custkey % 50 JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey)"""


@query(f"WITH {_GATE} SELECT c_custkey, CASE WHEN c_custkey = s_suppkey THEN 'genome' WHEN c_nationkey = s_nationkey THEN 'genus' WHEN cr = sr THEN 'family' END AS agreed FROM cs")
def agreement_gate(spark, d):
    n = tb.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = tb.table(spark, d, "customer").join(n.toDF("cn", "family_host"), F.col("cn") == F.col("c_nationkey"))
    s = tb.table(spark, d, "supplier").join(n.toDF("sn", "family_other"), F.col("sn") == F.col("s_nationkey"))
    j = c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 50)
    j = j.select("c_custkey", F.col("c_custkey").alias("host"), F.col("s_suppkey").alias("other"), F.col("c_nationkey").alias("genus_host"), F.col("s_nationkey").alias("genus_other"), "family_host", "family_other")
    return evidence.agreement(j, ("genus", "family")).select("c_custkey", "agreed")


@query("SELECT doc_id, CASE WHEN n_chars > 12500 THEN 1 WHEN n_chars > 7500 THEN 2 WHEN n_chars > 4000 THEN 3 WHEN n_chars > 2000 THEN 4 WHEN n_chars > 4 THEN 5 END AS model FROM documents")
def length_bins(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", kmers.length_model(F.col("n_chars")).alias("model"))


@query("""WITH q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id AS ref, embedding AS r FROM embeddings),
s AS (SELECT vec_id, ref, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i]::DOUBLE * r[i]::DOUBLE)) AS score FROM q, r WHERE vec_id <> ref)
SELECT vec_id AS id, arg_max(ref, score) AS best, round(max(score), 5) AS score FROM s GROUP BY 1""")
def vector_argmax(spark, d):
    e = tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return kmers.vector_argmax(e.where("id % 50 = 0"), e, skip_same=True).select("id", "best", F.round("score", 5).alias("score"))


@query(f"WITH {tb.SHARED_SQL}, {tb.COMPONENTS_SQL} SELECT node, component FROM reach")
def components(spark, d):
    return graph.components(tb.shared_lines(spark, d))


@query()
def greedy_clusters(spark, d):
    c = tb.contigs(spark, d).select(F.col("accession").cast("bigint").alias("node"), "length")
    e = tb.shared_lines(spark, d)
    return graph.greedy_clusters(c, e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select("b", "a").where("b % 2 = 0")))


@query()
def mcl_clusters(spark, d):
    e = tb.shared_lines(spark, d)
    return graph.markov_clusters(e.select("a", "b", F.col("lines").cast("double").alias("w")))


def _members(spark, d):
    doc = tb.table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("n_chars").alias("length"), "lang", "source")
    ref = F.col("node") % 4 == 0
    m = graph.components(tb.shared_lines(spark, d)).join(doc, "node")
    return m.select(F.col("component").alias("cluster"), "node", "length", ref.alias("is_ref"), F.when(F.col("node") % 3 != 0, F.col("lang")).alias("genus"), F.when(F.col("node") % 5 != 0, F.concat("lang", F.lit(":"), "source")).alias("lineage"))


_MEMBERS = f"""{tb.SHARED_SQL}, {tb.COMPONENTS_SQL}, mem AS (SELECT component AS cluster, node, n_chars AS length, node % 4 = 0 AS is_ref, CASE WHEN node % 3 <> 0 THEN lang END AS genus, CASE WHEN node % 5 <> 0 THEN lang || ':' || source END AS lineage FROM reach JOIN documents ON doc_id = node)"""


@query(f"""WITH {_MEMBERS}, x AS (SELECT cluster, max(is_ref) AS refs, count(DISTINCT CASE WHEN is_ref THEN genus END) AS genera, max(CASE WHEN is_ref THEN genus END) AS one_genus,
  first(lineage ORDER BY length DESC, node) FILTER (WHERE lineage IS NOT NULL) AS ll, first(genus ORDER BY length DESC, node) FILTER (WHERE lineage IS NOT NULL) AS lg,
  first(lineage ORDER BY length DESC, node) FILTER (WHERE is_ref AND genus IS NOT NULL) AS rl FROM mem GROUP BY 1)
SELECT cluster, node, CASE WHEN is_ref THEN genus WHEN NOT refs THEN lg WHEN genera = 1 THEN one_genus ELSE genus END AS new_genus, CASE WHEN is_ref THEN lineage WHEN NOT refs THEN ll WHEN genera = 1 THEN rl ELSE lineage END AS new_lineage FROM mem JOIN x USING (cluster)""")
def cluster_propagate(spark, d):
    return graph.propagate(_members(spark, d)).select("cluster", "node", "new_genus", "new_lineage")


@query(f"""WITH {tb.SHARED_SQL}, {tb.COMPONENTS_SQL}, al AS (SELECT doc_id AS node, coalesce(component, doc_id) AS cluster FROM documents LEFT JOIN reach ON node = doc_id),
sz AS (SELECT cluster, count(*) AS size FROM al GROUP BY 1), no AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS no FROM sz WHERE size > 1)
SELECT node, cluster, size, coalesce('group_' || no, 'singleton') AS name FROM al JOIN sz USING (cluster) LEFT JOIN no USING (cluster)""")
def cluster_names(spark, d):
    c = graph.components(tb.shared_lines(spark, d)).withColumnRenamed("node", "doc_id")
    every = tb.table(spark, d, "documents").select("doc_id").join(c, "doc_id", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "doc_id").alias("cluster"))
    return graph.number_clusters(every)


@query(f"""WITH {tb.GENES_SQL}, w AS (SELECT accession, gene_no, avg(CASE WHEN label <> 0 THEN label END) OVER (PARTITION BY accession ORDER BY gene_no ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS a,
  avg(CASE WHEN label <> 0 THEN label END) OVER (PARTITION BY accession ORDER BY gene_no ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS b FROM genes)
SELECT accession, gene_no, round(coalesce(abs(a - b) * sign(a - b), 0), 6) AS delta FROM w""")
def gene_windows_delta(spark, d):
    return regions.window_delta(tb.genes(spark, d)).select("accession", "gene_no", "delta")


@query("""WITH g AS (SELECT doc_id, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS viral, count(*) FILTER (WHERE toxic = 1) AS host, max(n_chars) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN n > 8000 THEN 'Low quality' WHEN viral = 0 AND host > 0 THEN 'Low quality' WHEN host > viral AND viral > 0 THEN 'Medium quality' WHEN (n % 100) / 50.0::DOUBLE < 1.25 THEN 'High quality' ELSE 'Medium quality' END AS quality FROM g""")
def quality_ladder(spark, d):
    g = tb.table(spark, d, "documents").join(tb.table(spark, d, "labels"), "doc_id").groupBy("doc_id").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("viral"), F.count_if(F.col("toxic") == 1).alias("host"), F.max("n_chars").alias("n"))
    return g.select("doc_id", regions.quality((F.col("n") > 8000).cast("int"), F.col("viral"), F.col("host"), F.col("n") % 100 / 50).alias("quality"))


_REG = "r AS (SELECT CAST(user_id AS VARCHAR) AS accession, CASE WHEN event_id % 3 = 0 THEN 'host' ELSE 'viral' END AS type, CAST(event_id * 10 AS INT) AS start_pos, CAST(event_id * 10 + 5 + event_id % 4 AS INT) AS end_pos, CAST(6 + event_id % 4 AS INT) AS length FROM events)"


@query(f"""WITH {_REG} SELECT accession, CAST(sum(CASE WHEN type = 'host' THEN length ELSE 0 END) AS BIGINT) AS host_length, CAST(sum(CASE WHEN type = 'viral' THEN length ELSE 0 END) AS BIGINT) AS viral_length,
round(100.0::DOUBLE * sum(CASE WHEN type = 'host' THEN length ELSE 0 END) / sum(length), 2) AS contamination, string_agg(type || ':' || start_pos || '-' || end_pos, ';' ORDER BY start_pos, end_pos, type) AS regions FROM r GROUP BY 1""")
def region_table(spark, d):
    e = tb.table(spark, d, "events")
    r = e.select(F.col("user_id").cast("string").alias("accession"), F.when(F.col("event_id") % 3 == 0, "host").otherwise("viral").alias("type"), (F.col("event_id") * 10).cast("int").alias("start_pos"), (F.col("event_id") * 10 + 5 + F.col("event_id") % 4).cast("int").alias("end_pos"), (6 + F.col("event_id") % 4).cast("int").alias("length"))
    return regions.region_summary(r)


@query()
def define_regions(spark, d):
    return regions.define_regions(tb.genes(spark, d))


@query(f"WITH {tb.ALIGNMENTS_SQL} SELECT id, string_agg(aln, '' ORDER BY marker) AS aln FROM msa GROUP BY id HAVING count(DISTINCT marker) = (SELECT count(DISTINCT marker) FROM msa)")
def msa_intersection(spark, d):
    return msa.intersection(tb.alignments(spark, d))


@query(f"""WITH {tb.ALIGNMENTS_SQL}, w AS (SELECT marker, max(length(aln)) AS width FROM msa GROUP BY 1), i AS (SELECT DISTINCT id FROM msa)
SELECT i.id, string_agg(coalesce(msa.aln, repeat('-', width)), '' ORDER BY w.marker) AS aln FROM i CROSS JOIN w LEFT JOIN msa ON msa.id = i.id AND msa.marker = w.marker GROUP BY i.id""")
def msa_union(spark, d):
    return msa.union(tb.alignments(spark, d))


_LINEAGE = "li AS (SELECT doc_id, unnest(['realm', 'family', 'genus']) AS rank, unnest([lang, source, 'g' || (doc_id % 7)]) AS name FROM documents)"


def _lineage_rows(spark, d):
    doc = tb.table(spark, d, "documents")
    text = F.concat_ws(";", F.concat(F.lit("realm:"), "lang"), F.concat(F.lit("family:"), "source"), F.concat(F.lit("genus:g"), F.col("doc_id") % 7))
    return ranks.explode_lineage(doc.select("doc_id", text.alias("lineage"), F.lit("1.00;0.90;0.60").alias("scores")), "doc_id", "lineage", "scores")


@query("SELECT doc_id, lang AS realm, source AS family, 'g' || (doc_id % 7) AS genus, 'NA' AS species FROM documents")
def rank_pivot(spark, d):
    return ranks.pivot_ranks(_lineage_rows(spark, d), "doc_id", ["realm", "family", "genus", "species"])


@query(f"""WITH {_LINEAGE} SELECT doc_id, rank AS "column", name AS value FROM li WHERE (rank = 'realm' AND name NOT IN ('en', 'de')) OR (rank = 'family' AND NOT regexp_matches(name, '^src[0-9]$')) OR (rank = 'genus' AND name NOT IN ('g1', 'g2', 'g3', 'g4', 'g5', 'g6'))""")
def name_validation(spark, d):
    names = [("realm", "en"), ("realm", "de"), *[("family", f"src{i}") for i in range(10)], *[("genus", f"g{i}") for i in range(1, 7)]]
    valid = spark.createDataFrame(names, "rank string, name string")
    wide = ranks.pivot_ranks(_lineage_rows(spark, d), "doc_id", ["realm", "family", "genus"])
    return ranks.invalid_names(wide, "doc_id", ["realm", "family", "genus"], valid)


@query(f"""WITH {tb.ORFS_SQL}, x AS (SELECT orf_id, size % 5 AS c FROM orfs) SELECT regexp_replace(orf_id, '_[^_]*$', '') AS accession, count(*) AS proteins, count(*) FILTER (WHERE c IN (1, 2, 3)) AS annotated, round(count(*) FILTER (WHERE c IN (1, 2, 3)) / CAST(count(*) AS DOUBLE), 2) AS rate FROM x GROUP BY 1""")
def annotation_rate(spark, d):
    o = tb.orfs(spark, d)
    best = o.where("size % 5 > 0").select(F.col("orf_id").alias("qseqid"), F.expr("concat('p', size % 5)").alias("sseqid"), F.lit(90.0).alias("pident"), F.lit(1.0).alias("coverage"))
    names = spark.createDataFrame([("p1", "terminase"), ("p2", "portal"), ("p3", "holin")], "protein string, description string")
    return annotation.annotation_rate(annotation.annotate(o.select("orf_id"), best, F.broadcast(names)))


@query(f"""WITH {tb.CALLS_SQL} SELECT accession,
 CASE WHEN score IS NOT NULL THEN CASE WHEN score < 0.5 OR proportion < 0.1 THEN 'non-virus' ELSE 'virus' END WHEN length < 3000 THEN 'filtered by length' WHEN proportion < 0.1 THEN 'non-virus' ELSE 'virus' END AS pred,
 round(CASE WHEN score IS NOT NULL THEN CASE WHEN score < 0.5 THEN score WHEN proportion < 0.1 THEN proportion ELSE score END WHEN length < 3000 THEN 0 WHEN proportion < 0.1 THEN 0 ELSE proportion END, 6) AS call_score,
 CASE WHEN score IS NULL AND length < 3000 THEN '{models.REJECTED}' WHEN proportion < 0.1 THEN '{models.LOW_SHARE}' WHEN score < 0.5 THEN '{models.LOW_SCORE}'
   WHEN score IS NOT NULL THEN CASE WHEN (proportion + score) / 2 > 0.8 THEN '{models.HIGH}' WHEN (proportion + score) / 2 > 0.6 THEN '{models.MEDIUM}' ELSE '{models.LOW}' END
   WHEN proportion > 0.75 THEN '{models.HIGH}' WHEN proportion > 0.25 THEN '{models.MEDIUM}' ELSE '{models.LOW}' END AS confidence FROM calls""")
def virus_call(spark, d):
    return models.virus_call(tb.calls(spark, d)).select("accession", "pred", F.round("call_score", 6).alias("call_score"), "confidence")


@query(f"""WITH {tb.HITS_SQL}, nt AS (SELECT * FROM (SELECT *, max(bitscore) OVER (PARTITION BY qseqid) AS top FROM hits) WHERE bitscore > top * 0.9::DOUBLE AND regexp_matches(sseqid, '[02468]$')),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, pident DESC, sseqid) AS rn FROM nt) WHERE rn = 1),
t AS (SELECT regexp_replace(qseqid, '_[^_]*$', '') AS accession, CAST(string_split(qseqid, '_')[-1] AS BIGINT) AS i, CAST(string_split(sseqid, '_')[-1] AS INT) + 1 AS t FROM o)
SELECT accession, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY i, t) AS text FROM t GROUP BY 1""")
def token_sentence(spark, d):
    h = tb.hits(spark, d)
    voc = h.select(F.col("sseqid").alias("protein")).distinct().where(F.col("protein").rlike("[02468]$")).withColumn("token", fn.orf_index(F.col("protein")).cast("int"))
    return models.sentences(h, voc).select("accession", models.sentence_text(F.col("tokens")).alias("text"))


@query("SELECT DISTINCT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark, d):
    return tb.table(spark, d, "part").select(F.col("p_partkey").alias("key")).subtract(tb.table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return tb.table(spark, d, "customer").select(F.col("c_custkey").alias("key")).intersect(tb.table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_custkey AS key FROM customer UNION SELECT s_suppkey FROM supplier")
def set_union(spark, d):
    return tb.table(spark, d, "customer").select(F.col("c_custkey").alias("key")).union(tb.table(spark, d, "supplier").select("s_suppkey")).distinct()


@query(f"""WITH {_AAI}, e AS (SELECT query AS source, target, round(aai / 100 * greatest(qcov, tcov) / 100, 6) AS weight, 0 AS part FROM aai WHERE aai >= 50 AND (qcov >= 60 OR tcov >= 60 OR sgenes >= 7) UNION ALL SELECT query, target, 1.0, 1 FROM aai WHERE sgenes >= 5)
SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY part, weight DESC) AS rn FROM e) WHERE rn = 1""")
def node_edge_tables(spark, d):
    p = _pairs(spark, d)
    own = pairs.edges(p, 50, 60, 7).select(F.col("query").alias("source"), "target", F.round("score", 6).alias("weight"))
    return graph.edge_table(own, p.where("sgenes >= 5").select(F.col("query").alias("source"), "target", F.lit(1.0).alias("weight")))


@query("""SELECT doc_id, 's__' || lang || source AS species, 'g__' || lang AS genus, CASE WHEN doc_id % 2 = 0 THEN 'f__' || source END AS family FROM documents""")
def rank_extract(spark, d):
    c = F.concat(F.lit("d__B;f__"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.lit(";g__"), "lang", F.lit(";s__"), "lang", "source").alias("c")
    t = tb.table(spark, d, "documents").select("doc_id", c)
    return t.select("doc_id", *[fn.gtdb_rank(F.col("c"), p + "__").alias(n) for p, n in (("s", "species"), ("g", "genus"), ("f", "family"))])


_SPACER = "sp AS (SELECT 'c' || (l_orderkey % 500) AS qseqid, 'm' || (l_suppkey % 30) || '_CRISPR_' || l_linenumber AS sseqid, 50 + l_quantity AS pident, CAST(l_partkey % 40 AS INT) AS length, 36 AS slen FROM lineitem)"


def _spacers(spark, d):
    return tb.table(spark, d, "lineitem").select(F.expr("concat('c', l_orderkey % 500)").alias("qseqid"), F.expr("concat('m', l_suppkey % 30, '_CRISPR_', l_linenumber)").alias("sseqid"), (50 + F.col("l_quantity")).alias("pident"), (F.col("l_partkey") % 40).cast("int").alias("length"), F.lit(36).alias("slen"))


@query(f"""WITH {_SPACER} SELECT qseqid AS accession, string_split(sseqid, '_CRISPR_')[1] AS host, round(pident / 100, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, length / CAST(slen AS DOUBLE) DESC, sseqid) AS rn FROM sp WHERE length / CAST(slen AS DOUBLE) > 0.9::DOUBLE AND pident > 90) WHERE rn = 1""")
def host_by_spacer(spark, d):
    return evidence.crispr(_spacers(spark, d), 90, 90).select("accession", "host", F.round("score", 6).alias("score"))


@query("""SELECT accession, host, round(score, 6) AS score FROM (SELECT 'c' || (o_orderkey % 700) AS accession, 'm' || (o_custkey % 40) AS host, (o_orderkey % 100) / 100.0::DOUBLE AS score,
row_number() OVER (PARTITION BY o_orderkey % 700 ORDER BY CAST(o_totalprice / 10 AS INT) DESC, o_orderkey % 100 DESC, 'm' || (o_custkey % 40)) AS rn FROM orders WHERE CAST(o_totalprice / 10 AS INT) >= 1000) WHERE rn = 1""")
def host_by_prophage(spark, d):
    h = tb.table(spark, d, "orders").select(F.expr("concat('c', o_orderkey % 700)").alias("qseqid"), F.expr("concat('m', o_custkey % 40)").alias("mag"), F.round(F.col("o_totalprice") / 10).cast("int").alias("length"), (F.col("o_orderkey") % 100).cast("double").alias("pident"))
    return evidence.prophage(h, 1000).select("accession", "host", F.round("score", 6).alias("score"))


@query("""SELECT genome, sseqid, round(cov, 6) AS cov, pident FROM (SELECT *, row_number() OVER (PARTITION BY genome ORDER BY cov DESC, pident DESC, sseqid, qseqid) AS rn FROM
(SELECT 'c' || (l_orderkey % 300) AS genome, 'c' || (l_orderkey % 300) || '_' || l_linenumber AS qseqid, 'k' || (l_partkey % 9) AS sseqid, l_quantity * 2 AS pident, 100 * greatest(l_quantity / 60, l_quantity / 75) AS cov FROM lineitem)) WHERE rn = 1 AND cov > 50 AND pident > 25""")
def marker_selection(spark, d):
    h = tb.table(spark, d, "lineitem").select(F.expr("concat('c', l_orderkey % 300)").alias("genome"), F.expr("concat('c', l_orderkey % 300, '_', l_linenumber)").alias("qseqid"), F.expr("concat('k', l_partkey % 9)").alias("sseqid"), (F.col("l_quantity") * 2).alias("pident"), F.col("l_quantity").alias("length"), F.lit(60).alias("qlen"), F.lit(75).alias("slen"))
    return besthit.marker_best(h, 25, 50).select("genome", "sseqid", F.round("cov", 6).alias("cov"), "pident")


@query("""WITH g AS (SELECT DISTINCT doc_id AS node FROM documents), c AS (SELECT doc_id AS node, doc_id % 11 AS cluster_no FROM documents WHERE doc_id % 2 = 0)
SELECT node, CAST(cluster_no AS BIGINT) AS cluster_no FROM c UNION ALL SELECT node, (SELECT max(cluster_no) FROM c) + row_number() OVER (ORDER BY node) FROM g WHERE node NOT IN (SELECT node FROM c)""")
def continuous_ids(spark, d):
    doc = tb.table(spark, d, "documents").select(F.col("doc_id").alias("node"))
    return evidence.continuous_ids(doc.where("node % 2 = 0").withColumn("cluster_no", F.col("node") % 11), doc)


@query(f"""WITH {tb.SHARED_SQL}, {tb.COMPONENTS_SQL} SELECT component, count(*) AS size FROM reach WHERE component IN (SELECT component FROM reach WHERE node % 3 = 0) GROUP BY 1 ORDER BY size DESC, component LIMIT 10""")
def largest_components(spark, d):
    labels = graph.components(tb.shared_lines(spark, d))
    return graph.largest_components(labels, labels.where("node % 3 = 0").select("node"))


@query("SELECT CAST(doc_id AS VARCHAR) AS accession, 'host of ' || lang AS host, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.6 END AS score FROM documents WHERE lang IN ('en', 'de')")
def host_by_genus(spark, d):
    doc = tb.table(spark, d, "documents")
    calls = doc.select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("genus"), F.when(F.col("doc_id") % 3 != 0, F.lit("0.90;0.60")).alias("scores"))
    return evidence.by_genus(calls, spark.createDataFrame([("en", "host of en"), ("de", "host of de")], "genus string, host string"))
