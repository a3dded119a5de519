"""More registered queries: similarity search with alignment, gene calls, hosts by fitted densities. Same form as catalog.py."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqlake import cache
from seqlake import functions as fn
from seqlake.operators import genes, kmers, network, pairs, similarity, transformer
from seqlake.plans import tasks
from seqlake.plans import testbed as tb
from seqlake.plans.catalog import query
from seqlake.storage import materialize, scratch_dir

_K, _W, _LEAST, _WIDTH = 8, 5, 3, 32
_SCORING = similarity.Scoring(2, -3, 5, 2, 26)
_SCALE, _EVALUE = _SCORING.scale, 1e-12

#: Benchmark items, with letters changed and left out, against all documents.
_SEQUENCES = """q AS (SELECT item_id AS id, replace(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'wv', 'vf'), 'tion', 'tn') AS seq FROM benchmark),
t AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq FROM documents)"""


def _seeds_sql(side: str) -> str:
    high, low = ("(" + " + ".join(f"c[i + {j}] * {x}" for j, x in enumerate(weights)) + f") % {similarity.PRIME}" for weights in similarity.seed_weights(_K))
    key = f"CAST({high} AS BIGINT) * 2147483648 + {low}"
    return f"""{side}k AS (SELECT id, n, unnest(range(1, n + 1)) AS pos, unnest(list_transform(range(1, n + 1), lambda i: {key})) AS key FROM (SELECT id, length(seq) - {_K - 1} AS n, list_transform(string_split(seq, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS c FROM {side} WHERE length(seq) >= {_K})),
{side}m AS (SELECT *, CASE WHEN pos <= greatest(n - {_W - 1}, 1) THEN min(key) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) END AS low FROM {side}k),
{side}s AS (SELECT id, pos, key FROM (SELECT *, max(low) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW) AS top FROM {side}m) WHERE top = key)"""


_ZERO = "{'m': 0, 'l': 0, 'g': 0, 'a': 0, 'b': 0}"
_PACK = "((((((CAST(closed + 2 * j AS HUGEINT) * 262144 + j) * 4096 + cst.m) * 8192 + cst.l) * 256 + cst.g) * 4096 + cst.a) * 262144 + cst.b)"

#: A whole-matrix alignment: a step of the recursion is a row of every matrix; of a gap along the target the running maximum keeps where it opened.
_SIMILAR_SQL = f"""WITH RECURSIVE {_SEQUENCES}, {_seeds_sql("q")}, {_seeds_sql("t")},
band AS (SELECT qs.id AS q, ts.id AS t, unnest([CAST(floor((ts.pos - qs.pos) / {_WIDTH}.0) AS BIGINT), CAST(floor((ts.pos - qs.pos) / {_WIDTH}.0) AS BIGINT) - 1]) AS band FROM qs JOIN ts USING (key)),
pair AS (SELECT DISTINCT q, t FROM (SELECT q, t, band FROM band GROUP BY ALL HAVING count(*) >= {_LEAST})),
dp AS (SELECT pair.q, pair.t, 0 AS i, unnest(range(0, length(t.seq) + 1)) AS j, unnest([0] || list_transform(string_split(t.seq, ''), lambda x: ascii(x))) AS c, q.seq AS qs, 0 AS h, {_ZERO} AS st, -1000000 AS f, {_ZERO} AS fst
    FROM pair JOIN q ON q.id = pair.q JOIN t ON t.id = pair.t
  UNION ALL SELECT q, t, i, j, c, qs, CAST(CASE WHEN closed >= e THEN closed ELSE e END AS INT), CASE WHEN closed >= e THEN cst ELSE {{'m': CAST((em // 262144 // 4096 // 256 // 8192) % 4096 AS INT),
      'l': CAST((em // 262144 // 4096 // 256) % 8192 AS INT) + CAST(j - (em // 262144 // 4096 // 256 // 8192 // 4096) % 262144 AS INT), 'g': CAST((em // 262144 // 4096) % 256 AS INT) + 1, 'a': CAST((em // 262144) % 4096 AS INT), 'b': CAST(em % 262144 AS INT)}} END, f, fst
    FROM (SELECT *, coalesce(CAST(em // 262144 // 4096 // 256 // 8192 // 4096 // 262144 AS INT) - 5 - 2 * j, -1) AS e
    FROM (SELECT *, max({_PACK}) OVER (PARTITION BY q, t ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS em
    FROM (SELECT *, CASE WHEN closed = 0 THEN {_ZERO} WHEN closed = diag THEN {{'m': std.m + CASE WHEN qc = c THEN 1 ELSE 0 END, 'l': std.l + 1, 'g': std.g, 'a': CASE WHEN hd = 0 THEN i ELSE std.a END, 'b': CASE WHEN hd = 0 THEN CAST(j AS INT) ELSE std.b END}} ELSE fst END AS cst
    FROM (SELECT *, hd + CASE WHEN qc = c THEN 2 ELSE -3 END AS diag, greatest(0, hd + CASE WHEN qc = c THEN 2 ELSE -3 END, f) AS closed
    FROM (SELECT q, t, i + 1 AS i, j, c, qs, ascii(qs[i + 1]) AS qc, lag(h) OVER w AS hd, lag(st) OVER w AS std, greatest(h - 7, f - 2) AS f,
      CASE WHEN f - 2 > h - 7 THEN {{'m': fst.m, 'l': fst.l + 1, 'g': fst.g, 'a': fst.a, 'b': fst.b}} ELSE {{'m': st.m, 'l': st.l + 1, 'g': st.g + 1, 'a': st.a, 'b': st.b}} END AS fst
      FROM dp WHERE i < length(qs) WINDOW w AS (PARTITION BY q, t ORDER BY j)))))))
SELECT q AS qseqid, t AS sseqid, round(100.0::DOUBLE * st.m / st.l, 6) AS pident, st.l AS length, st.g AS gapopen, st.a AS qstart, i AS qend, st.b AS sstart, CAST(j AS INT) AS send, round(({_SCALE!r}::DOUBLE * h - ln(0.1::DOUBLE)) / ln(2), 6) AS bitscore,
  round(100.0::DOUBLE * (i - st.a + 1) / length(qs), 6) AS qcov, round(100.0::DOUBLE * (j - st.b + 1) / (SELECT length(seq) FROM t AS x WHERE x.id = dp.t), 6) AS scov
FROM (SELECT * FROM dp WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY h DESC, i, j) = 1) AS dp WHERE 0.1::DOUBLE * length(qs) * (SELECT sum(length(seq)) FROM t) * exp(-{_SCALE!r}::DOUBLE * h) <= {_EVALUE}"""


@query(_SIMILAR_SQL)
def similarity_search(spark, d):
    clean = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    q = tb.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.replace(F.translate(clean, "wv", "vf"), F.lit("tion"), F.lit("tn")).alias("seq"))
    t = tb.table(spark, d, "documents").select(F.col("doc_id").alias("id"), clean.alias("seq"))
    found = similarity.similarity_join(q, t, _K, _W, _LEAST, _WIDTH, _SCORING, _EVALUE, best_only=True)
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("qseqid", "sseqid", r("pident"), "length", "gapopen", "qstart", "qend", "sstart", "send", r("bitscore"), r("qcov"), r("scov"))


@query()
def gene_calls(spark, d):
    """Genes of all documents as contigs, with a model for each GC percent."""
    found = genes.call_genes(tb.contigs(spark, d), train=150, rounds=0)
    return found.select("orf_id", "accession", "start", "end", "strand", "partial_left", "partial_right", F.round("score", 3).alias("score"), "protein")


_PROFILES_SQL = """words AS (SELECT DISTINCT a || b || c || d AS kmer FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b), (SELECT unnest(['A', 'C', 'G', 'T']) AS c), (SELECT unnest(['A', 'C', 'G', 'T']) AS d)),
have AS (SELECT accession, length, lang, kmer, count(*) / CAST(any_value(n) - 1 AS DOUBLE) AS freq FROM (SELECT accession, length, lang, length(seq) AS n, unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, CAST(i AS BIGINT), 4))) AS kmer FROM contigs WHERE length(seq) >= 4) GROUP BY ALL),
prof AS (SELECT c.accession, c.length, c.lang, words.kmer, coalesce(freq, 0) AS v, CASE WHEN c.length > 12500 THEN 1 WHEN c.length > 7500 THEN 2 WHEN c.length > 4000 THEN 3 WHEN c.length > 2000 THEN 4 WHEN c.length > 4 THEN 5 END AS model FROM (SELECT DISTINCT accession, length, lang FROM have) c CROSS JOIN words LEFT JOIN have USING (accession, kmer))"""


@query(f"""WITH {tb.CONTIGS_SQL}, {_PROFILES_SQL},
known AS (SELECT accession, CAST(min(CAST(accession AS BIGINT)) OVER (PARTITION BY lang) AS VARCHAR) AS host FROM contigs),
dif AS (SELECT p.model, p.kmer, p.v - h.v AS x FROM prof p JOIN known USING (accession) JOIN prof h ON h.accession = known.host AND h.kmer = p.kmer WHERE p.model IS NOT NULL),
fit AS (SELECT model, kmer, avg(x) AS mean, greatest(avg(x * x) - avg(x) * avg(x), 1e-6::DOUBLE) AS var FROM dif GROUP BY 1, 2),
score AS (SELECT q.accession, h.accession AS host, round(sum(-0.5 * ((q.v - h.v - mean) * (q.v - h.v - mean) / var + ln(2 * pi() * var))), 7) AS s FROM prof q JOIN fit ON fit.model = q.model AND fit.kmer = q.kmer JOIN prof h ON h.kmer = q.kmer WHERE CAST(q.accession AS BIGINT) % 50 = 0 GROUP BY 1, 2),
calls AS (SELECT accession, host FROM score QUALIFY row_number() OVER (PARTITION BY accession ORDER BY s DESC, host) = 1),
mh AS (SELECT CAST(l_orderkey * 50 AS VARCHAR) AS phage, CAST(l_suppkey AS VARCHAR) AS mag, (40 + l_quantity) / 100 AS pident FROM lineitem), x AS (SELECT phage, mag, max(pident) AS ident FROM mh GROUP BY 1, 2), m AS (SELECT phage, avg(ident) AS mean FROM x GROUP BY 1),
taxa AS (SELECT accession AS mag, CASE WHEN CAST(accession AS BIGINT) % 4 <> 0 THEN 'genus:g' || (CAST(accession AS BIGINT) % 2) END AS genus FROM contigs), l AS (SELECT phage, arg_max(genus, mag) AS genus FROM x JOIN taxa USING (mag) WHERE genus IS NOT NULL GROUP BY 1)
SELECT accession, CASE WHEN x.mag IS NOT NULL THEN host ELSE t.genus END AS host, round(coalesce(ident, mean), 2) AS score FROM calls c JOIN m ON m.phage = accession LEFT JOIN x ON x.phage = accession AND x.mag = host
LEFT JOIN taxa t ON t.mag = host LEFT JOIN l ON l.phage = accession WHERE x.mag IS NOT NULL OR t.genus = l.genus""")
def host_by_fitted_density(spark, d):
    """Densities fitted to all documents against the first of their language, by length; hosts for a query set, gated by protein hits."""
    c = tb.contigs(spark, d)
    v = materialize(kmers.profiles(c.select(F.col("accession").alias("id"), "seq")), "profiles")
    first = c.groupBy(F.col("lang").alias("_lang")).agg(F.min(F.col("accession").cast("bigint")).cast("string").alias("ref"))
    known = c.join(first, F.col("lang").eqNullSafe(F.col("_lang"))).select(F.col("accession").alias("id"), "ref")
    fitted = kmers.fit_mixtures(kmers.pair_differences(known, v.join(c.select(F.col("accession").alias("id"), kmers.length_model(F.col("length")).alias("model")), "id"), v))
    hits = tb.table(spark, d, "lineitem").select(F.expr("concat(l_orderkey * 50, '_', l_linenumber)").alias("qseqid"), F.col("l_suppkey").cast("string").alias("mag"), (40 + F.col("l_quantity")).alias("pident"))
    no, none = F.col("accession").cast("bigint"), F.lit(None).cast("string")
    taxa = c.select(F.col("accession").alias("mag"), none.alias("species"), F.when(no % 4 != 0, F.concat(F.lit("genus:g"), (no % 2).cast("string"))).alias("genus"), none.alias("family"))
    return tasks.kmer_host(c.where(no % 50 == 0), c, densities=fitted, protein_hits=hits, taxa=taxa, profiles=(v.where(F.col("id").cast("bigint") % 50 == 0), v))


#: A small model for the driver's tables: its weights follow from their places, by one rule for Python and SQL.
_SIZES = {
    transformer.WORDS: (10, 4), transformer.PLACES: (6, 4), "encoder.layers.attention.values.weight": (2, 2), "encoder.layers.attention.keys.weight": (2, 2), "encoder.layers.attention.queries.weight": (2, 2),
    "encoder.layers.attention.fc_out.weight": (4, 4), "encoder.layers.attention.fc_out.bias": (4,), "encoder.layers.norm1.weight": (4,), "encoder.layers.norm1.bias": (4,), "encoder.layers.feed_forward.0.weight": (8, 4),
    "encoder.layers.feed_forward.0.bias": (8,), "encoder.layers.feed_forward.2.weight": (4, 8), "encoder.layers.feed_forward.2.bias": (4,), "encoder.layers.norm2.weight": (4,), "encoder.layers.norm2.bias": (4,),
    "fc1.weight": (3, 24), "fc1.bias": (3,), "bn.running_mean": (3,), "bn.running_var": (3,), "bn.weight": (3,), "bn.bias": (3,), "out.weight": (1, 3), "out.bias": (1,),
}


def _small_model() -> dict[str, np.ndarray]:
    found = {}
    for k, (name, shape) in enumerate(_SIZES.items()):
        i, j = np.indices(shape) if len(shape) > 1 else (np.arange(shape[0]), 0)
        found[name] = np.sin(1.7 * k + 0.9 * i + 0.37 * j) + (1.5 if name == "bn.running_var" else 0)
    return found


def _weight(name: str, i: str, j: str = "0") -> str:
    k = list(_SIZES).index(name)
    return f"(sin({1.7 * k!r}::DOUBLE + 0.9::DOUBLE * ({i}) + 0.37::DOUBLE * ({j}))" + (" + 1.5)" if name == "bn.running_var" else ")")


def _layer(name: str, i: str, j: str = "0") -> str:
    return _weight("encoder.layers." + name, i, j)


def _project(name: str) -> str:
    return f"sum(x * {_layer(f'attention.{name}.weight', 'o.o', 'd % 2')}) AS {name}"


def _norm_sql(table: str, name: str) -> str:
    return f"SELECT s, p, t, d, (y - avg(y) OVER w) / sqrt(var_pop(y) OVER w + 1e-5::DOUBLE) * {_layer(name + '.weight', 'd')} + {_layer(name + '.bias', 'd')} AS x FROM {table} WINDOW w AS (PARTITION BY s, p)"


@query(f"""WITH li AS (SELECT conv_id AS s, 1 + length(coalesce(text, '')) % 9 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, '')) % 9) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
tok AS (SELECT s, p, coalesce(li.t, 0) AS t FROM (SELECT DISTINCT s FROM li) CROSS JOIN (SELECT unnest(range(6)) AS p) LEFT JOIN li USING (s, p)),
e AS (SELECT s, p, t, d, {_weight(transformer.WORDS, 't', 'd')} + {_weight(transformer.PLACES, 'p', 'd')} AS x FROM tok CROSS JOIN (SELECT unnest(range(4)) AS d)),
qkv AS (SELECT s, p, t, d // 2 AS h, o.o AS o, {_project('queries')}, {_project('keys')}, {_project('values')} FROM e CROSS JOIN (SELECT unnest(range(2)) AS o) o GROUP BY ALL),
en AS (SELECT a.s, a.p AS q, b.p AS k, a.h, CASE WHEN b.t = 0 THEN -1e20::DOUBLE ELSE sum(a.queries * b.keys) END / 2 AS e FROM qkv a JOIN qkv b ON a.s = b.s AND a.h = b.h AND a.o = b.o GROUP BY a.s, a.p, b.p, a.h, b.t),
sm AS (SELECT s, q, k, h, x / sum(x) OVER (PARTITION BY s, q, h) AS a FROM (SELECT s, q, k, h, exp(e - max(e) OVER (PARTITION BY s, q, h)) AS x FROM en)),
seen AS (SELECT sm.s, q AS p, sm.h * 2 + o AS d, sum(a * "values") AS v FROM sm JOIN qkv ON qkv.s = sm.s AND qkv.p = sm.k AND qkv.h = sm.h GROUP BY ALL),
y1 AS (SELECT e.s, e.p, e.t, e.d, any_value(e.x) + {_layer('attention.fc_out.bias', 'e.d')} + sum(v * {_layer('attention.fc_out.weight', 'e.d', 'seen.d')}) AS y FROM e JOIN seen ON seen.s = e.s AND seen.p = e.p GROUP BY e.s, e.p, e.t, e.d),
n1 AS ({_norm_sql('y1', 'norm1')}),
ff AS (SELECT s, p, t, i, greatest(0, {_layer('feed_forward.0.bias', 'i')} + sum(x * {_layer('feed_forward.0.weight', 'i', 'd')})) AS f FROM n1 CROSS JOIN (SELECT unnest(range(8)) AS i) GROUP BY s, p, t, i),
y2 AS (SELECT n1.s, n1.p, n1.t, n1.d, any_value(n1.x) + {_layer('feed_forward.2.bias', 'n1.d')} + sum(f * {_layer('feed_forward.2.weight', 'n1.d', 'i')}) AS y FROM n1 JOIN ff ON ff.s = n1.s AND ff.p = n1.p GROUP BY n1.s, n1.p, n1.t, n1.d),
n2 AS ({_norm_sql('y2', 'norm2')}),
hid AS (SELECT s, o, {_weight('fc1.bias', 'o')} + sum(x * {_weight('fc1.weight', 'o', 'p * 4 + d')}) AS z FROM n2 CROSS JOIN (SELECT unnest(range(3)) AS o) GROUP BY s, o),
bn AS (SELECT s, o, (z - {_weight('bn.running_mean', 'o')}) / sqrt({_weight('bn.running_var', 'o')} + 1e-5::DOUBLE) * {_weight('bn.weight', 'o')} + {_weight('bn.bias', 'o')} AS z FROM hid)
SELECT s AS accession, round(1 / (1 + exp(-(sum(z * {_weight('out.weight', '0', 'o')}) + {_weight('out.bias', '0')}))), 5) AS score FROM bn GROUP BY s""")
def sentence_scores(spark, d):
    """Conversations as contigs, their first six turns as tokens, scored by a small sentence model."""
    turn = tb.table(spark, d, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("accession"), "turn", F.expr("CAST(1 + length(coalesce(text, '')) % 9 AS int)").alias("t"))
    first = turn.withColumn("p", F.row_number().over(Window.partitionBy("accession").orderBy("turn", "t"))).where("p <= 6")
    t = first.groupBy("accession").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("t"))
    tokens = F.concat("t", F.array_repeat(F.lit(0), F.lit(6) - F.size("t")))
    scored = transformer.score_sentences(t.select("accession", tokens.alias("tokens")), _small_model(), heads=2)
    return scored.select("accession", F.round("score", 5).alias("score"))


_LINES_SQL = f"""{tb.ORFS_SQL}, gene AS (SELECT orf_id AS gene, regexp_replace(orf_id, '_[^_]*$', '') AS genome, CASE WHEN length(clean) >= 20 THEN clean END AS line, CASE WHEN size % 3 = 0 THEN 'size ' || (size % 7) || '; three' END AS keywords FROM orfs),
often AS (SELECT line FROM gene WHERE line IS NOT NULL GROUP BY line HAVING count(DISTINCT genome) > 1), member AS (SELECT line AS cluster, gene FROM gene JOIN often USING (line)),
prof AS (SELECT DISTINCT genome, cluster FROM gene JOIN member USING (gene)),
gen AS (SELECT genome, proteins, coalesce(clusters, 0) AS clusters, proteins - coalesce(clusters, 0) AS singletons FROM (SELECT genome, count(*) AS proteins FROM gene GROUP BY 1) LEFT JOIN (SELECT genome, count(*) AS clusters FROM prof GROUP BY 1) USING (genome))"""


def _line_genes(spark, d):
    """Lines of documents as genes, lines that two documents have as clusters, with keywords by their length."""
    o = tb.orfs(spark, d)
    line = F.when(F.length("clean") >= 20, F.unhex(F.md5("clean"))).alias("line")
    g = o.select(F.col("orf_id").alias("gene"), fn.genome_of(F.col("orf_id")).alias("genome"), line, F.expr("CASE WHEN size % 3 = 0 THEN concat('size ', size % 7, '; three') END").alias("keywords"))
    g = materialize(g, "line-genes")
    often = g.where("line IS NOT NULL").groupBy("line").agg(F.count_distinct("genome").alias("n")).where("n > 1").select("line")
    return g, g.join(often, "line").select(F.col("line").alias("cluster"), "gene")


@query(f"""WITH {_LINES_SQL}, known AS (SELECT cluster, genome, keywords FROM member JOIN gene USING (gene)), word AS (SELECT cluster, trim(unnest(string_split(keywords, ';'))) AS k FROM known WHERE keywords IS NOT NULL),
keys AS (SELECT cluster, string_agg(k || ' (' || n || ')', '; ' ORDER BY n DESC, k) AS keys FROM (SELECT cluster, k, count(*) AS n FROM word GROUP BY 1, 2) GROUP BY 1)
SELECT md5(cluster) AS cluster, count(*) AS size, count(keywords) AS annotated, any_value(keys) AS keys FROM known LEFT JOIN keys USING (cluster) GROUP BY cluster""")
def cluster_keywords(spark, d):
    return network.cluster_profiles(*_line_genes(spark, d))[2].withColumn("cluster", F.lower(F.hex("cluster")))


@query(f"WITH {_LINES_SQL} SELECT * FROM gen")
def genome_profiles(spark, d):
    return network.cluster_profiles(*_line_genes(spark, d))[1]


@query(f"""WITH {_LINES_SQL}, n AS (SELECT count(*) AS genomes, CAST(sum(singletons) AS BIGINT) + (SELECT count(DISTINCT cluster) FROM prof) AS total FROM gen),
c AS (SELECT x.genome AS a, y.genome AS b, count(*) AS shared FROM prof x JOIN prof y ON x.cluster = y.cluster AND x.genome < y.genome GROUP BY 1, 2),
s AS (SELECT a, b, shared, p.proteins AS x, q.proteins AS y FROM c JOIN gen p ON p.genome = a JOIN gen q ON q.genome = b),
t AS (SELECT s.*, log10(0.5::DOUBLE * genomes * (genomes - 1)) AS pairs, list_transform(range(greatest(shared, x + y - total), least(x, y) + 1), lambda i: lgamma(x + 1) - lgamma(i + 1) - lgamma(x - i + 1) + lgamma(total - x + 1) - lgamma(y - i + 1) - lgamma(total - x - y + i + 1) - lgamma(total + 1) + lgamma(y + 1) + lgamma(total - y + 1)) AS l FROM s, n),
w AS (SELECT a, b, shared, least(-(list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l)))))) / ln(10) - pairs, 1000) AS weight FROM t)
SELECT a, b, shared, round(weight, 4) AS weight FROM w WHERE weight > 1""")
def shared_cluster_network(spark, d):
    profiles, genomes, _ = network.cluster_profiles(*_line_genes(spark, d))
    return network.shared_cluster_edges(profiles, genomes).select("a", "b", "shared", F.round("weight", 4).alias("weight"))


@query(f"WITH {tb.ORFS_SQL} SELECT regexp_replace(orf_id, '_[^_]*$', '') AS genome, count(*) AS genes FROM orfs GROUP BY 1")
def cached_intermediate(spark, d):
    """Genome sizes through the store of intermediates: built by the first call, read by the second."""
    root = f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}"
    take = lambda: cache.cached(spark, root, "genome_sizes", {"version": 1}, [f"{d}/documents.parquet"], lambda: pairs.genome_sizes(tb.orfs(spark, d)))
    take()
    return take()
