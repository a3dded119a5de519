"""Genomics-shaped views of the driver's tables, each with the same definition in DuckDB SQL (the *_SQL CTEs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators import network

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark, d) -> DataFrame:
    seq = F.upper(F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("n_chars").alias("length"), "lang", "source", seq.alias("seq"))


CONTIGS_SQL = f"contigs AS (SELECT CAST(doc_id AS VARCHAR) AS accession, n_chars AS length, lang, source, upper(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')) AS seq FROM documents)"


def orfs(spark, d) -> DataFrame:
    line = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    clean = F.regexp_replace(F.lower("line"), "[^a-z]", "")
    return line.select(F.concat_ws("_", F.col("doc_id").cast("string"), (F.col("pos") + 1).cast("string")).alias("orf_id"), F.length("line").alias("size"), clean.alias("clean"))


ORFS_SQL = """orfs AS (SELECT doc_id || '_' || i AS orf_id, length(line) AS size, regexp_replace(lower(line), '[^a-z]', '', 'g') AS clean
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def hits(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.expr("concat('q', l_orderkey % 211, '_', l_linenumber)").alias("qseqid"), F.expr("concat('t', l_suppkey % 37, '_', l_partkey % 19)").alias("sseqid"),
        (F.col("l_quantity") * 2).alias("pident"), (F.col("l_quantity") * 3).cast("int").alias("length"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("bitscore"),
    )


HITS_SQL = """hits AS (SELECT 'q' || (l_orderkey % 211) || '_' || l_linenumber AS qseqid, 't' || (l_suppkey % 37) || '_' || (l_partkey % 19) AS sseqid,
  l_quantity * 2 AS pident, CAST(l_quantity * 3 AS INT) AS length, l_discount AS evalue, l_extendedprice AS bitscore FROM lineitem)"""


def intervals(spark, d) -> DataFrame:
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select("user_id", at.alias("start"), (at + F.floor(F.abs("value"))).alias("stop"))


INTERVALS_SQL = "iv AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value)) AS BIGINT) AS stop FROM events)"


def nodes(spark, d) -> DataFrame:
    root = spark.range(1).select(F.lit("root").alias("taxid"), F.lit("root").alias("parent"), F.lit("no rank").alias("rank"), F.lit("root").alias("name"))
    r = table(spark, d, "region").select(F.expr("concat('r:', r_regionkey)").alias("taxid"), F.lit("root").alias("parent"), F.lit("realm").alias("rank"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.expr("concat('n:', n_nationkey)").alias("taxid"), F.expr("concat('r:', n_regionkey)").alias("parent"), F.lit("family").alias("rank"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.expr("concat('s:', s_suppkey)").alias("taxid"), F.expr("concat('n:', s_nationkey)").alias("parent"), F.lit("genus").alias("rank"), F.col("s_name").alias("name"))
    return root.unionByName(r).unionByName(n).unionByName(s)


NODES_SQL = """nodes AS (SELECT 'root' AS taxid, 'root' AS parent, 'no rank' AS rank, 'root' AS name UNION ALL SELECT 'r:' || r_regionkey, 'root', 'realm', r_name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'family', n_name FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'genus', s_name FROM supplier),
tree AS (WITH RECURSIVE w AS (SELECT taxid, taxid AS ancestor, 0 AS steps FROM nodes UNION ALL SELECT w.taxid, n.parent, w.steps + 1 FROM w JOIN nodes n ON n.taxid = w.ancestor WHERE n.parent <> n.taxid)
  SELECT taxid, ancestor, CAST(max(steps) OVER (PARTITION BY taxid) - steps + 1 AS INT) AS depth FROM w)"""


def tax_hits(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.expr("concat('c', l_orderkey % 97)").alias("contig"), F.expr("concat('o', l_orderkey)").alias("qseqid"), F.expr("concat('s:', l_suppkey)").alias("sseqid"), (F.col("l_quantity") * 2).alias("pident"), F.col("l_extendedprice").alias("bitscore")
    )


TAX_HITS_SQL = """th0 AS (SELECT 'c' || (l_orderkey % 97) AS contig, 'o' || l_orderkey AS orf, 's:' || l_suppkey AS taxid, l_extendedprice AS bitscore FROM lineitem),
th AS (SELECT contig, orf, taxid, bitscore FROM (SELECT *, max(bitscore) OVER (PARTITION BY orf) AS top FROM th0) WHERE bitscore >= top * 0.9::DOUBLE)"""


def shared_lines(spark, d, least: int = 3) -> DataFrame:
    """(a, b, lines): document pairs sharing at least `least` distinct cleaned lines of 20 letters or more."""
    o = orfs(spark, d).where(F.length("clean") >= 20).select(F.regexp_replace("orf_id", "_[^_]*$", "").cast("bigint").alias("id"), F.col("clean").alias("item"))
    return network.shared_items(o, least).withColumnRenamed("shared", "lines")


SHARED_SQL = f"""{ORFS_SQL}, ln AS (SELECT DISTINCT CAST(regexp_replace(orf_id, '_[^_]*$', '') AS BIGINT) AS id, clean FROM orfs WHERE length(clean) >= 20),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS lines FROM ln x JOIN ln y ON x.clean = y.clean AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 3)"""

COMPONENTS_SQL = """sym AS (SELECT a, b FROM shared UNION SELECT b, a FROM shared),
reach AS (WITH RECURSIVE r AS (SELECT a AS node, a AS seen FROM sym UNION SELECT r.node, s.b FROM r JOIN sym s ON s.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node)"""


def calls(spark, d) -> DataFrame:
    """Deterministic stand-ins of model outputs: score from the id, proportion from the letters e."""
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").cast("string").alias("accession"), F.col("n_chars").alias("length"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 100) / 100).alias("score"),
        F.round((F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))) * 3 / F.col("n_chars"), 4).alias("proportion"), F.col("lang"), F.col("source"),
    )


CALLS_SQL = """calls AS (SELECT CAST(doc_id AS VARCHAR) AS accession, n_chars AS length, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS score,
  round((length(text) - length(replace(text, 'e', ''))) * 3 / CAST(n_chars AS DOUBLE), 4) AS proportion, lang, source FROM documents)"""


def evidence_rows(spark, d) -> DataFrame:
    """Events as host evidence: the type is the method, trusted in alphabetical order; the few types are ranked apart."""
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    types = ev.select("event_type").distinct().withColumn("priority", F.row_number().over(Window.orderBy("event_type")))
    return ev.join(types, "event_type").select(F.col("user_id").cast("string").alias("accession"), F.expr("concat('h', event_id % 23)").alias("host"), F.round("value", 4).alias("score"), F.col("event_type").alias("method"), "priority")


EVIDENCE_SQL = "ev AS (SELECT CAST(user_id AS VARCHAR) AS accession, 'h' || (event_id % 23) AS host, round(value, 4) AS score, event_type AS method, dense_rank() OVER (ORDER BY event_type) AS priority FROM events)"


def genes(spark, d) -> DataFrame:
    """Events in time order as genes of a contig (user): label by event id, gc by value."""
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return ev.select(F.col("user_id").cast("string").alias("accession"), no.alias("gene_no"), F.expr("CASE WHEN event_id % 7 < 2 THEN 1 WHEN event_id % 7 = 3 THEN -1 ELSE 0 END").alias("label"), F.lit(0.5).alias("gc")).withColumn("start", F.col("gene_no") * 100 - 99).withColumn("end", F.col("gene_no") * 100 - 10)


GENES_SQL = "genes AS (SELECT CAST(user_id AS VARCHAR) AS accession, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gene_no, CASE WHEN event_id % 7 < 2 THEN 1 WHEN event_id % 7 = 3 THEN -1 ELSE 0 END AS label FROM events)"


def alignments(spark, d) -> DataFrame:
    """Conversations as an alignment: role is the marker, a conversation the id, the letters of all its turns the row."""
    c = table(spark, d, "conversations")
    one = c.groupBy(F.col("role").alias("marker"), F.col("conv_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    one = one.select("marker", "id", F.regexp_replace(F.lower(F.array_join("t.text", "")), "[^a-z]", "").alias("t"))
    width = one.groupBy("marker").agg(F.max(F.length("t")).alias("width"))
    return one.join(width, "marker").select("marker", "id", F.rpad("t", F.col("width"), F.lit("-")).alias("aln"))


ALIGNMENTS_SQL = """al AS (SELECT role AS marker, CAST(conv_id AS VARCHAR) AS id, coalesce(regexp_replace(lower(string_agg(text, '' ORDER BY turn, text)), '[^a-z]', '', 'g'), '') AS t FROM conversations GROUP BY 1, 2),
msa AS (SELECT marker, id, rpad(t, CAST(max(length(t)) OVER (PARTITION BY marker) AS INT), '-') AS aln FROM al)"""
