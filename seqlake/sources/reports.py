"""Search-report XML: split at record ends for many tasks, read under the rules of the tabular format, routed to a folder for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tags of a report, and the identifiers that stand for a missing one.
_START, _END = "<Iteration>", "</Iteration>"
_HSP = "`Hsp_bit-score`:double,Hsp_evalue:string,`Hsp_query-from`:int,`Hsp_query-to`:int,`Hsp_hit-from`:int,`Hsp_hit-to`:int,Hsp_identity:int,`Hsp_align-len`:int,Hsp_qseq:string,Hsp_hseq:string,Hsp_midline:string"
_RECORD = f"`Iteration_query-ID` string, `Iteration_query-def` string, Iteration_hits struct<Hit:array<struct<Hit_id:string,Hit_def:string,Hit_accession:string,Hit_hsps:struct<Hsp:array<struct<{_HSP}>>>>>>"
_NO_QUERY, _NO_SUBJECT, _ORDINAL = "^Query_[0-9]+$", "^Subject_[0-9]+$", "gnl|BL_ORD_ID|"
HEAD = '<?xml version="1.0"?>\n<!DOCTYPE BlastOutput PUBLIC "">\n<BlastOutput>\n<BlastOutput_iterations>\n'
FOOT = "\n</BlastOutput_iterations>\n</BlastOutput>\n"


def report_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of a report: the text of each query's element. Large files are split at record ends, so many tasks read one."""
    piece = spark.read.option("lineSep", _END).text(path).where(F.contains("value", F.lit(_START)))
    return piece.select(F.concat(F.lit(_START), F.expr(f"substring(value, instr(value, '{_START}') + {len(_START)})"), F.lit(_END)).alias("record"))


def _first_word(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c, F.lit(" \t\n\r")), r"\s+"), 1)


def _parsed(records: DataFrame, *more: str) -> DataFrame:
    """Records as structs. Ampersands are taken out first, as the search tool doesn't escape names; damage is an error."""
    return records.select(*more, F.from_xml(F.replace("record", F.lit("&"), F.lit("")), _RECORD, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}).alias("r"))


def _query_id() -> Column:
    given = F.col("r.Iteration_query-ID")
    return F.when(given.rlike(_NO_QUERY), _first_word(F.col("r.Iteration_query-def"))).otherwise(given)


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """The 12 columns of hits from search-report XML, one row for each aligned stretch.

    A query or subject with a placeholder for a name is named by the first word of its description. A stretch whose three
    texts differ in length, or whose mismatches or identities can't be those of its letters, stops the job with its names.
    """
    h = _parsed(report_records(spark, path)).select(_query_id().alias("qseqid"), F.explode("r.Iteration_hits.Hit").alias("h"))
    word, told = _first_word(F.col("h.Hit_id")), _first_word(F.col("h.Hit_def"))
    stands_in = (word.rlike(_NO_SUBJECT) & (word == F.col("h.Hit_accession"))) | (word == F.concat(F.lit(_ORDINAL), F.col("h.Hit_accession")))
    p = h.select("qseqid", F.when(stands_in, told).otherwise(word).alias("sseqid"), F.explode("h.Hit_hsps.Hsp").alias("p"))
    f = lambda n: F.col("p")[n]
    q, s, m, n, ident = f("Hsp_qseq"), f("Hsp_hseq"), f("Hsp_midline"), f("Hsp_align-len"), f("Hsp_identity")
    letters = F.arrays_zip(F.split(q, "").alias("q"), F.split(s, "").alias("s"))
    of = lambda rule: F.size(F.filter(letters, rule))
    p = p.withColumns({
        "mismatch": _count(m, " ") + _count(m, "+") - _count(q, "-") - _count(s, "-"), "unlike": F.length(q) - of(lambda x: (x["q"] == x["s"]) | (x["q"] == "-") | (x["s"] == "-")),
        "alike": of(lambda x: x["q"] == x["s"]), "xx": of(lambda x: (x["q"] == "X") & (x["s"] == "X")), "x": _count(q, "X"),
    })
    holds = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  what is missing is wrong
    wrong = (
        F.when(~holds((F.length(q) == n) & (F.length(s) == n) & (F.length(m) == n)), "lengths")
        .when(~holds(F.col("mismatch").between(F.col("unlike") - F.col("x"), F.col("unlike") + F.col("xx"))), "mismatches").when(~holds(ident.between(F.col("alike") - F.col("xx"), F.col("alike") + F.col("x"))), "identities")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("report:"), "qseqid", F.lit("vs"), "sseqid", wrong, F.lit("don't agree with the letters"))).cast("int")).otherwise(F.col("mismatch").cast("int"))
    runs = lambda t: F.size(F.filter(F.split(t, "-+"), lambda x: x != "")) - 1
    bits, e = f("Hsp_bit-score"), f("Hsp_evalue")
    return p.select(
        "qseqid", "sseqid", F.round(100 * F.try_divide(ident.cast("double"), n), 3).alias("pident"), n.alias("length"), checked.alias("mismatch"), (runs(q) + runs(s)).alias("gapopen"),
        f("Hsp_query-from").alias("qstart"), f("Hsp_query-to").alias("qend"), f("Hsp_hit-from").alias("sstart"), f("Hsp_hit-to").alias("send"),
        F.format_string("%.0e", e.cast("double")).cast("double").alias("evalue"), F.when(bits < 100, F.round(bits, 1)).otherwise(F.floor(bits).cast("double")).alias("bitscore"),
    )


def queries_of(records: DataFrame) -> DataFrame:
    """Records (record) with the first word of their query's description, qseqid."""
    return _parsed(records, "record").select(_first_word(F.col("r.Iteration_query-def")).alias("qseqid"), "record")


def write_reports(records: DataFrame, wanted: DataFrame, path: str) -> None:
    """Each wanted query's records as whole reports, in one folder for each group; wanted is (qseqid, grp), records as read.

    A query of several groups goes to each; records of other queries go nowhere. Several records of a group are several
    reports of its folder.
    """
    routed = queries_of(records).join(wanted.select("qseqid", "grp").distinct(), "qseqid")
    routed.select(F.concat(F.lit(HEAD), "record", F.lit(FOOT)).alias("value"), "grp").write.mode("overwrite").partitionBy("grp").text(path)
