"""Readers for sequences, alignment tables, cluster files and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake import schemas
from seqlake.functions import is_dna
from seqlake.operators.genes import call_genes
from seqlake.sources.pickles import pickled_table
from seqlake.sources.reports import blast_xml, report_records, write_reports

__all__ = ["blast_xml", "pickled_table", "report_records", "write_reports"]


def records(reader, path: str) -> DataFrame:
    """Raw FASTA records of a text reader or stream: split where a line starts with `>`, so a `>` inside a header is kept.

    Files are split in parallel at record ends; the first record of a file still has its `>`. Carriage returns are dropped.
    """
    raw = reader.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("value"), "_metadata.file_name")
    return raw.where(F.trim("value", F.lit(" \t\n")) != "")


def _parts(raw: DataFrame, *more: str) -> DataFrame:
    header = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)")
    return raw.select(*more, F.substring_index(F.regexp_replace(header, "\\s", " "), " ", 1).alias("accession"), F.trim(header).alias("header"), F.regexp_replace(body, "\\s", "").alias("seq"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, header, seq) of FASTA records. The accession is the header's first word; sequence lines are joined without whitespace."""
    return _parts(records(spark.read, path))


def genome_folder(spark: SparkSession, path: str) -> DataFrame:
    """(mag, accession, seq) of a folder with one FASTA file for each genome; mag is the file name without its last extension."""
    raw = records(spark.read, path).withColumn("mag", F.regexp_replace("file_name", "\\.[^.]*$", ""))
    return _parts(raw, "mag").drop("header")


def proteins(spark: SparkSession, path: str) -> DataFrame:
    """(orf_id, start, end, strand, gc, seq) from gene-caller headers `id # start # end # strand # ...;gc_cont=x`."""
    w = F.split("header", "\\s+")
    at = lambda i: F.get(w, F.lit(i))
    num = lambda c, t: c.try_cast(t)
    return fasta(spark, path).select(
        at(0).alias("orf_id"), num(at(2), "int").alias("start"), num(at(4), "int").alias("end"), num(at(6), "int").alias("strand"),
        num(F.regexp_extract("header", "gc_cont=([0-9.]+)", 1), "double").alias("gc"), "seq",
    )


def hits(spark: SparkSession, path: str, schema: str = schemas.HITS12, sep: str = "\t") -> DataFrame:
    """A headerless alignment table under an explicit schema (see schemas)."""
    return spark.read.schema(schema).csv(path, sep=sep)


def abc(hits_: DataFrame) -> DataFrame:
    return hits_.select("qseqid", "sseqid", "pident", "bitscore")


def contamination_hits(spark: SparkSession, path: str) -> DataFrame:
    return hits(spark, path, schemas.CONTAMINATION_HITS).withColumn("target", F.substring_index("target", "-consensus", 1))


def dimension(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header, sep=sep)


def tables_by_extension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of .csv and .tsv files of one schema, each read with its own separator."""
    csv = spark.read.schema(schema).option("pathGlobFilter", "*.csv").csv(path, header=True)
    return csv.unionByName(spark.read.schema(schema).option("pathGlobFilter", "*.tsv").csv(path, header=True, sep="\t"))


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, node): one cluster on each line, named by its first member, members split at whitespace."""
    line = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("m"))
    return line.select(F.get("m", F.lit(0)).alias("cluster"), F.explode("m").alias("node"))


def spacers(spark: SparkSession, path: str) -> DataFrame:
    """(spacer_id, mag, position, spacer, valid) from repeat-finder reports, one file for each genome.

    Rows are lines whose first tab field is a number and whose fourth is not blank. A spacer of other letters than
    ACGTN is reported with valid false and has no id. Valid ones are `<mag>_CRISPR_<n>`, n from 0 in the order of the file.
    """
    t = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "text"), F.regexp_replace(F.col("_metadata.file_name"), "\\.[^.]*$", "").alias("mag"))
    f = F.split("text", "\t")
    row = t.select("mag", "line", F.get(f, F.lit(0)).try_cast("int").alias("position"), F.trim(F.get(f, F.lit(3))).alias("spacer")).where("position is not null and spacer <> ''")
    row = row.withColumn("valid", is_dna(F.col("spacer")))
    no = F.sum(F.col("valid").cast("int")).over(Window.partitionBy("mag").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    name = F.concat(F.col("mag"), F.lit("_CRISPR_"), F.coalesce(no, F.lit(0)).cast("string"))
    return row.withColumn("spacer_id", F.when(F.col("valid"), name)).select("spacer_id", "mag", "position", "spacer", "valid")


def kmer_table(spark: SparkSession, path: str, k: int = 4) -> DataFrame:
    """(id, v) of a headerless CSV: a name and 4**k frequencies in alphabetical order of the words."""
    n = 4**k
    names = [f"f{i}" for i in range(n)]
    return spark.read.schema("id string, " + ", ".join(f"{c} double" for c in names)).csv(path).select("id", F.array(*names).alias("v"))


def count_records(spark: SparkSession, path: str) -> int:
    """Number of FASTA records."""
    return records(spark.read, path).count()


def proteins_or_genes(spark: SparkSession, path: str | None, contigs: DataFrame, **options) -> DataFrame:
    """(orf_id, start, end, strand): the user's proteins of known contigs; called genes where no file is given or none is known."""
    if path:
        own = known_proteins(proteins(spark, path), contigs)
        if not own.isEmpty():
            return own.select("orf_id", "start", "end", "strand")
    return call_genes(contigs, **options).select("orf_id", "start", "end", "strand")


def translated_genomes(spark: SparkSession, path: str, **options) -> DataFrame:
    """(mag, orf_id, start, end, strand, protein) of the genes in a folder of genomes, one file each, with a model for each genome."""
    g = genome_folder(spark, path)
    genes = call_genes(g.select("mag", F.concat_ws("\u0001", "mag", "accession").alias("accession"), "seq"), group="mag", **options)
    return genes.select(F.substring_index("accession", "\u0001", 1).alias("mag"), F.substring_index("orf_id", "\u0001", -1).alias("orf_id"), "start", "end", "strand", "protein")


def valid_names(spark: SparkSession, path: str) -> DataFrame:
    """(rank, name, ord) from a JSON object of rank -> list of names."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return m.select(F.explode("m").alias("rank", "names")).select("rank", F.posexplode("names").alias("ord", "name"))


def known_proteins(proteins_: DataFrame, contigs: DataFrame) -> DataFrame:
    """User-supplied proteins of known contigs."""
    from seqlake.functions import genome_of

    return proteins_.withColumn("accession", genome_of(F.col("orf_id"))).join(contigs.select("accession"), "accession", "left_semi")


def open_frames(contigs: DataFrame, least: int = 90) -> DataFrame:
    """(orf_id, accession, start, end, strand): open frames ATG..stop on both strands, found by one pattern for each frame.

    A stand-in for an external gene caller, and an approximation of one: it knows no gene model.
    """
    from seqlake.functions import reverse_complement

    both = contigs.select("accession", F.length("seq").alias("n"), F.explode(F.array(F.struct(F.upper("seq").alias("s"), F.lit(1).alias("strand")), F.struct(reverse_complement(F.upper("seq")).alias("s"), F.lit(-1).alias("strand")))).alias("x"))
    frames = both.select("accession", "n", "x.strand", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame"), F.col("x.s").alias("s"))
    codons = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length("s") - F.col("frame")) / 3).cast("int")), lambda i: F.substring("s", F.col("frame") + 1 + 3 * i, F.lit(3))), " ")
    framed = frames.where(F.length("s") >= F.col("frame") + 3).withColumn("c", codons)
    pattern = "ATG( (?!TAA|TAG|TGA)[A-Z]{3})*+ (?:TAA|TAG|TGA)"
    steps = F.arrays_zip(F.split("c", pattern, -1).alias("gap"), F.regexp_extract_all("c", F.lit(pattern), F.lit(0)).alias("hit"))
    walk = F.aggregate(
        F.filter(steps, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,len:int>>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"), F.array_append(a["out"], F.struct((a["at"] + F.length(x["gap"])).alias("at"), F.length(x["hit"]).alias("len"))).alias("out")),
        lambda a: a["out"],
    )
    one = framed.select("accession", "n", "strand", "frame", F.explode(walk).alias("o"))
    first = F.col("frame") + 3 * (F.col("o.at") / 4).cast("int") + 1
    bases = 3 * ((F.col("o.len") + 1) / 4).cast("int")
    pos = one.select("accession", "n", "strand", first.alias("a"), (first + bases - 1).alias("b")).where(F.col("b") - F.col("a") + 1 >= least)
    real = pos.select("accession", "strand", F.when(F.col("strand") == 1, F.col("a")).otherwise(F.col("n") - F.col("b") + 1).alias("start"), F.when(F.col("strand") == 1, F.col("b")).otherwise(F.col("n") - F.col("a") + 1).alias("end"))
    no = F.row_number().over(Window.partitionBy("accession").orderBy("start", "end", "strand"))
    return real.withColumn("no", no).select(F.concat_ws("_", "accession", "no").alias("orf_id"), "accession", "start", "end", "strand")
