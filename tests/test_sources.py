"""Readers, writers and streams on small hand-made files."""

from pyspark.sql import functions as F

from seqlake import sources, streaming
from seqlake.sources import sinks


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 some text\nACGT\nAC\n>c2\nTTTT\n")
    df = sources.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r["accession"], r["seq"]) for r in df.collect()) == [("c1", "ACGTAC"), ("c2", "TTTT")]
    sinks.fasta(df, str(tmp_path / "out"))
    assert sorted((r["accession"], r["seq"]) for r in sources.fasta(spark, str(tmp_path / "out")).collect()) == [("c1", "ACGTAC"), ("c2", "TTTT")]
    assert {r["mag"] for r in sources.genome_folder(spark, str(tmp_path / "a.fa")).collect()} == {"a"}


def test_a_mark_inside_a_header_starts_no_record(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 gene a > b\r\nAC GT\r\n>c2\nTT\nGG")
    got = sorted((r["accession"], r["header"], r["seq"]) for r in sources.fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("c1", "c1 gene a > b", "ACGT"), ("c2", "c2", "TTGG")]


def test_protein_headers(spark, tmp_path):
    (tmp_path / "p.faa").write_text(">c1_1 # 2 # 181 # -1 # ID=1_1;partial=10;gc_cont=0.512\nMKL*\n")
    r = sources.proteins(spark, str(tmp_path / "p.faa")).first()
    assert (r["orf_id"], r["start"], r["end"], r["strand"], r["gc"], r["seq"]) == ("c1_1", 2, 181, -1, 0.512, "MKL*")


def test_tables(spark, tmp_path):
    (tmp_path / "h.tab").write_text("q_1\tt_1\t90.5\t100\t5\t1\t1\t100\t2\t101\t1e-10\t200.1\n")
    assert sources.hits(spark, str(tmp_path / "h.tab")).first()["bitscore"] == 200.1
    (tmp_path / "m.tab").write_text("q_1\tX-consensus.1\t1e-9\n")
    assert sources.contamination_hits(spark, str(tmp_path / "m.tab")).first()["target"] == "X"
    (tmp_path / "c.txt").write_text("a b\tc\n\nd\n")
    assert sorted(tuple(r) for r in sources.cluster_file(spark, str(tmp_path / "c.txt")).collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")]
    (tmp_path / "m1.crt").write_text("head\n12\t\tREP\tACGTN\n13\t\tREP\tQQQ\n14\t\tREP\t\n15\t\tREP\tGG\t[ 1 ]\n")
    got = sorted(map(tuple, sources.spacers(spark, str(tmp_path / "m1.crt")).collect()), key=lambda r: r[2])
    assert got == [("m1_CRISPR_0", "m1", 12, "ACGTN", True), (None, "m1", 13, "QQQ", False), ("m1_CRISPR_1", "m1", 15, "GG", True)]
    (tmp_path / "k.csv").write_text("h," + ",".join(["0.25"] * 16) + "\n")
    assert sources.kmer_table(spark, str(tmp_path / "k.csv"), 2).first()["v"] == [0.25] * 16
    (tmp_path / "n.json").write_text('{"Genus": ["A", "B"], "Family": []}')
    assert sorted(tuple(r) for r in sources.valid_names(spark, str(tmp_path / "n.json")).collect()) == [("Genus", 0, "A"), ("Genus", 1, "B")]
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "x.csv").write_text("a,b\n1,2\n")
    (d / "y.tsv").write_text("a\tb\n3\t4\n")
    assert sorted(tuple(r) for r in sources.tables_by_extension(spark, str(d), "a int, b int").collect()) == [(1, 2), (3, 4)]


def test_search_xml(spark, tmp_path):
    (tmp_path / "b.xml").write_text(
        "<R><Iteration><Iteration_query-ID>Query_1</Iteration_query-ID><Iteration_query-def>q_1 x</Iteration_query-def><Iteration_hits><Hit><Hit_id>gnl|BL_ORD_ID|1</Hit_id><Hit_def>t_9 y</Hit_def><Hit_accession>1</Hit_accession><Hit_hsps><Hsp><Hsp_bit-score>120.7</Hsp_bit-score><Hsp_evalue>1e-5</Hsp_evalue>"
        "<Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>2</Hsp_hit-from><Hsp_hit-to>11</Hsp_hit-to><Hsp_identity>8</Hsp_identity><Hsp_gaps>1</Hsp_gaps><Hsp_align-len>10</Hsp_align-len>"
        "<Hsp_qseq>AB-DEFGHIJ</Hsp_qseq><Hsp_hseq>ABCDEFGHIK</Hsp_hseq><Hsp_midline>AB DEFGHI </Hsp_midline></Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></R>"
    )
    r = sources.blast_xml(spark, str(tmp_path / "b.xml")).first()
    assert (r["qseqid"], r["sseqid"], r["pident"], r["mismatch"], r["gapopen"], r["bitscore"]) == ("q_1", "t_9", 80.0, 1, 1, 120.0)


def test_open_frames(spark):
    seq = "CC" + "ATG" + "AAA" * 30 + "TAA" + "G"
    comp = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([("f", seq), ("r", comp)], "accession string, seq string")
    got = {r["accession"]: (r["start"], r["end"], r["strand"]) for r in sources.open_frames(df).collect()}
    assert got == {"f": (3, 98, 1), "r": (2, 97, -1)}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">c1\n" + "A" * 3000 + "\n>c2\nACGT\n")
    shares = spark.createDataFrame([("c1", 0.9, 0.9)], "accession string, score double, proportion double")
    q = streaming.to_parquet(streaming.calls(streaming.contigs(spark, str(folder)), shares), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["accession"]: r["pred"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"c1": "virus", "c2": "filtered by length"}


def test_tsv_sink(spark, tmp_path):
    sinks.tsv(spark.createDataFrame([("a", None)], "x string, y int"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["y"] == "-"
    sinks.fasta(spark.createDataFrame([("a", "AC", "high")], "accession string, seq string, k string"), str(tmp_path / "f"), by="k")
    assert spark.read.text(str(tmp_path / "f")).where(F.col("k") == "high").count() == 2
