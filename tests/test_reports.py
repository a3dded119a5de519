"""Search reports: rules of the tabular format, placeholders, damage, splitting, routing and reading back."""

import random

import pytest

from seqlake import sources
from seqlake.sources import reports


def _hsp(q, s, mid=None, ident=None, n=None, bits="57.26", e="1.6e-05", at=(1, 9, 4, 12)):
    mid = "".join(a if a == b and a != "-" else " " for a, b in zip(q, s)) if mid is None else mid
    ident = sum(a == b for a, b in zip(q, s)) if ident is None else ident
    tags = zip(("query-from", "query-to", "hit-from", "hit-to"), at)
    return (f"<Hsp><Hsp_bit-score>{bits}</Hsp_bit-score><Hsp_evalue>{e}</Hsp_evalue>" + "".join(f"<Hsp_{t}>{v}</Hsp_{t}>" for t, v in tags)
            + f"<Hsp_identity>{ident}</Hsp_identity><Hsp_align-len>{len(q) if n is None else n}</Hsp_align-len><Hsp_qseq>{q}</Hsp_qseq><Hsp_hseq>{s}</Hsp_hseq><Hsp_midline>{mid}</Hsp_midline></Hsp>")


def _hit(id_, text, accession, *hsps):
    return f"<Hit><Hit_id>{id_}</Hit_id><Hit_def>{text}</Hit_def><Hit_accession>{accession}</Hit_accession><Hit_hsps>{''.join(hsps)}</Hit_hsps></Hit>"


def _record(id_, text, *hits):
    return f"<Iteration>\n<Iteration_query-ID>{id_}</Iteration_query-ID>\n<Iteration_query-def>{text}</Iteration_query-def>\n<Iteration_query-len>9</Iteration_query-len>\n<Iteration_hits>\n{''.join(hits)}\n</Iteration_hits>\n</Iteration>\n"


def _write(path, *records):
    path.write_text(reports.HEAD + "".join(records) + reports.FOOT)
    return str(path)


def test_rules_of_the_tabular_format(spark, tmp_path):
    one = _hsp("ACD-FG--K", "ACDEYGHIK", "ACD  G  K")
    at = _write(
        tmp_path / "r.xml", _record("Query_1", "q1_1 first gene", _hit("sp|P1", "a protein", "P1", one), _hit("gnl|BL_ORD_ID|7", "real7 named", "7", _hsp("MKX", "MKX", "MKX", bits="123.9", e="0"))),
        _record("Query_1a", "other text", _hit("Subject_3", "real3 more", "Subject_3", _hsp("MK", "MK")), _hit("Subject_3a", "kept", "Subject_3a", _hsp("MR", "MK", "M+"))), _record("q9", "no hits"),
        _record("A&amp;B", "x", _hit("s&1", "y", "z", _hsp("--MK--", "AAMKAA", "  MK  "))),
    )
    got = {(r.qseqid, r.sseqid): r for r in sources.blast_xml(spark, at).collect()}
    assert set(got) == {("q1_1", "sp|P1"), ("q1_1", "real7"), ("Query_1a", "real3"), ("Query_1a", "Subject_3a"), ("Aamp;B", "s1")}
    r = got["q1_1", "sp|P1"]
    assert (r.pident, r.length, r.mismatch, r.gapopen, r.qstart, r.qend, r.sstart, r.send, r.evalue, r.bitscore) == (round(500 / 9, 3), 9, 1, 2, 1, 9, 4, 12, 2e-05, 57.3)
    assert (got["q1_1", "real7"].bitscore, got["q1_1", "real7"].evalue, got["Query_1a", "Subject_3a"].mismatch) == (123.0, 0.0, 1)
    assert got["Aamp;B", "s1"].gapopen == 0


@pytest.mark.parametrize("bad,says", [(_hsp("MKK", "MKK", "MK"), "lengths"), (_hsp("MKK", "MKK", n=4), "lengths"), (_hsp("MKK", "MRR", "MKK"), "mismatches"), (_hsp("MKK", "MRK", "M K", ident=3), "identities")])
def test_stretches_that_cannot_be_stop_the_job(spark, tmp_path, bad, says):
    at = _write(tmp_path / "r.xml", _record("q", "d", _hit("s", "d", "a", bad)))
    with pytest.raises(Exception, match=f"q vs s {says}"):
        sources.blast_xml(spark, at).select("qseqid", "mismatch").collect()


def test_damage_is_an_error(spark, tmp_path):
    whole = reports.HEAD + _record("q", "d", _hit("s", "d", "a", _hsp("MK", "MK"))) + _record("r", "d", _hit("s", "d", "a", _hsp("MK", "MK")))
    (tmp_path / "cut.xml").write_text(whole[: whole.rindex("<Hsp_qseq>") + 8])
    with pytest.raises(Exception):
        sources.blast_xml(spark, str(tmp_path / "cut.xml")).collect()


def test_one_file_is_read_by_many_tasks_and_routed(spark, tmp_path):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    made = [_record(f"Query_{i}", f"g{i % 7}_{i} text", *[_hit(f"s{j}", "d", "a", _hsp(w := word(60), w)) for j in range(3)]) for i in range(400)]
    at = _write(tmp_path / "big.xml", *made)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        records = sources.report_records(spark, at)
        assert records.rdd.getNumPartitions() > 5 and records.count() == 400
        want = sorted(tuple(r) for r in sources.blast_xml(spark, at).collect())
        assert len(want) == 1200
        wanted = spark.createDataFrame([(f"g{i % 7}_{i}", f"g{i % 7}") for i in range(400) if i % 7 < 3] + [("g0_0", "again"), ("unknown", "g9")], "qseqid string, grp string")
        out = str(tmp_path / "routed")
        sources.write_reports(records, wanted, out)
        for g in ("g0", "g1", "g2"):
            assert sorted(tuple(r) for r in sources.blast_xml(spark, f"{out}/grp={g}").collect()) == [r for r in want if r[0].startswith(g + "_")]
        assert {r.qseqid for r in sources.blast_xml(spark, f"{out}/grp=again").collect()} == {"g0_0"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
