"""Explicit schemas of the text formats, so that no read infers types."""

HITS12 = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
HITS14 = HITS12 + ", qlen int, slen int"
ABC = "qseqid string, sseqid string, pident double, bitscore double"
SPACER_HITS = "qseqid string, sseqid string, evalue double, pident double, length int, slen int"
PROPHAGE_HITS = "qseqid string, sseqid string, evalue double, pident double, length int"
TRNA_HITS = "virus string, sseqid string, evalue double, pident double, length int, slen int"
CONTAMINATION_HITS = "query string, target string, evalue double"
TREE_HITS = "qseqid string, sseqid string, qlen int, slen int, length int, pident double, evalue double"
PAIRS = "query string, target string, aai double, sgenes int, qcov double, tcov double, qgenes int, tgenes int"
NODES = "taxid int, parent int, rank string"
NAMES = "taxid int, name string"
PROTEIN_TAXID = "protein string, taxid int"
GENOMES = "accession string, lineage string, length int, genus string"
ID_MAP = "dbid string, refid string"
MARKERS = "domain string, category string, description string"
GTDB = "user_genome string, classification string"
