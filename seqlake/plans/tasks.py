"""The eight tasks and their end-to-end composition, over tables supplied as DataFrames.

Inputs are contigs (accession, length, seq), ORFs (orf_id, start, end, strand, gc), alignment tables (see schemas) and
dimensions. Every task returns DataFrames; sinks.tsv writes them with `-` for null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.config import Config
from seqlake.functions import coverage_to_qend, format_value, genome_of
from seqlake.operators import annotation, besthit, evidence, graph, kmers, models, msa, pairs, regions, taxonomy
from seqlake.storage import materialize

PROKARYOTIC = "Prokaryotic virus"


def identify(contigs: DataFrame, orfs: DataFrame, hits: DataFrame, config: Config, scores: DataFrame | None = None) -> DataFrame:
    """Virus calls. scores: (accession, score) of a model; without it the mapped share of ORFs decides."""
    share = models.mapped_share(orfs, hits)
    j = contigs.select("accession", "length").join(share, "accession", "left")
    j = j.join(scores.select("accession", "score"), "accession", "left") if scores is not None else j.withColumn("score", F.lit(None).cast("double"))
    called = models.virus_call(j, config.min_length, config.reject / 100)
    return called.select("accession", "length", "pred", "proportion", "call_score", "confidence")


def viruses(contigs: DataFrame, calls: DataFrame) -> DataFrame:
    return contigs.join(calls.where("pred = 'virus'").select("accession"), "accession", "left_semi")


def recruit(contigs: DataFrame, proteins: DataFrame, calls: DataFrame | None = None, longer: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(viral contigs of more than `longer` bases, their proteins); without calls all contigs count as viral."""
    own = (viruses(contigs, calls) if calls is not None else contigs).where(F.col("length") > longer)
    known = own.select("accession")
    return own, proteins.withColumn("accession", genome_of(F.col("orf_id"))).join(known, "accession", "left_semi").drop("accession")


def gene_to_genome(hits: DataFrame) -> DataFrame:
    """(protein_id, contig_id, keywords) of all proteins that have a hit."""
    p = hits.select(F.col("qseqid").alias("protein_id")).distinct()
    return p.select("protein_id", genome_of(F.col("protein_id")).alias("contig_id"), F.lit("hypothetical protein").alias("keywords"))


def units(contigs: DataFrame, hits: DataFrame, orfs: DataFrame, config: Config) -> DataFrame:
    """Species or genus units, as config.mode says."""
    return species_units(contigs, hits, config) if config.mode == "ANI" else genus_units(contigs, hits, orfs, config)


def annotate(orfs: DataFrame, hits: DataFrame, names: DataFrame, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotated genes, annotation rates) from 12-column hits and (protein, description).

    With references (protein, reference), inference is the hit's reference protein; without them the hit's description
    stands in for it, `-` where it has none.
    """
    best = besthit.best_hit(hits).withColumn("coverage", coverage_to_qend(F.col("length"), F.col("qend")))
    known = names.select("protein", F.col("description").alias("reference")) if references is None else references
    genes = annotation.annotate(orfs, best, names, known)
    return genes, annotation.annotation_rate(genes)


def gene_table(genes: DataFrame) -> DataFrame:
    """Annotated genes as the output table has them: identity and coverage with two places, 0.00 without a hit; gc and places as given."""
    two = lambda c: format_value(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    given = [F.col(c) for c in ("start", "end", "strand", "gc") if c in genes.columns]
    return genes.select(genome_of(F.col("orf_id")).alias("genome"), "orf_id", *given, "annotation", two("pident"), two("coverage"), F.col("inference").alias("closest_gene"))


def taxonomy_calls(contigs: DataFrame, orfs: DataFrame, hits: DataFrame, protein_taxa: DataFrame, nodes: DataFrame, names: DataFrame, config: Config, root: object = 1) -> DataFrame:
    """(accession, length, status, lineage, scores): near-top hits -> ORF ancestor -> weighted ancestor -> names.

    status says why a lineage is missing: filtered by length, no ORFs found, no hits to database, no known taxa.
    """
    tree = taxonomy.closure(nodes)
    near = besthit.near_top(hits, config.near_top)
    # inner join first: only taxa that were hit reach the tree
    mapped = near.join(protein_taxa, near["sseqid"] == protein_taxa["protein"]).select(F.col("qseqid").alias("orf"), "taxid", "bitscore")
    lca = taxonomy.orf_lca(mapped, tree).where("lca is not null")
    path = taxonomy.weighted_lca(lca.select(genome_of(F.col("orf")).alias("contig"), F.col("lca").alias("taxid"), "bits"), tree, config.lca_share)
    named = taxonomy.lineage_strings(path, names, root).withColumnRenamed("contig", "accession")
    has = lambda d, c, out: d.select(genome_of(F.col(c)).alias("accession")).distinct().withColumn(out, F.lit(True))
    j = contigs.select("accession", "length").join(has(orfs, "orf_id", "_orfs"), "accession", "left").join(has(hits, "qseqid", "_hits"), "accession", "left").join(named, "accession", "left")
    status = (
        F.when(F.col("length") < config.min_length, "filtered by length").when(F.col("_orfs").isNull(), "no ORFs found").when(F.col("_hits").isNull(), "no hits to database")
        .when(F.col("lineage").isNull(), "no known taxa").otherwise("ok")
    )
    ok = F.col("length") >= config.min_length
    return j.select("accession", "length", status.alias("status"), F.when(ok, F.col("lineage")).alias("lineage"), F.when(ok, F.col("scores")).alias("scores"))


def similarity_edges(db_hits: DataFrame, self_hits: DataFrame, q_orfs: DataFrame, db_orfs: DataFrame, config: Config, db_pairs: DataFrame | None = None) -> DataFrame:
    """(query, target, score) among queries and references; db_pairs are precomputed reference pairs."""
    q, t = pairs.genome_sizes(q_orfs), pairs.genome_sizes(db_orfs)
    both = q.unionByName(t)
    p = pairs.amino_acid_identity(db_hits, both, both, both_ways=True).unionByName(pairs.amino_acid_identity(self_hits, q, q))
    if db_pairs is not None:
        p = p.unionByName(db_pairs.select(*p.columns))
    return pairs.edges(p, config.aai, config.pair_cover, config.share).select("query", "target", "score")


def genus_clusters(edges: DataFrame, members: DataFrame, config: Config) -> DataFrame:
    """Markov clusters with labels spread and names: members has (node, length, is_ref, genus, lineage)."""
    c = graph.markov_clusters(edges.select(F.col("query").alias("a"), F.col("target").alias("b"), F.col("score").alias("w")), config.inflation)
    every = members.select("node").join(c, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
    spread = graph.propagate(members.join(every, "node"))
    return spread.join(graph.number_clusters(every).select("node", F.col("name").alias("cluster_name")), "node")


def prokaryotic_flag(calls: DataFrame, groups: list[str]) -> DataFrame:
    return calls.withColumn(PROKARYOTIC, evidence.any_substring(F.col("lineage"), groups))


def host_evidence(config: Config, spacers: DataFrame | None = None, prophages: DataFrame | None = None, trna: DataFrame | None = None, kmer: DataFrame | None = None, aai: DataFrame | None = None, spacers_db: DataFrame | None = None) -> DataFrame:
    """All host evidence as (accession, host, score, method, priority), scores 0 to 1; absent sources are left out."""
    m = evidence.METHODS
    found = [
        (spacers, lambda d: evidence.crispr(d, config.spacer_identity, config.spacer_cover), m[0]), (prophages, lambda d: evidence.prophage(d, config.prophage_length), m[1]),
        (trna, lambda d: evidence.trna(d, config.trna_cover), m[2]), (kmer, lambda d: d, m[3]), (aai, lambda d: d, m[4]), (spacers_db, lambda d: evidence.crispr_db(d, config.spacer_identity, config.spacer_cover), m[5]),
    ]
    parts = [evidence.evidence(rule(d), name) for d, rule, name in found if d is not None]
    if not parts:
        raise ValueError("host prediction needs at least one evidence table")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def host(contigs: DataFrame, rows: DataFrame, config: Config, lineages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one host for each contig with the reason where none, all hosts). lineages: (host, lineage)."""
    one = evidence.by_precedence(rows)
    if lineages is not None:
        one = evidence.lookup(one, lineages, "host", "lineage")
    out = evidence.with_reason(contigs.select("accession", "length"), one, "accession", "host", config.min_length)
    rest = [c for c in one.columns if c not in ("host", "priority")]
    return out.join(one.select(*rest), "accession", "left"), evidence.multi(rows).orderBy("accession", F.col("score").desc())


def kmer_host(viruses_: DataFrame, hosts: DataFrame, known: DataFrame | None = None, densities: dict | None = None, protein_hits: DataFrame | None = None, taxa: DataFrame | None = None, components: int = 1, profiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(accession, host, score): the host whose tetranucleotide profile the density of the virus's length finds likeliest.

    Densities are fitted to the profile differences of `known` pairs (accession, host) among both tables, one mixture of
    `components` Gaussians for each of the five length models, or given: length model (1 to 5) -> log-density. A virus of a
    length that no known pair has gets no row. With protein_hits (qseqid, mag, pident) a call stands only if hits bear it
    out (see evidence.kmer_gate), and the score is their identity. `profiles` are those of the viruses and of the hosts
    (id, v), if they are already made.
    """
    if (known is None) == (densities is None):
        raise ValueError("either known pairs or fitted densities are needed")
    q = profiles[0] if profiles else kmers.profiles(viruses_.select(F.col("accession").alias("id"), "seq"))
    q = q.join(viruses_.select(F.col("accession").alias("id"), kmers.length_model(F.col("length")).alias("model")), "id")
    refs = profiles[1] if profiles else kmers.profiles(hosts.select(F.col("accession").alias("id"), "seq"))
    if known is not None:
        densities = kmers.fit_mixtures(kmers.pair_differences(known.select(F.col("accession").alias("id"), F.col("host").alias("ref")), q, refs), components)
    best = kmers.density_argmax(q, refs, densities)
    calls = best.select(F.col("id").alias("accession"), F.col("best").alias("host"), "score")
    if protein_hits is None:
        return calls
    calls = materialize(calls, "kmer-calls")
    of = genome_of(F.col("qseqid"))
    own = protein_hits.join(calls.select(F.col("accession").alias("_called")).distinct(), of == F.col("_called"), "left_semi")
    return evidence.kmer_gate(calls, materialize(evidence.mag_identity(own), "mag-identity"), taxa)


def lifestyle(calls: DataFrame, logits: DataFrame | None, config: Config) -> DataFrame:
    """Temperate or virulent for prokaryotic viruses. Without a model's (accession, logits) the type is null, not a guess."""
    j = calls.join(logits, "accession", "left") if logits is not None else calls.withColumn("logits", F.lit(None).cast("array<double>"))
    t = models.lifestyle(j)
    masked = F.when(F.col("length") < config.min_length, "filtered by length").when(F.col(PROKARYOTIC) == "Y", F.col("type")) if PROKARYOTIC in calls.columns else F.col("type")
    return t.select("accession", "length", masked.alias("type"), "type_score")


def contamination(contigs: DataFrame, genes: DataFrame, marker_hits: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quality for each contig, regions); a contig too short for a k-mer has depth 1. genes: (accession, orf_id, gene_no, start, end, gc)."""
    labelled = regions.label_genes(genes, besthit.first_per_key(marker_hits, ["orf_id"], [F.col("evalue"), F.col("target")]).select("orf_id", "target"), markers)
    found = regions.define_regions(labelled, contigs)
    depth = kmers.canonical_depth(contigs.select(F.col("accession").alias("id"), F.upper("seq").alias("seq")))
    n = found.groupBy("accession").agg(F.count("*").alias("n_regions"))
    j = contigs.select("accession", "length").join(regions.marker_counts(labelled), "accession", "left").join(n, "accession", "left")
    j = j.join(depth.withColumnRenamed("id", "accession"), "accession", "left").join(regions.region_summary(found, contigs).select("accession", "contamination", "regions"), "accession", "left")
    j = j.fillna(0, ["genes", "viral", "host", "n_regions"]).fillna(0.0, ["contamination"])
    return j.withColumn("quality", regions.quality(F.col("n_regions"), F.col("viral"), F.col("host"), F.coalesce("kmer_freq", F.lit(1.0)))), found


def species_units(contigs: DataFrame, hits: DataFrame, config: Config) -> DataFrame:
    """(accession, unit, representative, length): greedy length-ordered clusters of nucleotide identity and target coverage."""
    e = pairs.ani_edges(pairs.nucleotide_pairs(hits), config.ani, config.target_cover)
    c = graph.greedy_clusters(contigs.select(F.col("accession").alias("node"), "length"), e.select(F.col("qname").alias("src"), F.col("tname").alias("dst")))
    named = graph.number_clusters(c.select("node", F.col("rep").alias("cluster")))
    return named.join(contigs.select(F.col("accession").alias("node"), "length"), "node").select(F.col("node").alias("accession"), F.col("name").alias("unit"), F.col("cluster").alias("representative"), "length")


def genus_units(contigs: DataFrame, self_hits: DataFrame, orfs: DataFrame, config: Config) -> DataFrame:
    """As species_units, by amino-acid identity and Markov clusters; the longest member represents."""
    q = pairs.genome_sizes(orfs)
    e = pairs.edges(pairs.amino_acid_identity(self_hits, q, q), config.aai, config.pair_cover, config.share)
    c = graph.markov_clusters(e.select(F.col("query").alias("a"), F.col("target").alias("b"), F.col("score").alias("w")), config.inflation)
    every = contigs.select(F.col("accession").alias("node"), "length").join(c, "node", "left").select("node", "length", F.coalesce("cluster", "node").alias("cluster"))
    rep = every.groupBy("cluster").agg(F.min_by("node", F.struct((-F.col("length")).alias("l"), "node")).alias("representative"))
    named = graph.number_clusters(every.select("node", "cluster"))
    return named.join(every.select("node", "length"), "node").join(rep, "cluster").select(F.col("node").alias("accession"), F.col("name").alias("unit"), "representative", "length")


def marker_genes(hits: DataFrame, config: Config) -> DataFrame:
    """Best marker of each genome, then the thresholds; hits: tree marker table (see schemas)."""
    return besthit.marker_best(hits.withColumn("genome", genome_of(F.col("qseqid"))), config.marker_identity, config.marker_cover)


def combined_alignment(aligned: DataFrame, every_marker: bool) -> DataFrame:
    """(id, aln) over (marker, id, aln): ids of all markers, or any id with gaps."""
    return msa.intersection(aligned) if every_marker else msa.union(aligned)


def end_to_end(contigs: DataFrame, orfs: DataFrame, hits: DataFrame, protein_taxa: DataFrame, nodes: DataFrame, names: DataFrame, host_rows: DataFrame, groups: list[str], config: Config, scores: DataFrame | None = None, logits: DataFrame | None = None, root: object = 1, skip: bool = False) -> DataFrame:
    """Identify, then taxonomy, host and lifestyle of what is viral (of all with skip), joined in one summary."""
    calls = identify(contigs, orfs, hits, config, scores)
    own = contigs if skip else viruses(contigs, calls)
    tax = prokaryotic_flag(taxonomy_calls(own, orfs, hits, protein_taxa, nodes, names, config, root), groups)
    hosts, _ = host(own, host_rows, config)
    life = lifestyle(tax, logits, config)
    keys = ["accession", "length"]
    parts = [calls.select(*keys, "pred", "call_score", "confidence"), tax.select(*keys, "status", "lineage", PROKARYOTIC), hosts.select(*keys, "host", "method"), life.select(*keys, "type", "type_score")]
    return evidence.summary(parts[1:] if skip else parts, keys)
