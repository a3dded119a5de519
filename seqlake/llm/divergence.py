"""Source divergence audit: how far the word use of each source of a language lies from its other sources and from the language.

Documents are counted into (language, source, term) sums in the tasks that read them. The terms that a language keeps are
sorted over the whole table by range partitions and cut into chunks; within a chunk a term's id is its place in the sorted
array (searchsorted), and each source's counts are a vector over those ids (bincount). As ids follow UTF-8 order, ties
between terms end by id.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import discard, materialize, table

#: Terms that a chunk has at most, and sums that it may hold before it ends at the next term.
CHUNK, SUMS = 4096, 1_000_000
#: Sources that are compared in one task: a language with more has a task for each chunk and pair of blocks.
BLOCK = 256
#: (term, source) sums that a task holds before it hands them on.
HELD = 400_000
SCALE_STEPS = (1000, 1000, 1000)  # their product is the scale of p

#: Lower-cases A-Z, keeps a-z and all bytes of non-ASCII characters, and makes everything else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SUMS = "lang binary, source binary, term binary, n long, docs long"
_CHUNKS = "lang binary, chunk binary, source binary, terms array<binary>, ids array<int>, counts array<long>"
_FOUND = "lang binary, source binary, part string, item binary, value long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, by language and source, summed as far as HELD entries go."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            if own:
                seen, size = docs[lang, source], len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.binary()), pa.array([source] * size, pa.binary()), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64()), pa.array([seen[t] for t in own], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        n.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = text.translate(_FOLD).split()
            n[lang, source].update(terms)
            docs[lang, source].update(set(terms))
        if sum(map(len, n.values())) > HELD:
            yield from out()
    yield from out()


def _encoder(chunk: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (lang, term, source, n) rows as chunks: a row for the language, with the sorted terms, and one for each source in the chunk."""
        lang, terms, of, sources, n = None, [], [], [], []

        def out() -> pa.RecordBatch:
            words = np.empty(len(terms), object)
            words[:] = terms
            every = np.empty(len(of), object)
            every[:] = of
            ids = np.searchsorted(words, every)
            names, who = np.unique(np.array(sources, object), return_inverse=True)
            counts = np.array(n, np.int64)
            order = np.argsort(who, kind="stable")
            cut = np.searchsorted(who[order], np.arange(1, len(names)))
            parts = [(None, terms, np.arange(len(terms)), np.bincount(ids, counts, len(terms)).astype(np.int64))]
            parts += [(s, None, ids[at], counts[at]) for s, at in zip(names, np.split(order, cut), strict=True)]
            k = len(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.binary()), pa.array([terms[0]] * k, pa.binary()), pa.array([x[0] for x in parts], pa.binary()), pa.array([x[1] for x in parts], pa.list_(pa.binary())),
                 pa.array([x[2].astype(np.int32) for x in parts], pa.list_(pa.int32())), pa.array([x[3] for x in parts], pa.list_(pa.int64()))],
                ["lang", "chunk", "source", "terms", "ids", "counts"],
            )

        for b in batches:
            for own, term, source, count in zip(*(b.column(c).to_pylist() for c in ("lang", "term", "source", "n")), strict=True):
                if not terms or term != terms[-1] or own != lang:
                    if terms and (own != lang or len(terms) >= chunk or len(of) >= SUMS):
                        yield out()
                        terms, of, sources, n = [], [], [], []
                    lang = own
                    terms.append(term)
                of.append(term)
                sources.append(source)
                n.append(count)
        if terms:
            yield out()

    return encode


def _share(counts: np.ndarray, size: int, kept: int) -> np.ndarray:
    """p = 1 + floor(10^9 (count + 2) / (size + 2 kept)), by long division, so that no product leaves 64 bits."""
    whole = size + 2 * kept
    rest, p = counts + 2, np.zeros_like(counts)
    for step in SCALE_STEPS:
        rest = rest * step
        p = p * step + rest // whole
        rest %= whole
    return p + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    def compare(group: pa.Table) -> pa.Table:
        """One chunk of one language, for two blocks of its sources: partial sums of all pairs; its best terms where the blocks are one."""
        rows = group.select(["source", "block", "size", "kept", "width", "ids", "counts", "terms"]).to_pylist()
        lang, lo, hi, width = group["lang"][0].as_py(), group["lo"][0].as_py(), group["hi"][0].as_py(), rows[0]["width"]
        own = sorted((r for r in rows if r["source"] is not None), key=lambda r: r["source"])
        dense = {r["source"]: np.bincount(np.array(r["ids"] or [], np.int64), np.array(r["counts"] or [], float), width).astype(np.int64)[:width] for r in own}
        p = {r["source"]: _share(dense[r["source"]], r["size"], r["kept"]) for r in own}
        found = []
        first, second = ([r["source"] for r in own if r["block"] == k] for k in (lo, hi))
        other = np.stack([p[s] for s in second]) if second else np.zeros((0, width), np.int64)
        for i, a in enumerate(first):
            at = i + 1 if lo == hi else 0
            for b, value in zip(second[at:], _gap(other[at:], p[a]).sum(1), strict=True):
                found.append((a, "pair", b, int(value)))
        for whole in (r for r in rows if r["source"] is None and width):
            q = _share(np.array(whole["counts"], np.int64), whole["size"], whole["kept"])
            for a in first:
                ids = np.flatnonzero((dense[a] > 0) & (p[a] > q))
                value = _gap(p[a][ids], q[ids])
                for k in np.lexsort((ids, -value))[:top]:
                    found.append((a, "term", whole["terms"][ids[k]], int(value[k])))
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array([lang] * len(found), pa.binary()), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.binary(), pa.int64()), strict=True))], names=["lang", "source", "part", "item", "value"])

    return compare


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """One row for each (lang, source, other source) and for each of the `top` terms of a source: lang, source, part, item, value, rank.

    A language keeps the terms that at least `least_docs` of its documents (rows) have. With p = 1 + floor(10^9 (count + 2) /
    (N + 2 V)) and f = floor((p - q)^2 / (p + q)), all in integers: part `pair` gives the sum of f over the kept terms
    against each other source of the language, part `term` the terms that the source uses more than its language, ranked by f.

    Null text, lang and source are ''. A text without terms still makes its group occur; a language that keeps no term
    gives pairs of value 0; a source alone in its language has no pairs. Repeated rows count as often as they occur. An
    empty table gives no row. Other columns are not read. The pairs of a language are as many as its sources squared: that
    is the report, and no (document or term) rows are paired.
    """
    as_bytes = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c)
    plain = docs.select(as_bytes("lang"), as_bytes("source"), as_bytes("text"))
    sums = plain.mapInArrow(_sums, _SUMS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = sums.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all") >= least_docs)
    chunks = materialize(kept.select("lang", "term", "source", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_encoder(CHUNK), _CHUNKS), "audit-chunks")

    whole, own = chunks.where("source is null"), chunks.where("source is not null")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    groups = plain.select("lang", "source").distinct()
    by = Window.partitionBy("lang")
    groups = groups.withColumn("block", F.floor((F.row_number().over(by.orderBy("source")) - 1) / BLOCK).cast("int")).withColumn("blocks", F.max("block").over(by) + 1)
    of_lang = whole.groupBy("lang").agg(F.sum(total).alias("all"), F.sum(F.size("terms")).alias("kept"))
    of_group = own.groupBy("lang", "source").agg(F.sum(total).alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").select("lang", "source", "block", "blocks", zero("size"), zero("all"), zero("kept"))
    groups = materialize(groups, "audit-groups")

    per_lang = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("all").alias("all"), F.max("kept").alias("kept"))
    grid = per_lang.join(whole.select("lang", "chunk", F.size("terms").alias("width")), "lang", "left").select("lang", F.coalesce("chunk", F.lit(b"")).alias("chunk"), F.coalesce("width", F.lit(0)).alias("width"))
    pair = lambda x: F.struct(F.least(x, F.col("block")).alias("lo"), F.greatest(x, F.col("block")).alias("hi"))
    vectors = grid.join(groups, "lang").join(own.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    vectors = vectors.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).withColumn("terms", F.lit(None).cast("array<binary>"))
    whole = whole.join(per_lang, "lang").withColumns({"size": F.col("all"), "width": F.size("terms"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).withColumn("at", F.struct(F.col("block").alias("lo"), F.col("block").alias("hi")))
    columns = ["lang", "chunk", "at.lo", "at.hi", "source", "block", "size", "kept", "width", "ids", "counts", "terms"]
    found = materialize(vectors.select(*columns).unionByName(whole.select(*columns)).groupBy("lang", "chunk", "lo", "hi").applyInArrow(_compare(top), _FOUND), "audit-found")
    discard(chunks, groups)

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", ranked)
    terms = found.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    text = lambda c: F.col(c).cast("string").alias(c)
    return pairs.unionByName(terms).select(text("lang"), text("source"), "part", text("item"), "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
each AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM tok GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM each GROUP BY ALL HAVING sum(docs) >= 10),
size AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, CAST(sum(each.n) AS BIGINT) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(each.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(each.n, 0) + 2) // (coalesce(gn.n, 0) + 2 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (kept.n + 2) // (size.n + 2 * v) AS q
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN each ON each.lang = g.lang AND each.source = g.source AND each.term = kept.term),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN two ON two.lang = x.lang AND two.source = x.source AND two.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms) WHERE rank <= 10"""
