"""Operator 7: benchmark decontamination by one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import OWN, table

#: A window is so many consecutive item words; a shorter item is one window.
WINDOW = 10
#: The automaton is broadcast; more benchmark text than this is scanned in several passes of one automaton each.
BENCHMARK_BYTES = 32 << 20
#: Bytes A-Z lowered, and every byte that is not of a word made a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in the original text, before A-Z are lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8; every byte of a non-ASCII character is a word byte."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (first, end) spans in order; touching spans join."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


class Scanner:
    """An automaton on word numbers: words outside the benchmark are 0, so a text is scanned once, word by word."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in fold_words(text))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(w[i : i + window], set()).add(k)
        self.shortest = min(map(len, found), default=1)
        for w, owners in found.items():
            self.automaton.add_word(w, (len(w), tuple(sorted(owners))))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged (first, end) word spans inside occurrences of windows, and the numbers of items with one."""
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        if not self.any or len(words) < self.shortest:
            return [], owners
        get = self.number.get
        for last, (n, own) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            owners.update(own)
            spans.append((last - n + 1, last + 1))
        return merge(spans), owners


def _batches(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Benchmark items in groups of at most BENCHMARK_BYTES of text, read through an iterator."""
    group, size = [], 0
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if group and size + len(r[1]) > BENCHMARK_BYTES:
            yield group
            group, size = [], 0
        group.append((r[0], r[1]))
        size += len(r[1])
    yield group


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add to each row of docs: n_words, n_hit, items (array of item ids as strings, sorted), hit_spans.

    hit_spans are (start, end) code points of the original text, end exclusive, merged over touching hit words.
    Null or empty text and text without words have no words and no hits. Items with null or wordless text have no
    window. Items with a null id count as id "null". Repeated items count once for each distinct id. Empty tables give
    no hits. Columns of docs with the names of added ones are replaced.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "items", "hit_spans"]
    out = docs.drop(*added)
    passes = list(_batches(benchmark, item_id, item_text)) if benchmark.select(F.sum(F.octet_length(item_text))).first()[0] or 0 else [[]]
    schema = "`{0}` {1}"
    fields = ", ".join(schema.format(f.name, f.dataType.simpleString()) for f in out.schema)
    for k, items in enumerate(passes):
        scanner = spark.sparkContext.broadcast(items)
        out = out.mapInArrow(_scan(scanner, text_col, window, first=k == 0), fields + ", n_words bigint, n_hit bigint, items array<string>, hit_spans array<struct<start:int,end:int>>")
        fields = ", ".join(schema.format(f.name, f.dataType.simpleString()) for f in out.schema if f.name not in added)
    return out


def _scan(items, text_col: str, window: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items.value, window)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            old = None if first else [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("items", "hit_spans")]
            n_words, n_hit, ids, spans = [], [], [], []
            for i, t in enumerate(texts):
                t = t.as_py()
                w = fold_words(t)
                hit, owners = scanner.scan(w)
                found = {"null" if scanner.ids[k] is None else str(scanner.ids[k]) for k in owners}
                at: list[tuple[int, int]] = []
                if old:
                    found |= set(old[0][i])
                if hit or old and old[1][i]:
                    where = [m.span() for m in WORD.finditer(t)]
                    if old:  # spans of earlier passes, as word numbers again
                        starts = [x for x, _ in where]
                        hit = merge(hit + [(bisect_left(starts, x["start"]), bisect_left(starts, x["end"])) for x in old[1][i]])
                    at = [(where[x][0], where[y - 1][1]) for x, y in hit]
                n_words.append(len(w))
                n_hit.append(sum(y - x for x, y in hit))
                ids.append(sorted(found))
                spans.append([{"start": s, "end": e} for s, e in at])
            keep = [i for i, f in enumerate(b.schema) if f.name not in ("n_words", "n_hit", "items", "hit_spans")]
            cols = [b.column(i) for i in keep]
            cols += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols, names=[b.schema.field(i).name for i in keep] + ["n_words", "n_hit", "items", "hit_spans"])

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the hit spans cut out of the text (the words inside occurrences of windows), same columns.

    A text left without a word stays as it then is. chars_col, if there, is set to the new length.
    """
    found = find_leaks(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(OWN + "row"), F.col(text_col).alias(OWN + "t")), benchmark, OWN + "t")
    cut = F.aggregate(
        "hit_spans",
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["s"], F.substring(F.col(OWN + "t"), a["at"] + 1, x["start"] - a["at"])).alias("s"), x["end"].alias("at")),
        lambda a: F.concat(a["s"], F.substring(F.col(OWN + "t"), a["at"] + 1, F.length(OWN + "t"))),
    )
    new = F.when(F.col("n_hit") > 0, cut).otherwise(F.col(OWN + "t"))
    out = found.select(F.col(OWN + "row"), new.alias(OWN + "new"))
    cols = []
    for c in docs.columns:
        v = F.col(OWN + "new") if c == text_col else F.col(f"{OWN}row.`{c}`")
        if c == chars_col:
            v = F.when(F.col(OWN + "row")[c].isNotNull(), F.length(OWN + "new")).cast(docs.schema[c].dataType)
        cols.append(v.alias(c))
    return out.select(*cols)


def op7_aho_corasick(spark, sf_dir: str) -> DataFrame:
    """Query: hit words and items of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the query: windows of items looked up among the windows of documents."""
    w = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    k = WINDOW
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {w('text')} AS w FROM {docs}),
b AS (SELECT item_id, {w('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) <= {k} THEN [w] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i+{k - 1}]) END) AS p FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT len(p) AS n FROM p),
s AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i+n-1])) AS p FROM d, n WHERE len(w) >= n),
h AS (SELECT rid, n, i, item_id FROM s JOIN p ON s.p = p.p),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN o USING (rid)"""
