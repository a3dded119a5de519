"""Cross-tokenizer alignment: the tokens of two vocabularies over one text, cut where both end.

A text is split before spaces where no token of either vocabulary reaches across, so its tokens are those of its segments.
Documents are gathered in blocks that list each distinct segment once, and are lists of numbers from then on; a block is
written as many small rows, so that neither readers nor writers hold whole blocks. Sorted by segment, the blocks' lists meet: each segment is tokenised and aligned once for the whole corpus, and every block that has it
gets its alignment back in the same pass. Blocks then put their documents together.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import materialize, table

#: Vocabulary files, readable on every executor.
FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text after which a block of documents ends; a longer document is a block of its own.
BLOCK = 6_000_000
#: Segments of a block in one written row.
CHUNK = 256
#: Marks between the two lists of a group, and between groups, in packed alignments; ids come after them.
_BAR, _STOP, _FIRST_ID = 0, 1, 2


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers with the bytes of their tokens, and the bytes after which a space never begins inside a token."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letter = _byte_letters()
        self.bytes_a = {i: bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.kind = np.uint16 if max(*self.bytes_a, len(self.bytes_b)) + _FIRST_ID < 1 << 16 else np.uint32
        crossing = set(b"\t\n\x0b\x0c\r ")
        for token in (*self.bytes_a.values(), *self.bytes_b):
            crossing.update(token[k - 1] for k in range(1, len(token)) if token[k] == 32)
        if len(crossing) == 256:
            raise ValueError("no place before a space is safe: the vocabularies merge every byte with a space")
        self.split = re.compile(b"(?<=[" + b"".join(re.escape(bytes([x])) for x in range(256) if x not in crossing) + b"])(?= )")

    def segments(self, text: bytes) -> list[bytes]:
        """The segments of space + text, each of which begins with a space. The second tokenizer gives nothing for a lone
        space, so one at the end stays with the segment before."""
        parts = self.split.split(b" " + text)
        if len(parts) > 1 and parts[-1] == b" ":
            parts[-2:] = [parts[-2] + b" "]
        return parts

    def align(self, segments: list[bytes]) -> Iterator[bytes | None]:
        """Each segment's groups, packed as numbers; none if a token list doesn't spell the segment."""
        texts = [s.decode("utf-8", "replace") for s in segments]
        first = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        second = self.b.encode([t[1:] for t in texts], num_threads=1)
        for segment, a, b in zip(segments, first, second, strict=True):
            spelt_a, spelt_b = [self.bytes_a[t] for t in a], [self.bytes_b[t] for t in b]
            if b"".join(spelt_a) != segment or b"".join(spelt_b) != segment:
                yield None
                continue
            packed: list[int] = []
            i = j = from_i = from_j = at_a = at_b = 0
            while i < len(a):
                at_a += len(spelt_a[i])
                i += 1
                while at_b < at_a:
                    at_b += len(spelt_b[j])
                    j += 1
                if at_a == at_b:
                    packed += [*(x + _FIRST_ID for x in a[from_i:i]), _BAR, *(x + _FIRST_ID for x in b[from_j:j]), _STOP]
                    from_i, from_j = i, j
            yield array(self.kind(0).dtype.char, packed).tobytes()

    @functools.cached_property
    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """How the numbers of packed alignments are written: before a mark, and before another id."""
        ids = range(max(*self.bytes_a, len(self.bytes_b)) + 1)
        return tuple(np.array(["|", ";", *(f"{i}{mark}" for i in ids)], object) for mark in ("", ","))


@functools.lru_cache(maxsize=2)
def _load(first: str, second: str) -> Vocabularies:
    return Vocabularies(first, second)


def _gather(first: str, second: str, kind: pa.DataType):
    layout = pa.list_(pa.struct([("id", kind), ("parts", pa.list_(pa.int32()))]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents as lists of numbers into the block's distinct segments, named by task and order within it."""
        from pyspark import TaskContext

        own, numbers, docs, held, made = _load(first, second), {}, [], 0, 0
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            n = np.bincount(np.concatenate([d["parts"] for d in docs]), minlength=len(numbers))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([docs], layout), pa.array([list(numbers)], pa.list_(pa.binary())), pa.array([n], pa.list_(pa.int64()))], ["block", "docs", "segments", "n"]
            )

        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if docs and held + len(text) > BLOCK:
                    yield out()
                    numbers, docs, held, made = {}, [], 0, made + 1
                parts = [numbers.setdefault(s, len(numbers)) for s in own.segments(text)] if text else []
                docs.append({"id": key, "parts": np.array(parts, np.int32)})
                held += len(text) + 64
        if docs:
            yield out()

    return gather


def _cut(first: str, second: str, kind: pa.DataType):
    gather = _gather(first, second, kind)
    shape = pa.schema([("block", pa.int64()), ("id", kind), ("parts", pa.list_(pa.int32())), ("start", pa.int32()), ("segments", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks as rows: one for each document (id, parts), one for each CHUNK segments (start, segments, n)."""
        for b in gather(batches):
            docs, segments, n = (b.column(c)[0].values for c in ("docs", "segments", "n"))
            start = np.arange(0, len(segments), CHUNK, dtype=np.int32)
            ends = pa.array(np.append(start, len(segments)), pa.int32())
            for own, size in (({"id": docs.field("id"), "parts": docs.field("parts")}, len(docs)), ({"start": pa.array(start), "segments": pa.ListArray.from_arrays(ends, segments), "n": pa.ListArray.from_arrays(ends, n)}, len(start))):
                if size:
                    own["block"] = pa.repeat(b.column("block")[0], size)
                    yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(size, f.type) for f in shape], schema=shape)

    return cut


def _align(first: str, second: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by segment: equal segments are neighbours, so each is tokenised once, for all its blocks."""
        own, last, packed = _load(first, second), None, None
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("segment").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            again = distinct[0] == last
            done = [*([packed] if again else []), *own.align(distinct[again:])]
            last, packed = distinct[-1], done[-1]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("number"), b.column("n"), pa.array(done, pa.binary()).take(coded.indices)], ["block", "number", "n", "packed"])

    return align


def _unpack(packed: pa.Array, kind: type) -> tuple[np.ndarray, ...]:
    """Of packed alignments, one after another: the numbers, where each alignment ends, and where its groups' bars and stops are."""
    size, (_, offsets, data) = np.dtype(kind).itemsize, packed.buffers()
    ends = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1] // size if len(packed) else np.zeros(1, np.int32)
    values = np.frombuffer(data, kind, ends[-1] - ends[0], ends[0] * size) if ends[-1] > ends[0] else np.zeros(0, kind)
    return values, (ends[1:] - ends[0]).astype(np.int64), np.flatnonzero(values == _BAR), np.flatnonzero(values == _STOP)


def _links(first: str, second: str):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, a, b, n): the links of each block and how often they stand there, summed for a batch."""
        kind = _load(first, second).kind
        for batch in batches:
            values, ends, bars, stops = _unpack(batch.column("packed"), kind)
            row = np.searchsorted(ends, stops, "right")
            a, b = values[bars - 1].astype(np.int64) - _FIRST_ID, values[stops - 1].astype(np.int64) - _FIRST_ID
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("block").to_numpy()[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(batch.column("n").to_numpy()[row])], ["block", "a", "b", "n"])

    return links


_NUMBERS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


def _compose(kind: pa.DataType, first: str, second: str):
    def compose(docs: pa.Table, rows: pa.Table) -> pa.Table:
        """The documents of one block, from the alignments of its segments and the counts of its links."""
        own = _load(first, second)
        parts, links = rows.filter(rows["number"].is_valid()).sort_by("number"), rows.filter(rows["number"].is_null())
        packed = parts["packed"].combine_chunks() if len(parts) else pa.array([], pa.binary())
        packed = packed if isinstance(packed, pa.Array) else pa.concat_arrays(packed.chunks)
        values, ends, bars, stops = _unpack(packed, own.kind)
        bounds, before = np.append(0, ends), lambda x: np.append(0, np.cumsum(x, dtype=np.int64))
        link = lambda x: values[x - 1].astype(np.int64) - _FIRST_ID
        key = links["a"].to_numpy() << 32 | links["b"].to_numpy()
        order = np.argsort(key)
        at = order[np.searchsorted(key, link(bars) << 32 | link(stops), sorter=order)] if len(bars) else np.zeros(0, np.int64)
        # bars and stops take turns: what stands between a stop and the next bar is of the first vocabulary
        left = before(bars - np.append(-1, stops[:-1]) - 1 if len(bars) else [])
        right = before(stops - bars - 1)
        best, count = before(links["best"].to_numpy(zero_copy_only=False)[at]), before(links["count"].to_numpy()[at])
        group = np.searchsorted(stops, bounds)
        sums = [np.diff(x[group]) for x in (left, right, np.arange(len(stops) + 1), best, count)]

        alone, followed = own.marked
        text = alone[values]
        pair = np.flatnonzero((values[:-1] >= _FIRST_ID) & (values[1:] >= _FIRST_ID))
        text[pair] = followed[values[pair]]
        good = packed.is_valid().to_numpy(zero_copy_only=False)
        text[ends[good] - 1] = "\n"
        groups = np.full(len(packed), "", object)
        groups[good] = "".join(text.tolist()).split("\n")[:-1]

        of = docs["parts"].combine_chunks()
        of = of if isinstance(of, pa.Array) else pa.concat_arrays(of.chunks)
        starts, own_parts = of.offsets.to_numpy(), of.values.to_numpy()
        whole = lambda x: np.diff(before(x[own_parts])[starts])
        fine = (np.diff(starts) > 0) & (whole(~good) == 0)
        numbers = [np.where(fine, whole(x), 0) for x in sums]
        texts = [";".join(groups[own_parts[x:y]].tolist()) if ok else "" for x, y, ok in zip(starts.tolist(), starts[1:].tolist(), fine.tolist(), strict=False)]
        return pa.table([docs["id"], *map(pa.array, numbers), pa.array(texts, pa.string())], names=["id", *_NUMBERS, "groups"])

    return compose


def align_tokens(docs: DataFrame, id_col: str = "doc_id", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    `groups` is `a1,a2|b1;a3|b2,b3`: the ids of both vocabularies between neighbouring places where tokens of both end. A
    link is a pair of tokens that end together, so each group has one. A pair of ids counts as many links as hold it in
    the whole table; n_best is the number of links whose count is the highest of their second id, ties included; count_sum
    is the sum of the counts. A document that is null or empty, or that either tokenizer doesn't spell byte for byte,
    has zeros and '', and its links count nowhere. Documents may repeat, and ids may be null or repeat: each row is one
    document. Columns other than id and text are not read. A document is handled whole; a block's memory is bounded by
    BLOCK or by its one longer document.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, ddl = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    blocks = materialize(plain.mapInArrow(_cut(first, second, kind), f"block long, id {ddl}, parts array<int>, start int, segments array<binary>, n array<long>"), "align-blocks")
    members = blocks.where("parts IS NOT NULL").select("block", "id", "parts")
    listed = blocks.where("start IS NOT NULL").select("block", "start", F.posexplode(F.arrays_zip("segments", "n")).alias("at", "x"))
    listed = listed.select("block", (F.col("start") + F.col("at")).alias("number"), F.col("x.segments").alias("segment"), "x.n")
    parts = materialize(listed.repartition("segment").sortWithinPartitions("segment").mapInArrow(_align(first, second), "block long, number int, n long, packed binary"), "align-parts")

    counted = parts.where("packed IS NOT NULL")
    bad = parts.where("packed IS NULL").groupBy("block").agg(F.collect_list("number").alias("bad"))
    if not bad.isEmpty():
        lost = members.join(bad, "block").where(F.arrays_overlap("parts", "bad")).select("block", F.explode("parts").alias("number")).groupBy("block", "number").agg(F.count("*").alias("lost"))
        counted = counted.join(lost, ["block", "number"], "left").select("block", F.expr("n - coalesce(lost, 0)").alias("n"), "packed")
    links = counted.select("block", "n", "packed").mapInArrow(_links(first, second), "block long, a int, b int, n long").groupBy("block", "a", "b").agg(F.sum("n").alias("n"))
    links = materialize(links, "align-links")
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count")).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    scored = links.select("block", "a", "b").join(counts, ["a", "b"]).select("block", none("int", "number"), none("binary", "packed"), F.col("a").cast("long"), F.col("b").cast("long"), "count", "best")
    rows = parts.select("block", "number", "packed", none("long", "a"), none("long", "b"), none("long", "count"), none("boolean", "best")).unionByName(scored)
    out = f"id {ddl}, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups string"
    done = members.groupBy("block").cogroup(rows.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(_compose(kind, first, second), out)
    return done.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def op11_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokens(table(spark, sf_dir, "documents"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
