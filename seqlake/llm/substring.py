"""Operator 9: substring dedup against a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import discard, materialize, scratch_dir, table
from seqlake.llm.wordhash import Words, slices

#: A fingerprint is the least hash of the GRAM-word runs inside a window, so equal windows have equal fingerprints.
GRAM = 10
#: A manifest: its runs by level, and the words of a window.
MANIFEST = "level int, run string, window int"
#: Runs of one level are merged into one of the next as soon as there are so many.
FAN_IN = 2


def window_marks(w: Words, window: int) -> np.ndarray:
    """For each window start (crossing texts too) the window's fingerprint."""
    gram = min(GRAM, window)
    g = w.windows(gram)
    span, want = 1, window - gram + 1
    while span * 2 <= want and len(g) > span:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    if want > span and len(g) > want - span:
        g = np.minimum(g[: len(g) - (want - span)], g[want - span :])
    return g


def _starts(w: Words, i: int, window: int) -> slice:
    return slice(w.first[i], max(w.first[i], w.first[i + 1] - window + 1))


def _fingerprints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(1), lower=False):
                marks = window_marks(w, window)
                each = [np.unique(marks[_starts(w, r, window)]) for r in range(j - i)]
                n = [len(x) for x in each]
                if sum(n):
                    ids = b.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), n)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), ids], names=["mark", "id"])

    return run


def _windows(window: int):
    """(h, id, at) for each window whose fingerprint is among its row's `marks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(1), lower=False):
                marks, full = window_marks(w, window), w.windows(window)
                at = []
                for r in range(j - i):
                    hot = b.column(2)[i + r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    at.append(np.flatnonzero(np.isin(marks[_starts(w, r, window)], hot)))
                n = [len(x) for x in at]
                if sum(n):
                    row = np.repeat(np.arange(j - i), n)
                    pos = np.concatenate(at)
                    h = full[w.first[row] + pos]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(pos.astype(np.int32))], names=["h", "id", "at"])

    return run


def _word_list(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the exact words [at, at+n) for each request of a row."""
    for b in batches:
        ids, at, n, dig = [], [], [], []
        for r in range(b.num_rows):
            w = _word_list(b.column(1)[r].as_py())
            for q in b.column(2)[r].as_py():
                ids.append(r), at.append(q["at"]), n.append(q["n"])
                dig.append(hashlib.blake2b(b" ".join(w[q["at"] : q["at"] + q["n"]]), digest_size=32).digest())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(dig, pa.binary())], names=["d", "at", "n", "digest"])


def _exact(window: int):
    """(h, id, at, key) with key a 512-bit digest of the window's words, for each window whose h is in `hs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(1), lower=False):
                full = w.windows(window)
                for r in range(j - i):
                    hs = b.column(2)[i + r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    pos = np.flatnonzero(np.isin(full[_starts(w, r, window)], hs))
                    ws = _word_list(b.column(1)[i + r].as_py())
                    keys = [hashlib.blake2b(b" ".join(ws[p : p + window]), digest_size=64).digest() for p in pos]
                    if len(pos):
                        yield pa.RecordBatch.from_arrays([pa.array(full[w.first[r] + pos].view(np.int64)), b.column(0).take(pa.array([i + r] * len(pos))), pa.array(pos.astype(np.int32)), pa.array(keys, pa.binary())], names=["h", "id", "at", "key"])

    return run


def _removal(window: int):
    """Apply covered word ranges: n_words, n_removed, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for r in range(b.num_rows):
                w = _word_list(b.column(1)[r].as_py())
                n_words.append(len(w))
                spans = b.column(2)[r].as_py() or []
                last, out = 0, []
                for s in sorted(spans):
                    if s > last:
                        out += w[last:s]
                    last = max(last, s + window)
                out += w[last:]
                n_removed.append(len(w) - len(out))
                kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return run


class FingerprintIndex:
    """Sorted immutable runs (mark, id) of the fingerprints of every window seen so far.

    A batch is fingerprinted, sorted and written as a run; its marks are merge-joined with the older runs; the
    documents on both sides of a shared mark have the windows under it hashed in full, and a window goes
    when its words, verified, start in a document with a smaller id. Then runs of a level are compacted.
    Texts of history are read again from `history`, only for documents under shared marks.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 50):
        """The index stored under `path`, as its last manifest has it, or a new one. One writer at a time."""
        self.spark, self.window = spark, window
        self.path = path or f"{scratch_dir(spark)}/marks-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []
        self.version = 0
        if path and (last := self._last()):
            self.version, rows = last, spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest-{last:08d}").collect()
            self.runs = [(r["level"], f"{self.path}/{r['run']}") for r in rows]
            if {r["window"] for r in rows} - {window}:
                raise ValueError(f"the index at {path} has windows of another size")

    def _store(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _last(self) -> int:
        """Number of the last manifest whose write was committed."""
        fs, p = self._store(self.path)
        names = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        done = [x for x in names if x.getName().startswith("manifest-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return max((int(x.getName()[9:]) for x in done), default=0)

    def _commit(self) -> None:
        """Write the list of runs as the next manifest, one row for each run; runs that it lacks are deleted after it stands."""
        rows = [(level, path.rsplit("/", 1)[1], self.window) for level, path in self.runs]
        self.version += 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version:08d}")
        fs, p = self._store(self.path)
        for x in fs.listStatus(p):
            name = x.getPath().getName()
            if name.startswith("run-") and name not in {r[1] for r in rows} or name.startswith("manifest-") and name < f"manifest-{self.version:08d}":
                fs.delete(x.getPath(), True)

    def _write(self, marks: DataFrame, level: int) -> DataFrame:
        path = f"{self.path}/run-{level}-{uuid.uuid4().hex}"
        marks.repartition("mark").sortWithinPartitions("mark", "id").write.option("compression", "zstd").parquet(path)
        self.runs.append((level, path))
        return self.spark.read.schema(marks.schema).parquet(path)

    def compact(self) -> None:
        """Merge the runs of a level into one of the next wherever there are FAN_IN; the manifest names what then holds."""
        for level in sorted({x for x, _ in self.runs}):
            own = [p for x, p in self.runs if x == level]
            if len(own) >= FAN_IN:
                merged = self.spark.read.parquet(*own).dropDuplicates(["mark", "id"])
                self.runs = [(x, p) for x, p in self.runs if x != level]
                self._write(merged, level + 1)
        self._commit()

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """(id, gone): starts of windows to remove, for documents of the batch, and for those of history that a smaller id of
        the batch now comes before. batch, history: (id, text), ids not null."""
        kind = batch.schema["id"].dataType.simpleString()
        old = [p for _, p in self.runs]
        new = self._write(batch.mapInArrow(_fingerprints(self.window), f"mark bigint, id {kind}").distinct(), 0)
        within = new.groupBy("mark").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("mark")
        if old:
            seen = self.spark.read.schema(new.schema).parquet(*old).hint("merge")
            past = materialize(seen.join(new.select("mark").distinct(), "mark", "left_semi"), "sub-past")
            shared = within.union(past.select("mark")).distinct()
        else:
            past, shared = new.limit(0), within
        hot = new.join(shared.hint("merge"), "mark", "left_semi").unionByName(past)
        hot = materialize(hot.groupBy("id").agg(F.collect_set("mark").alias("marks")), "sub-hot")
        texts = history.unionByName(batch) if old else batch
        texts = materialize(texts.join(hot, "id").select("id", "text", "marks"), "sub-texts")
        win = texts.mapInArrow(_windows(self.window), f"h bigint, id {kind}, at int")
        first = win.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("hi"), F.min_by("at", "id").alias("first_at")).where("first <> hi").drop("hi")
        batch_ids = new.select("id").distinct()
        lowest = new.agg(F.min("id")).first()[0]
        late = bool(old) and lowest is not None and not past.where(F.col("id") > F.lit(lowest)).isEmpty()
        hit = win.join(first, "h").where("id > first").select("id", "at", "first", "first_at", "h")
        if old:
            fresh = hit.join(batch_ids, "id", "left_semi")
            if late:
                fresh = fresh.unionByName(hit.join(batch_ids, "id", "left_anti").join(batch_ids.withColumnRenamed("id", "first"), "first", "left_semi"))
            hit = fresh
        hit = materialize(hit, "sub-hits")

        # hits at one distance to the same first document are one stretch of words, verified at once
        lag = hit.groupBy("id", "first", (F.col("at") - F.col("first_at")).alias("off")).agg(F.sort_array(F.collect_set("at")).alias("ats"))
        a = F.col("ats")
        heads = F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x - 1))
        tails = F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1) != x + 1, F.lit(True)))
        seg = lag.select("id", "first", "off", F.explode(F.arrays_zip(heads.alias("s"), tails.alias("e"))).alias("z"))
        seg = materialize(seg.select("id", "first", F.col("z.s").alias("at"), (F.col("z.s") - F.col("off")).alias("first_at"), (F.col("z.e") - F.col("z.s") + self.window).cast("int").alias("n")), "sub-stretches")
        ask = seg.select(F.col("id").alias("d"), "at", "n").union(seg.select("first", "first_at", "n")).distinct()
        ask = ask.groupBy("d").agg(F.collect_list(F.struct("at", "n")).alias("q"))
        got = texts.join(ask, F.col("id") == F.col("d")).select("d", "text", "q").mapInArrow(_digests, f"d {kind}, at int, n int, digest binary")
        got = materialize(got, "sub-digests")
        mine = got.select(F.col("d").alias("id"), "at", "n", F.col("digest").alias("x"))
        other = got.select(F.col("d").alias("first"), F.col("at").alias("first_at"), "n", F.col("digest").alias("y"))
        both = materialize(seg.join(mine, ["id", "at", "n"]).join(other, ["first", "first_at", "n"]).select("id", "first", "at", "n", (F.col("x") == F.col("y")).alias("same")), "sub-verified")
        gone = both.where("same").select("id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - self.window)).alias("at"))
        wrong = both.where("not same")
        if not wrong.isEmpty():
            gone = gone.union(self._by_words(wrong, hit, texts, kind))
        out = materialize(gone.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("gone")), "sub-gone")
        # the batch is in the index once its result stands: a job that dies before adds it again
        self.compact()
        discard(past, hot, texts, hit, seg, got, both)
        return out

    def _by_words(self, wrong: DataFrame, hit: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
        """The exact way for windows whose hash also belongs to other words: grouped by the words' digest."""
        at = wrong.select("id", "first", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - self.window)).alias("at"))
        hs = hit.join(at, ["id", "first", "at"]).select("h").distinct()
        win = texts.mapInArrow(_windows(self.window), f"h bigint, id {kind}, at int")
        ask = win.join(hs, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("hs"))
        exact = materialize(texts.join(ask, "id").select("id", "text", "hs").mapInArrow(_exact(self.window), f"h bigint, id {kind}, at int, key binary"), "sub-exact")
        first = exact.groupBy("key").agg(F.min("id").alias("first"))
        return exact.join(first, "key").where("id > first").select("id", "at")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 3) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for each row of docs, fed to an index in `batches` ranges of the id.

    A word goes when a window of `window` consecutive words covers it whose words also start a window of a
    document with a smaller id; windows are judged on the input. kept_text is the kept words joined by one space.
    Null text has no words. A null id has no order: such a row keeps all words and removes none elsewhere. Rows
    that repeat an id act alike if their texts are equal; of different texts the least stands for the id and
    the other rows keep all words. Empty input: no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = src.where("id is not null")
    twice = materialize(known.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "sub-twice")
    if repeated := not twice.isEmpty():
        canon = known.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        known = known.join(twice, "id", "left_anti").unionByName(canon)
    index = FingerprintIndex(spark, window=window)
    cuts = [None, *_cuts(known, batches), None]
    found = None
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = known if lo is None else known.where(F.col("id") > F.lit(lo))
        part = part if hi is None else part.where(F.col("id") <= F.lit(hi))
        gone = index.add(part, known.where(F.col("id") <= F.lit(lo)) if lo is not None else known.limit(0))
        found = gone if found is None else found.unionByName(gone)
    kind = src.schema["id"].dataType.simpleString()
    f = found.withColumnRenamed("id", "f_id")
    on = F.col("id") == F.col("f_id")
    if repeated:
        f = f.join(known.select(F.col("id").alias("f_id"), F.xxhash64("text").alias("f_text")), "f_id")
        on = on & (F.xxhash64("text") == F.col("f_text"))
    out = src.join(f, on, "left").select("id", "text", "gone")
    return out.mapInArrow(_removal(window), f"id {kind}, n_words bigint, n_removed bigint, kept_text string")


def _cuts(known: DataFrame, batches: int) -> list:
    if batches < 2 or not isinstance(known.schema["id"].dataType.typeName(), str) or known.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return []
    q = known.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    return sorted(set(q))


def op9_fingerprint_index(spark, sf_dir: str) -> DataFrame:
    """Query: words removed from each document, by windows of 50."""
    d = dedup_passages(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
