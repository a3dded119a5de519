"""Operator 3: class-based n-gram scoring; the exchange algorithm assigns words to classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import discard, materialize, table
from seqlake.llm.langid import held_out
from seqlake.llm.wordhash import Words, slices

#: Words of the largest training counts that the workers hold (a bounded broadcast); others are scored by a join.
HEAD = 50_000
#: Of these, so many are clustered by exchange; the rest of HEAD then joins the class that suits it best.
UNITS = 1_000
#: Training words outside HEAD get their class by a join. A word never seen is generated by its form, its last bytes; so
#: many forms are clustered as words are.
FORMS, FORM_BYTES = 1_000, 2
CLASSES, SWEEPS = 48, 12
#: Pseudo-counts that back off transitions to class frequencies, and emissions to a flat one.
BACK_OFF, FLAT = 5.0, 0.5
#: Distinct words that a counting task holds, ids that a task takes up at a time, and keys that it counts as an array.
HELD, RUN, DENSE = 300_000, 1 << 18, 1 << 23
PLACE = np.dtype(np.uint32)


@dataclass
class Model:
    """Everything bounded that scoring needs on a worker; ids are 0 end, then head words, then forms, last other forms."""

    words: np.ndarray  # sorted hashes of head words
    word_id: np.ndarray
    counts: np.ndarray  # training count of each id (form: its tail words seen once)
    forms: np.ndarray  # sorted codes of forms
    tokens: int
    types: int
    form_types: np.ndarray  # distinct tail words of each form
    cls: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    trans: np.ndarray = field(default_factory=lambda: np.zeros(0))
    emit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each class, all its words and forms

    @property
    def n_ids(self) -> int:
        return 2 + len(self.words) + len(self.forms)

    @property
    def dtype(self) -> np.dtype:
        return np.min_scalar_type(self.n_ids - 1)


def form_codes(w: Words) -> np.ndarray:
    """Last FORM_BYTES bytes of each word, A-Z lowered."""
    code = np.zeros(len(w.start), dtype=np.int64)
    for k in range(1, FORM_BYTES + 1):
        at = w.end - k
        byte = np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(np.int64)
        byte += np.where((byte >= 65) & (byte <= 90), 32, 0)
        code = code * 256 + byte
    return code


def ids_of(w: Words, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(id, whether it is outside HEAD) of each word."""
    at = np.minimum(np.searchsorted(m.words, w.hash), max(0, len(m.words) - 1))
    known = m.words[at] == w.hash if len(m.words) else np.zeros(len(w.hash), dtype=bool)
    code = form_codes(w)
    f = np.minimum(np.searchsorted(m.forms, code), max(0, len(m.forms) - 1))
    form = np.where(m.forms[f] == code, 1 + len(m.words) + f, m.n_ids - 1) if len(m.forms) else np.full(len(code), m.n_ids - 1)
    return np.where(known, m.word_id[at] if len(m.words) else 0, form), ~known


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts, lower-cased A-Z: counted in tasks, part by part, and summed on the cluster."""
    return docs.select("text").mapInArrow(_counted, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct words; a task holds about HELD of them at a time."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return pa.table({"word": t.column("word"), "c": t.column("c_sum")})

    for b in batches:
        for _, _, w in slices(b.column(0), lower=True):
            x = w.strings().value_counts()
            held.append(pa.table({"word": x.field("values"), "c": x.field("counts")}))
            if sum(map(len, held)) > 2 * HELD:
                held = [summed()]
                if len(held[0]) > HELD:
                    yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from summed().combine_chunks().to_batches()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) -> (word, c, h, form)."""
    for b in batches:
        h, f = [], []
        for _, _, w in slices(b.column(0), lower=True):
            h.append(w.hash.view(np.int64)), f.append(form_codes(w))
        if h:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(h)), pa.array(np.concatenate(f))], names=["word", "c", "h", "form"])


def _pack(x: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary for each run first[i]:first[i + 1] of x."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def _unpack(packed: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(x, first) of _pack."""
    packed, n = packed.cast(pa.large_binary()), len(packed)
    at = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + n + 1]
    raw = np.frombuffer(packed.buffers()[2], dtype=np.uint8) if packed.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]].view(dtype), (at - at[0]) // dtype.itemsize


def _encoded(model, text: int):
    """Column `text` becomes ids (of every word, then 0 for the end), words (the text's distinct words outside HEAD, as
    they come) and place (of each word outside HEAD: 0 where it is new, else its number in words, from 1); others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            others = [k for k in range(b.num_columns) if k != text]
            for i, j, w in slices(b.column(text), lower=True):
                n, coded = j - i, w.strings().dictionary_encode()
                code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                own = [ids_of(v, m) for _, _, v in slices(names, lower=False)]  # each name is one word, lowered
                ids, out = (np.concatenate(x)[code] for x in zip(*own, strict=True)) if own else (code, code > 0)
                s = np.zeros(len(code) + n, dtype=m.dtype)
                row = np.repeat(np.arange(n), np.diff(w.first))
                s[np.arange(len(code)) + row] = ids
                row, code = row[out], code[out]
                _, at, same = np.unique(row * len(names) + code, return_index=True, return_inverse=True)
                new = np.zeros(len(code), dtype=bool)
                new[at] = True
                where, number = np.searchsorted(row, np.arange(n + 1)), np.concatenate([[0], np.cumsum(new)])
                first = number[where]
                words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), names.take(pa.array(code[new])))
                place = np.where(new, 0, number[1:][at[same]] - first[row]).astype(PLACE)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, n) for k in others), _pack(s, w.first + np.arange(n + 1)), _pack(place, where), words],
                    names=[*(b.schema.names[k] for k in others), "ids", "place", "words"],
                )

    return run


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ids, place and words for text, and a number `row`, kept on shared storage: later passes read numbers, not texts."""
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return materialize(docs.mapInArrow(_encoded(shared, docs.columns.index("text")), f"{kinds}, ids binary, place binary, words array<string>"), "lm-coded")


def _runs(ids: pa.Array, m: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, where each row starts in them and the end) over consecutive rows of encode()."""
    x, at = _unpack(ids, m.dtype)
    i = 0
    while i < len(ids):
        j = min(len(ids), max(i + 1, int(np.searchsorted(at, at[i] + RUN, side="right")) - 1))
        yield i, j, x[at[i] : at[j]].astype(np.int64), at[i : j + 1] - at[i]
        i = j


def _places(place: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word outside HEAD, first number of each text and the end), where words of text after text are numbered."""
    new, row = place == 0, np.repeat(np.arange(len(where) - 1), np.diff(where))
    number = np.concatenate([[0], np.cumsum(new)])
    first = number[where - where[0]]
    return np.where(new, number[1:] - 1, first[row] + place.astype(np.int64) - 1), first


def _pairs(model, kind: str, n: int):
    """Counts of adjacent (left, right) ids mapped by `kind`, summed in each task: at most n * n keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, to = model.value
        size = n * (n if kind == "both" else m.n_ids)
        total = np.zeros(size, dtype=np.int64) if size <= DENSE else None
        row = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["k", "n"])
        for b in batches:
            for _, _, s, first in _runs(b.column(0), m):
                left = np.concatenate([[0], s[:-1]])
                left[first[:-1]] = 0  # a text begins after an end
                l, r = to[left], to[s]
                if kind == "both":  # pairs of mapped ids
                    ok = (l >= 0) & (r >= 0)
                    keys = l[ok] * n + r[ok]
                else:  # id with the class on its left (even) and on its right (odd)
                    a, z = (r < 0) & (l >= 0), (l < 0) & (r >= 0)
                    keys = np.concatenate([s[a] * n + 2 * l[a], left[z] * n + 2 * r[z] + 1])
                if total is None:
                    yield row(*np.unique(keys, return_counts=True))
                else:
                    np.add.at(total, keys, 1)
        if total is not None:
            k = np.flatnonzero(total)
            yield row(k, total[k])

    return run


def _summed(coded: DataFrame, m: Model, to: np.ndarray, kind: str, n: int) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast((m, to))
    return coded.select("ids").mapInArrow(_pairs(shared, kind, n), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def _contexts(model, n: int):
    """Of every adjacent pair, with final classes of all but words outside HEAD (tail words):
    without h, k = left * n + right and its count g, where neither is a tail word; without g, a row for each tail word h, k =
    (2 * left + whether it is a tail word) * 2 * n + (2 * right + whether it is), by their forms' classes where they are;
    without k, a row for each tail word g that follows a tail word h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        total = np.zeros(n * n, dtype=np.int64)

        def rows(size: int, **col: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(col[x]) if x in col else pa.nulls(size, pa.int64()) for x in "hgk"], names=["h", "g", "k"])

        for b in batches:
            place, where = _unpack(b.column(1), PLACE)
            words, start = b.column(2).values, b.column(2).offsets.to_numpy()
            for i, j, s, first in _runs(b.column(0), m):
                own = [w.hash.view(np.int64) for _, _, w in slices(words.slice(start[i], start[j] - start[i]), lower=False)]
                tail = s > len(m.words)
                h = np.zeros(len(s), dtype=np.int64)
                if own:
                    h[tail] = np.concatenate(own)[_places(place[where[i] : where[j]], where[i : j + 1])[0]]
                c = m.cls[s]
                left, before = np.concatenate([[m.cls[0]], c[:-1]]), np.concatenate([[False], tail[:-1]])
                left[first[:-1]] = m.cls[0]  # a text begins after an end, which is no tail word
                total += np.bincount((left * n + c)[~tail & ~before], minlength=n * n)
                at = np.flatnonzero(tail)  # never the last token, which is an end
                yield rows(len(at), h=h[at], k=(2 * left[at] + before[at]) * 2 * n + 2 * c[at + 1] + tail[at + 1])
                at = np.flatnonzero(tail & before)
                yield rows(len(at), h=h[at - 1], g=h[at])
        k = np.flatnonzero(total)
        yield rows(len(k), g=total[k], k=k)

    return run


def _assign(near: np.ndarray, n: int):
    """Rows (h, k) sorted by h -> (h, cls): the class under which the neighbours are likeliest; then, with null h, the class
    pairs k = left * n + right and their counts c of a tail word with neighbours that are none. Likelihoods are whole numbers
    of 2**-32, so that their sums don't depend on the order of a word's rows."""
    near = np.rint(near * 2.0**32).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        last, fit, kept = None, np.zeros(near.shape[1], np.int64), []

        def settle(k: np.ndarray, cls: np.ndarray) -> None:
            nonlocal total
            l, r = k // (2 * n), k % (2 * n)
            total += np.bincount((l // 2 * n + cls)[l % 2 == 0], minlength=n * n) + np.bincount((cls * n + r // 2)[r % 2 == 0], minlength=n * n)

        def close() -> tuple[list, list]:
            c = int(fit.argmax())
            for x in kept:
                settle(x, np.full(len(x), c))
            return [last], [c]

        def rows(h: list, cls: list, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            fill = len(k) or len(h)
            none = lambda x: pa.array(x if len(x) else [None] * fill, pa.int64())
            return pa.RecordBatch.from_arrays([none(h), none(cls), none(k), none(c)], names=["h", "cls", "k", "c"])

        for b in batches:
            if not b.num_rows:
                continue
            h, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
            sums = np.add.reduceat(near[k // (2 * n) // 2 * 2] + near[k % (2 * n) // 2 * 2 + 1], starts)
            done_h, done_c = [], []
            if last is not None and last != h[0]:
                done_h, done_c = close()
                fit, kept = np.zeros(near.shape[1], np.int64), []
            sums[0] += fit
            ends = np.append(starts[1:], len(h))
            if len(starts) > 1:
                cls = sums[:-1].argmax(1)
                for x in kept:
                    settle(x, np.full(len(x), cls[0]))
                kept = []
                settle(k[: starts[-1]], np.repeat(cls, np.diff(starts)))
                done_h += h[starts[:-1]].tolist()
                done_c += cls.tolist()
            kept.append(k[starts[-1] : ends[-1]])
            last, fit = int(h[-1]), sums[-1]
            if done_h:
                yield rows(done_h, done_c, np.zeros(0), np.zeros(0))
        if last is not None:
            yield rows(*close(), np.zeros(0), np.zeros(0))
            k = np.flatnonzero(total)
            if len(k):
                yield rows([], [], k, total[k])

    return run


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units move, one at a time, to the class that raises the class-bigram likelihood most.

    pairs[i, j]: times unit j follows unit i. Starts from units dealt by count; stops when a sweep moves none.
    The objective is sum n(a,b) log n(a,b) - sum n(a) log n(a) - sum n(b) log n(b) over classes.
    """
    n = len(pairs)
    k = min(classes, n)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    cls = np.empty(n, dtype=np.int64)
    cls[order] = np.minimum(np.arange(n), k - 1) if n <= k else np.arange(n) % k
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    hot = np.eye(k)[cls]
    t = hot.T @ pairs @ hot
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a = cls[u]
            hot[u, a] = 0
            out, inn, own = pairs[u] @ hot, pairs[:, u] @ hot, pairs[u, u]
            t[a] -= out
            t[:, a] -= inn
            t[a, a] -= own
            # gain of adding u to each class c, all at once
            gain = (f(t + out[None, :]) - f(t)).sum(1) + (f(t + inn[:, None]) - f(t)).sum(0)
            d = np.diagonal(t)
            gain += f(d + out + inn + own) - f(d + out) - f(d + inn) + f(d)
            row, col = t.sum(1), t.sum(0)
            gain -= f(row + inn + out.sum() + own) - f(row + inn)
            gain -= f(col + out + inn.sum() + own) - f(col + out)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[u] = b
            hot[u, b] = 1
            t[b] += out
            t[:, b] += inn
            t[b, b] += own
        if not moved:
            break
    return cls


def vocabulary(docs: DataFrame, head: int = HEAD, forms: int = FORMS) -> tuple[Model, DataFrame]:
    """(model without classes, counts): counts is (word, c, h, form) of every training word but the end, on shared storage."""
    counts = materialize(word_counts(docs).mapInArrow(_hashed, "word string, c bigint, h bigint, form bigint"), "lm-counts")
    ends = docs.count()
    tot = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.orderBy(F.col("c").desc(), "word").limit(head).select("h", "c").toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    head_h = materialize(docs.sparkSession.createDataFrame(pa.table({"h": pa.array(h.view(np.int64), pa.int64())})), "lm-head")
    tail = counts.join(F.broadcast(head_h), "h", "left_anti")
    by_form = tail.groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once"))
    kept = by_form.orderBy(F.col("n").desc(), "form").limit(forms).toArrow()
    code = kept.column("form").to_numpy().astype(np.int64)
    by = np.argsort(code)
    f_once, f_v = kept.column("once").to_numpy()[by], kept.column("v").to_numpy()[by]
    all_tail = by_form.agg(F.sum("once"), F.sum("v")).first()
    discard(head_h)
    other_once, other_v = (all_tail[0] or 0) - int(f_once.sum()), (all_tail[1] or 0) - int(f_v.sum())
    m = Model(h[order], 1 + order, np.concatenate([[ends], c, f_once, [other_once]]).astype(np.float64), code[by], int((tot[0] or 0) + ends), int(tot[1] + (ends > 0)), np.concatenate([f_v, [other_v]]).astype(np.float64))
    return m, counts


def train(docs: DataFrame, head: int = HEAD, units: int = UNITS, forms: int = FORMS, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """(model, counts): counts is (word, c, cls) of every training word but the end, kept on shared storage; cls is null in `head`."""
    m, counts = vocabulary(docs, head, forms)
    coded = encode(docs.select("text"), m)
    out = fit(coded, m, counts, units, classes)
    discard(coded)
    return out


def fit(coded: DataFrame, m: Model, counts: DataFrame, units: int = UNITS, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """What train() returns, from the training texts of encode() and their vocabulary(), whose counts are deleted.

    1. Word counts over all training texts. 2. The `units` most frequent words and the forms of words outside `head` are
    clustered by exchange on their bigram counts; the end token has a class of its own. 3. The rest of `head` joins the class
    under which its neighbours' classes, counted over all training texts, are most likely: one distributed exchange step.
    4. So does every word outside `head`, in tasks that each hold the contexts of some words. 5. Class transitions and
    emissions are counted over all training texts.
    """
    h = m.words
    n_units = min(units, len(h))
    to = np.full(m.n_ids, -1, dtype=np.int64)
    to[1 : 1 + n_units] = np.arange(n_units)
    to[1 + len(h) :] = n_units + np.arange(m.n_ids - 1 - len(h))
    u = n_units + m.n_ids - 1 - len(h)
    to[0] = u  # the end: neighbour of units, never moved
    size = u + 1
    p = _summed(coded, m, to, "both", size).toArrow()
    pairs = np.zeros((size, size))
    k = p.column("k").to_numpy()
    pairs[k // size, k % size] = p.column("n").to_numpy()
    inner = exchange(pairs[:u, :u], classes) if u else np.zeros(0, np.int64)
    n_cls = classes + 1
    m.cls = np.full(m.n_ids, -1, dtype=np.int64)
    m.cls[0] = classes
    m.cls[1 : 1 + n_units] = inner[:n_units]
    m.cls[1 + len(h) :] = inner[n_units:]

    known = np.concatenate([m.cls[1 : 1 + n_units], m.cls[1 + len(h) :], [classes]])
    hot = np.zeros((size, n_cls))
    hot[np.arange(size), known] = 1
    t = hot.T @ pairs @ hot + 0.1
    near = np.empty((2 * n_cls, classes))  # log-likelihood of the class on the left (even) and on the right (odd)
    near[0::2], near[1::2] = np.log(t / t.sum(1, keepdims=True))[:, :classes], np.log(t / t.sum(0, keepdims=True)).T[:, :classes]
    if len(h) > n_units:  # at most (head - units) * 2 * classes sums
        width = 2 * n_cls
        q = _summed(coded, m, m.cls, "near", width).toArrow()
        k, n = q.column("k").to_numpy(), q.column("n").to_numpy()
        ctx = np.zeros((len(h) - n_units, width))
        ctx[k // width - 1 - n_units, k % width] = n
        m.cls[1 + n_units : 1 + len(h)] = (ctx @ near).argmax(1)

    shared = coded.sparkSession.sparkContext.broadcast(m)
    seen = materialize(coded.select("ids", "place", "words").mapInArrow(_contexts(shared, n_cls), "h bigint, g bigint, k bigint"), "lm-contexts")
    own = seen.where("g is null").select("h", "k").repartition("h").sortWithinPartitions("h")
    own = materialize(own.mapInArrow(_assign(near, n_cls), "h bigint, cls bigint, k bigint, c bigint"), "lm-assigned")
    cls = own.where("h is not null").select("h", "cls")
    # a word outside head is at most as frequent as any in it, so the keys of these joins are even
    both = seen.where("k is null").groupBy("h", "g").agg(F.count("*").alias("c"))
    both = both.join(cls.withColumnRenamed("cls", "l"), "h").join(cls.toDF("g", "r"), "g").select((F.col("l") * n_cls + F.col("r")).alias("k"), "c")
    r = seen.where("h is null").select("k", F.col("g").alias("c")).unionByName(own.where("h is null").select("k", "c")).unionByName(both)
    r = r.groupBy("k").agg(F.sum("c").alias("n")).toArrow()
    discard(seen)
    t = np.zeros((n_cls, n_cls))
    k = r.column("k").to_numpy()
    t[k // n_cls, k % n_cls] = r.column("n").to_numpy()
    prior = (t.sum(0) + 0.1) / (t.sum() + 0.1 * n_cls)
    m.trans = np.log10((t + BACK_OFF * prior[None, :]) / (t.sum(1, keepdims=True) + BACK_OFF))
    bare = counts
    counts = materialize(bare.join(cls, "h", "left").select("word", "c", "cls"), "lm-classes")
    discard(bare, own)
    m.mass = np.bincount(m.cls, weights=m.counts + FLAT, minlength=n_cls)
    for x in counts.where("cls is not null").groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        m.mass[x["cls"]] += x["c"] + FLAT * x["v"]
    emit = np.log10((m.counts + FLAT) / m.mass[m.cls])
    # a word never seen: its form, as likely as its words seen once, then one of as many words as the form has
    emit[1 + len(h) :] -= np.log10(m.form_types + 1)
    m.emit = emit
    return m, counts


def _score(shared):
    """Rows of encode() with found, the (pos, c, cls) of those of their words that training has seen -> counts and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            place, where = _unpack(col["place"], PLACE)
            hits, start = col["found"].values, col["found"].offsets.to_numpy()
            for i, j, s, first in _runs(col["ids"], m):
                tail = s > len(m.words)
                cls, count, emit = m.cls[s], np.where(tail, 0.0, m.counts[s]), m.emit[s]
                part, base = _places(place[where[i] : where[j]], where[i : j + 1])
                hit = hits.slice(start[i], start[j] - start[i])
                at = base[np.repeat(np.arange(j - i), np.diff(start[i : j + 1]))] + hit.field("pos").to_numpy(zero_copy_only=False)
                c, k = np.zeros(base[-1]), np.full(base[-1], -1)
                c[at], k[at] = hit.field("c").to_numpy(zero_copy_only=False), hit.field("cls").to_numpy(zero_copy_only=False)
                seen, of = np.flatnonzero(tail)[k[part] >= 0], part[k[part] >= 0]
                cls[seen], count[seen] = k[of], c[of]
                emit[seen] = np.log10((c[of] + FLAT) / m.mass[k[of]])
                left = np.concatenate([[0], cls[:-1]])
                left[first[:-1]] = m.cls[0]
                sums = lambda x: pa.array(np.add.reduceat(x, first[:-1]))  # noqa: B023, E731  every text has an end
                yield pa.RecordBatch.from_arrays(
                    [col["doc_id"].slice(i, j - i), col["held_out"].slice(i, j - i), pa.array(np.diff(first)), sums((count > 0).astype(np.int64)), sums(np.log10(count + 1)), sums(emit + m.trans[left, cls])],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "value"],
                )

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text, held_out).

    Null text is empty: one end token. Rows that repeat id and text score alike. Empty input gives no rows.
    """
    return score_coded(encode(docs.select("doc_id", "text", "held_out"), model), model, counts)


def score_coded(coded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """score() from the texts' encode(). A word of HEAD is scored where it stands. Class and exact count of other words are
    found by a join of distinct (word, text) rows and brought back to the text's row by its number; the most frequent words
    never enter the join, so its keys are even. What is found moves as plain rows and is put into lists where it arrives.
    """
    kind = coded.schema["doc_id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(model)
    tail = coded.select("row", F.posexplode("words").alias("pos", "word"))
    found = tail.join(counts.where("cls is not null"), "word").select("row", F.struct("pos", "c", "cls").alias("x"))
    found = found.repartition("row").groupBy("row").agg(F.collect_list("x").alias("found"))
    j = coded.drop("words").join(found, "row", "left").drop("row")
    j = j.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, value double")
    flat = F.log10(F.lit(float(model.tokens + model.types + 1)))
    return j.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * flat).alias("base_score"), F.col("value").alias("score"),
    )


def op3_brown_classes(spark, sf_dir: str) -> DataFrame:
    """Query: log10 probability of each document under the class model, with the unigram base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(7, 2))
    m, counts = vocabulary(docs.where("not held_out"))
    coded = encode(docs, m)  # once, for training and scoring
    model, counts = fit(coded.where("not held_out"), m, counts)
    return score_coded(coded, model, counts)
