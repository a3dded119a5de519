"""Operator 6: language spans by script ranges and Viterbi over per-word scores with a switching penalty."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import bounded_broadcast, table

#: First code point of a script range -> script (letters before the next entry belong to it).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0x20000, "Han"),
]
_FIRST = [a for a, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")
#: The classifier is fitted on about so many labelled documents of each language, chosen by a hash of the text.
TRAIN_DOCS = 1000
#: It keeps so many letter runs (by count over all languages), of two and three letters with word edges.
FEATURES = 120_000
#: A language uses a script if at least this share of its training words does.
SCRIPT_SHARE = 0.01
#: Nats lost at each change of language between words, and the most that one word can say.
SWITCH, WORD_CAP = 6.0, 8.0
SLICE_CHARS = 1 << 20
#: Counts of so many languages are broadcast; more are joined by shuffle.
BROADCAST_LANGS = 100_000
CACHE_WORDS = 400_000


def letter_runs(text: str) -> list[str]:
    """Runs of letters. The pattern also lets fractions, raised digits and Roman numerals through; words with any are cut at them."""
    found = WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def letter_spans(text: str) -> list[tuple[int, int]]:
    """Where the runs of letter_runs() begin and end."""
    spans = []
    for m in WORD.finditer(text):
        if m[0].isalpha():
            spans.append(m.span())
            continue
        at = [k for k, c in enumerate(m[0]) if c.isalpha()]
        starts = [k for k in at if k == 0 or not m[0][k - 1].isalpha()]
        ends = [k + 1 for k in at if k + 1 == len(m[0]) or not m[0][k + 1].isalpha()]
        spans += [(m.start() + a, m.start() + b) for a, b in zip(starts, ends, strict=True)]
    return spans


def script_of(word: str) -> str:
    return SCRIPTS[bisect.bisect_right(_FIRST, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [a + b for a, b in zip(w, w[1:])] + [a + b + c for a, b, c in zip(w, w[1:], w[2:])]


@dataclass
class Model:
    langs: list[str]
    scripts: dict[str, list[bool]]
    features: dict[str, int]
    weights: np.ndarray  # (features + 1, langs) log-probabilities; the last row is for unknown runs


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled rows: counts of letter runs by language, summed on the cluster; FEATURES rows come to the driver.

    The sample is every row whose text hash falls under train_docs / (rows of its language), so it grows no further
    with the corpus; each sampled text is used whole.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(train_docs) / F.col("n")
    part = rows.join(bounded_broadcast(sizes, BROADCAST_LANGS), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, Counter())
                for w, n in Counter(letter_runs(text.lower())).items():
                    own["#" + script_of(w)] += n
                    for g in grams(w):
                        own["=" + g] += n
            if sum(map(len, total.values())) > 2_000_000:
                yield _counts(total)
                total = {}
        yield _counts(total)

    sums = part.mapInArrow(count, "lang string, k string, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    top = sums.groupBy("k").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).orderBy(F.col("k").startswith("=").asc(), F.col("all").desc(), "k").limit(FEATURES).select("k", "by").toArrow().to_pylist()
    langs = sorted({x["lang"] for r in top for x in r["by"]})
    at = {x: i for i, x in enumerate(langs)}
    feats = [r for r in top if r["k"][0] == "="]
    counts = np.zeros((len(feats) + 1, max(1, len(langs))))
    for i, r in enumerate(feats):
        for x in r["by"]:
            counts[i, at[x["lang"]]] = x["n"]
    weights = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * len(counts))
    used = {r["k"][1:]: {x["lang"]: x["n"] for x in r["by"]} for r in top if r["k"][0] == "#"}
    words = Counter()
    for by in used.values():
        words.update(by)
    scripts = {s: [by.get(x, 0) >= SCRIPT_SHARE * words[x] for x in langs] for s, by in used.items()}
    return Model(langs, scripts, {r["k"][1:]: i for i, r in enumerate(feats)}, weights.astype(np.float32))


def _counts(total: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, k, n) for lang, c in total.items() for k, n in c.items()]
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["lang", "k", "n"])


class Labeler:
    """Per-word log-scores, cached up to a bound, and Viterbi over all texts of a slice at once."""

    def __init__(self, model: Model):
        self.m = model
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)), dtype=np.float32)

    def _score(self, new: list[str]) -> None:
        """Append rows for new words: log-posteriors over the languages that use the word's script, bounded by WORD_CAP."""
        get, unknown = self.m.features.get, len(self.m.features)
        ids, sizes = [], []
        for w in new:
            g = grams(w.lower())
            ids += [get(x, unknown) for x in g]
            sizes.append(len(g))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        s = np.add.reduceat(self.m.weights[np.array(ids)], at, axis=0) / np.sqrt(np.array(sizes, dtype=np.float32))[:, None]
        allowed = np.array([self.m.scripts.get(script_of(w), [False] * len(self.m.langs)) for w in new])
        allowed |= ~allowed.any(1, keepdims=True)  # a script of no language: all stay candidates
        s = np.where(allowed, s, -np.inf)
        s = s - s.max(1, keepdims=True)
        s = np.maximum(s - np.log(np.exp(s).sum(1, keepdims=True)), -WORD_CAP)
        k = len(self.cache)
        if k + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), self.rows.shape[1]), dtype=np.float32)])
        self.rows[k : k + len(new)] = s
        self.cache.update(zip(new, range(k, k + len(new)), strict=True))

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.cache))
        for i in range(0, len(new), 50_000):
            self._score(new[i : i + 50_000])
        return self.rows[[self.cache[w] for w in words]]

    @staticmethod
    def margin(e: np.ndarray, main: int) -> np.ndarray:
        """What each word loses at least under any other language than `main`."""
        rest = np.delete(e, main, axis=1)
        return e[:, main] - rest.max(1) if rest.shape[1] else np.full(len(e), np.inf, dtype=np.float32)

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best language of each word; text i has words first[i]:first[i+1]. All texts move one word at a time together.

        A text in which no run of words gains more than SWITCH over its best single language needs no steps: one
        switch can't pay, so neither can several.
        """
        size = np.diff(first)
        path = np.zeros(len(e), dtype=np.int16)
        some = np.flatnonzero(size)
        main = np.add.reduceat(e, first[:-1][some], axis=0).argmax(1)
        gain = e.max(1) - e[np.arange(len(e)), np.repeat(main, size[some])]
        path[:] = np.repeat(main, size[some])
        size = size.copy()
        for x, i in enumerate(some):
            c = gain[first[i] : first[i + 1]].copy()
            c -= np.where(c > 0, 0, self.margin(e[first[i] : first[i + 1]], main[x]))
            np.cumsum(c, out=c)
            low = np.minimum.accumulate(np.minimum(np.concatenate([[0], c[:-1]]), 0))
            if (c - low).max() <= SWITCH:
                size[i] = 0
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        start, size = first[:-1][order], size[order]
        n = len(order)
        if not n:
            return path
        v = e[start].copy()
        back = np.zeros(e.shape, dtype=np.int16)
        me = np.arange(e.shape[1], dtype=np.int16)[None, :]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts with more than t-1 words
        for t in range(1, int(size[0])):
            k = alive[t]
            best = v[:k].argmax(1).astype(np.int16)[:, None]
            top = np.take_along_axis(v[:k], best, 1) - SWITCH
            stay = v[:k] >= top
            back[start[:k] + t] = np.where(stay, me, best)
            v[:k] = np.where(stay, v[:k], top) + e[start[:k] + t]
        now = v.argmax(1).astype(np.int16)
        for t in range(int(size[0]) - 1, -1, -1):
            k = alive[t]
            path[start[:k] + t] = now[:k]
            if t:
                now[:k] = np.take_along_axis(back[start[:k] + t], now[:k, None], 1)[:, 0]
        return path


def label(texts: list[str | None], model: Model, labeler: Labeler, spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
    """(languages, scores, spans) of texts.

    The language holds most letters under the best path, ties to the earlier name; the score is its share of letters
    times the mean posterior of its words there. Null or letterless text is ("und", 0.0, []). Spans are maximal
    runs of one language, from its first word to its last, in code points, end exclusive.
    """
    k = len(model.langs)
    found = [letter_runs(t) if t else [] for t in texts]
    size = np.array([len(f) for f in found], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = [w for f in found for w in f]
    if not words or not k:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    e = labeler.emissions(words)
    path = labeler.viterbi(e, first)
    letters = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    cell = np.repeat(np.arange(len(texts)), size) * k + path
    mass = np.bincount(cell, weights=letters, minlength=len(texts) * k).reshape(-1, k)
    sure = np.bincount(cell, weights=letters * np.exp(e[np.arange(len(e)), path]), minlength=len(texts) * k).reshape(-1, k)
    best = mass.argmax(1)
    score = np.take_along_axis(sure, best[:, None], 1)[:, 0] / np.maximum(mass.sum(1), 1)
    langs = [model.langs[b] if n else "und" for b, n in zip(best, size, strict=True)]
    out: list[list[dict]] = [[] for _ in texts]
    for i, t in enumerate(texts if spans else []):
        if size[i]:
            own = path[first[i] : first[i + 1]]
            at = letter_spans(t)
            cut = (np.flatnonzero(np.diff(own)) + 1).tolist()
            out[i] = [{"start": at[x][0], "end": at[y - 1][1], "lang": model.langs[own[x]]} for x, y in zip([0, *cut], [*cut, len(own)], strict=True)]
    return langs, np.clip(score, 0.0, 1.0).tolist(), out


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """Add lang_pred, lang_score and (if asked) lang_spans to docs. Only the text is read. Empty input gives no rows.

    Columns of docs with the names of added ones are replaced. The model is broadcast; its size is bounded by FEATURES.
    """
    out = docs.drop("lang_pred", "lang_score", "lang_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", lang_pred string, lang_score double" + ", lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(shared.value)
        for b in batches:
            col = b.column(b.schema.get_field_index(text_col))
            i = 0
            while i < b.num_rows:
                part, size, j = [], 0, i
                while j < b.num_rows and (not part or size < SLICE_CHARS):
                    part.append(col[j].as_py())
                    size += len(part[-1] or "")
                    j += 1
                langs, scores, runs = label(part, shared.value, labeler, spans)
                s = b.slice(i, j - i)
                cols = [*s.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + [pa.array(runs, kind)] * spans
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "lang_pred", "lang_score"] + ["lang_spans"] * spans)
                i = j

    return out.mapInArrow(run, fields)


def held_out(mod: int, fold: int):
    """crc32 of doc_id as text, modulo `mod`, equals `fold`; a null id counts as the text "" (crc32 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == fold


def op6_script_viterbi(spark, sf_dir: str) -> DataFrame:
    """Query: language of each document, learned from those outside the fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = train(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model, spans=False).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
