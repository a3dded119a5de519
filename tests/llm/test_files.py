"""Archives, decontamination, language spans, class-based scores and the pipeline."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from seqlake.llm import brown, decontaminate, langid, warc
from seqlake.llm.wordhash import slices


def pages(frame):
    rows = [(i, f"http://x/{i}", "<p>é" + "ab" * (i % 5) + "</p>") for i in range(30)] + [(40, None, None), (41, "u", ""), (42, "u\r\nX: y", "big" * 70_000), (None, "n", "<p>é</p>"), (3, "again", "<p>éababab</p>")]
    return rows, frame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, frame, tmp_path):
    rows, df = pages(frame)
    out = warc.archive_pages(spark, df, f"file://{tmp_path}/w")
    back = warc.resolve(warc.read_archives(out, payload=True)).collect()
    assert len(back) == len(rows) and all(r["error"] is None for r in back)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if i is not None and first[h or ""] != i else "response", str(first[h or ""]) if i is not None and first[h or ""] != i else "") for i, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or "") for r in back) == want
    assert sum(r["records"] for r in out.collect()) == len(rows)
    assert warc.read_archives(warc.archive_pages(spark, df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_small_payloads_are_never_revisits(frame):
    _, df = pages(frame)
    assert warc.with_revisits(df, 12).where("refers_to is not null and octet_length(coalesce(html, '')) < 12").count() == 0


def test_dictionary_frames_and_damage(tmp_path):
    fs = pafs.LocalFileSystem()
    samples = [f"<html>{i} common words in every page {i * 7}</html>".encode() * 4 for i in range(60)]
    raw = warc.train_dictionary(samples)
    c = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(raw))
    frames = [c.compress(warc.build_record(i, "u", p, None)) for i, p in enumerate(samples)]
    for name, d in (("plain", raw), ("packed", zstd.ZstdCompressor().compress(raw))):
        (tmp_path / name).write_bytes(struct.pack("<II", warc.DICT_MAGIC, len(d)) + d + b"".join(frames))
        assert [r["payload"] for r in warc.read_records(fs, str(tmp_path / name))] == samples
    (tmp_path / "cut").write_bytes(struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw + frames[0] + frames[1][:-4])
    got = list(warc.read_records(fs, str(tmp_path / "cut")))
    assert got[0]["error"] is None and "cut short" in got[1]["error"] and len(got) == 2
    (tmp_path / "short").write_bytes(struct.pack("<II", warc.DICT_MAGIC, 99) + b"x")
    assert "dictionary" in next(warc.read_records(fs, str(tmp_path / "short")))["error"]
    record = warc.build_record(1, "u", b"hello", None)
    for bad, what in ((record.replace(b"hello", b"hellO"), "digest"), (record.replace(b"Content-Length: ", b"Content-Length: 9"), "content-length"), (record.replace(b"WARC-Date", b"X-Date"), "warc-date"), (b"junk", "version")):
        assert what in warc.parse_record(bad)["error"]


def windows_by_hand(text, items, n=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, own = fold(text), set(), set()
    for i, t in items:
        x = fold(t)
        for p in {tuple(x[k : k + n]) for k in range(max(1, len(x) - n + 1))} if x else ():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    own.add(i)
    return len(w), len(hit), sorted(map(str, own))


def test_decontamination(frame):
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "of", "É1", "x", "Y2"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14])))) for i in range(12)] + [(90, None), (91, "?!"), (92, "solo")]
    docs = [(0, None), (1, ""), (2, "--"), (3, "so-SOLO!"), (4, "x " * 30_000)]
    for i in range(5, 40):
        parts = [word() for _ in range(20)] + rng.choices([t for _, t in items[:12]], k=1)
        docs.append((i, ", ".join(parts) + "\n" + items[i % 12][1].upper() + "."))
    df = frame([(*d, "mine") for d in docs], "doc_id long, text string, items string")
    bench = frame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(df, bench).collect()}
    for i, t in docs:
        assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == windows_by_hand(t, items), i
    spans = got[3]["hit_spans"]
    assert [docs[3][1][s["start"] : s["end"]] for s in spans] == ["SOLO"]
    clean = decontaminate.remove_leaks(df, bench, chars_col=None)
    assert clean.columns == df.columns
    cut = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert cut[3] == "so-!" and cut[0] is None and cut[4] == docs[4][1]
    assert decontaminate.find_leaks(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_several_passes_agree(frame, monkeypatch):
    items = frame([(1, "a b c"), (2, "b c d e"), (3, "q r")], "item_id long, text string")
    df = frame([(1, "x a b c d e y q r a b c"), (2, "none")], "doc_id long, text string")
    one = sorted(map(repr, decontaminate.find_leaks(df, items).collect()))
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 4)
    assert sorted(map(repr, decontaminate.find_leaks(df, items).collect())) == one


def toy_texts(n=120, seed=6):
    rng = random.Random(seed)
    stems = {"aa": ["tha", "ing", "wor", "ber"], "bb": ["éau", "que", "oui", "ment"], "ru": ["при", "вет", "мир", "год"]}
    word = lambda lang: "".join(rng.choices(stems[lang], k=rng.randrange(1, 3)))
    return rng, word, [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in zip(range(n), itertools.cycle(stems), strict=False)]


def test_only_letters_are_words(frame):
    """Numerals of every kind are no letters: a text of them alone has no language, and they cut words."""
    for t in ("½ ²", "Ⅷ", "٣ ৩ 7", "_ _", "①㉈"):
        assert langid.letter_runs(t) == [] and langid.letter_spans(t) == []
    t = "a½b x² Ⅷword _é漢_ no1"
    assert langid.letter_runs(t) == ["a", "b", "x", "word", "é漢", "no"] == [t[a:b] for a, b in langid.letter_spans(t)]
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x30000))))
    assert "".join(langid.letter_runs(every)) == "".join(c for c in every if c.isalpha())
    rng, word, rows = toy_texts()
    model = langid.train(frame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(frame([(1, "½ ²"), (2, "Ⅷ"), (3, word("bb") + "½")], "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "bb"


def test_language_spans(frame):
    rng, word, rows = toy_texts()
    model = langid.train(frame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "ru"] and model.scripts["Cyrillic"] == [False, False, True]
    mixed = " ".join([word("aa") for _ in range(20)] + [word("bb") for _ in range(12)])
    test = [(0, None), (1, "123 !?"), (2, mixed), (3, "привет 中文"), (4, word("bb") + " " * 70_000 + word("bb")), (5, "")]
    test += [(10 + i, t) for i, t, _ in toy_texts(60, 9)[2]]
    got = {r["doc_id"]: r for r in langid.identify(frame([(*x, "q") for x in test], "doc_id long, text string, lang_pred string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 5)] == ["und"] * 3
    assert [s["lang"] for s in got[2]["lang_spans"]] == ["aa", "bb"] and got[2]["lang_pred"] == "aa"
    assert got[3]["lang_pred"] == "ru" and got[4]["lang_pred"] == "bb"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    want = {10 + i: lang for i, _, lang in toy_texts(60, 9)[2]}
    assert sum(got[i]["lang_pred"] == lang for i, lang in want.items()) >= 0.95 * len(want)
    assert langid.identify(frame(test, "doc_id long, text string").limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lab = langid.Labeler(langid.Model(["a", "b", "c"], {}, {}, np.zeros((1, 3), np.float32)))
    sizes = [0, 1, 5, 7, 0, 6]
    e = (rng.normal(size=(sum(sizes), 3)) * 4).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    path = lab.viterbi(e, first)
    cost = lambda p, x: sum(x[t, s] for t, s in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for a, b in zip(first, first[1:], strict=False):
        x = e[a:b]
        best = max((cost(p, x) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert cost(list(path[a:b]), x) == pytest.approx(best, abs=1e-4)


def scored(frame, rows, **kw):
    df = frame(rows, "doc_id long, text string").withColumn("held_out", langid.held_out(7, 2))
    model, counts = brown.train(df.where("not held_out"), **kw)
    return model, brown.score(df, model, counts).collect()


def test_scores_and_base(frame):
    rng = random.Random(8)
    pool = {k: [f"{k}{x}" for x in "abcdefgh"] for k in "pqr"}
    rows = [(i, " ".join(rng.choice(pool["pqr"[j % 3]]) for j in range(rng.randrange(3, 60))).title()) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "never seen Words é"), (1, rows[1][1])]
    low = lambda t: [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in low(t))
    n, v = sum(train.values()), len(train)
    for kw in ({}, {"head": 6, "units": 3, "forms": 4, "classes": 3}):  # all words on the worker; most of them joined
        model, got = scored(frame, rows, **kw)
        assert len(got) == len(rows)
        for r in got:
            w = low(dict(rows)[r["doc_id"]])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
    model, got = scored(frame, rows, classes=4, units=24)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 50
    assert np.allclose((10**model.trans).sum(1), 1)


def test_rare_words_take_the_class_of_their_contexts(frame):
    rng = random.Random(9)
    pool = {k: [f"{k}{x}" for x in "abcd"] for k in "pqr"}
    text = lambda: [rng.choice(pool["pqr"[j % 3]]) for j in range(30)]
    rows = [(i, " ".join(text())) for i in range(120)]
    for i in range(20):  # words of one ending that stand in places of one kind
        w = text()
        w[3], w[10], w[20] = f"p{i}zz", f"q{i}zz", f"r{i}zz"
        rows.append((200 + i, " ".join(w)))
    df = frame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, counts = brown.train(df, head=12, units=12, forms=4, classes=3)
    cls = {r["word"]: r["cls"] for r in counts.collect()}
    for k in "pqr":
        assert len({cls[f"{k}{i}zz"] for i in range(20)}) == 1
    assert len({cls[f"{k}0zz"] for k in "pqr"}) == 3 and cls["pa"] is None
    test = frame([(1, "p1zz qa ra"), (2, "r1zz qa ra"), (3, "pa q1zz r1zz"), (4, "pa r1zz q1zz")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: r["score"] for r in brown.score(test, model, counts).collect()}
    assert got[1] > got[2] + 1 and got[3] > got[4] + 1
    low = [w.split() for _, w in rows]
    number = dict(zip(model.words.tolist(), model.word_id.tolist(), strict=True))
    kind = lambda w: model.cls[number[int(next(x for _, _, x in slices(pa.array([w]), True)).hash[0])]] if cls[w] is None else cls[w]
    pairs = Counter(p for w in low for p in itertools.pairwise([3, *map(kind, w), 3]))
    t = np.array([[pairs[a, b] for b in range(4)] for a in range(4)])
    prior = (t.sum(0) + 0.1) / (t.sum() + 0.4)
    assert np.allclose(10**model.trans, (t + brown.BACK_OFF * prior) / (t.sum(1, keepdims=True) + brown.BACK_OFF))
    # every text's score from the definition: class transitions, and words from their class's mass of counts
    count = Counter(w for x in low for w in x)
    mass = np.zeros(4)
    for w, c in count.items():
        mass[kind(w)] += c + brown.FLAT
    mass[3] += len(rows) + brown.FLAT
    forms = range(1 + len(model.words), model.n_ids)
    once = Counter(w[-2:] for w, c in count.items() if cls[w] is not None and c == 1)
    assert sum(model.counts[f] for f in forms) == sum(once.values())
    for f in forms:
        mass[model.cls[f]] += model.counts[f] + brown.FLAT
    every = {r["doc_id"]: r["score"] for r in brown.score(df, model, counts).collect()}
    for (i, _), x in zip(rows, low, strict=True):
        steps = [*((kind(w), count[w]) for w in x), (3, len(rows))]
        want = sum(model.trans[a, b] + math.log10((c + brown.FLAT) / mass[b]) for a, (b, c) in zip([3, *(k for k, _ in steps)], steps, strict=False))
        assert every[i] == pytest.approx(want)


def test_exchange_stops_where_no_move_gains():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 9, (14, 14)).astype(float)
    cls = brown.exchange(pairs, 4, sweeps=200)
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()

    def worth(c):
        hot = np.eye(4)[c]
        t = hot.T @ pairs @ hot
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    for u in range(14):
        for b in range(4):
            moved = cls.copy()
            moved[u] = b
            assert worth(moved) <= worth(cls) + 1e-6


def test_exchange_finds_the_classes():
    kinds = [0, 1, 2] * 5
    pairs = np.array([[float(kinds[b] == (kinds[a] + 1) % 3) * 9 + 0.1 for b in range(15)] for a in range(15)])
    cls = brown.exchange(pairs, 3)
    assert len({(k, c) for k, c in zip(kinds, cls, strict=True)}) == 3


def test_scores_of_nothing(frame):
    df = frame([(1, "a b")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, counts = brown.train(df)
    assert brown.score(df.limit(0), model, counts).count() == 0


def test_found_words_are_listed_after_their_shuffle(frame):
    rows = [(i, f"a b w{i // 2} x{i} w{i // 2}") for i in range(12)] + [(3, "a b w1 x3 w1"), (None, "a x3"), (None, "a x3")]
    df = frame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, counts = brown.train(df, head=2, units=2, forms=2, classes=2)
    out = brown.score(df, model, counts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_" in plan and "collect_" not in plan[plan.index("REPARTITION_BY_COL") :]  # no lists in the shuffle's files
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_known"] == r["n_tokens"] for r in got)
    assert len({tuple(r) for r in got if r["doc_id"] in (None, 3)}) == 2


def test_training_reads_the_texts_once_besides_their_counts(spark, frame):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(9)) + f" x{i}") for i in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = frame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    model, counts = brown.train(df, head=12, units=4, forms=3, classes=3)
    assert counts.count() == len({w for _, t in rows for w in t.split()})
    assert read.value <= 3 * len(rows)  # word counts, number of texts, encoding; not again for pairs, neighbours and contexts
    held = frame(rows, "doc_id long, text string").withColumn("held_out", F.lit(True))
    assert all(r["n_known"] == r["n_tokens"] for r in brown.score(held, model, counts).collect())


def test_encoded_texts(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b É zz b Zz q\u00a0q zz e é"), (None, "zz"), (4, "a a a"), (6, "b é " * 400)]
    df = frame(rows, "doc_id long, text string")
    m, counts = brown.vocabulary(df, head=2, forms=2)
    assert {r["word"]: r["c"] for r in counts.collect()} == Counter(w for _, t in rows for w in re.sub("[A-Z]", lambda x: x[0].lower(), t or "").split(" ") if w.strip())
    top = ["b", "é"]
    number = {w: int(m.word_id[list(m.words).index(slices_hash(w))]) for w in top}
    got = brown.encode(df, m).collect()
    assert len(got) == len(rows) and len({r["row"] for r in got}) == len(rows)
    left = [(i, [w for w in re.sub("[A-Z]", lambda x: x[0].lower(), t or "").split(" ") if w.strip()]) for i, t in rows]
    back = []
    for r in got:
        ids, place = np.frombuffer(r["ids"], m.dtype), np.frombuffer(r["place"], brown.PLACE)
        where, seen, text = iter(brown._places(place, np.array([0, len(place)]))[0]), {v: k for k, v in number.items()}, []
        for x in ids[:-1]:
            text.append(seen[x] if x in seen else r["words"][next(where)])
        assert ids[-1] == 0 and len(set(r["words"])) == len(r["words"]) and not set(r["words"]) & set(top)
        back.append((r["doc_id"], text))
    assert sorted(back, key=str) == sorted(left, key=str)


def slices_hash(word):
    return next(w for _, _, w in slices(pa.array([word]), True)).hash[0]


def test_counts_of_words_in_parts(monkeypatch):
    monkeypatch.setattr(brown, "HELD", 3)
    texts = [" ".join(f"W{(i * j) % 13}" for j in range(20)) for i in range(30)]
    total, parts = Counter(), 0
    for b in brown._counted(pa.RecordBatch.from_arrays([pa.array([t, None, ""])], names=["text"]) for t in texts):
        parts += 1
        for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[w] += c
    assert total == Counter(w.lower() for t in texts for w in t.split()) and parts > 2
    assert list(brown._counted(iter([pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"])]))) == []


def test_class_of_a_rare_word_does_not_depend_on_the_order_of_its_rows():
    near = np.zeros((6, 2))
    near[[0, 2, 4], 0], near[[0, 2, 4], 1] = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]
    for order in itertools.permutations(range(3)):
        rows = pa.RecordBatch.from_arrays([pa.array([7] * 3, pa.int64()), pa.array([2 * left * 6 for left in order], pa.int64())], names=["h", "k"])
        got = pa.Table.from_batches(brown._assign(near, 3)(iter([rows]))).to_pylist()
        assert [(r["h"], r["cls"]) for r in got if r["h"] is not None] == [(7, 0)]
