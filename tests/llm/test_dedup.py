"""Near-duplicate groups, passages and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seqlake.llm import neardup, substring
from seqlake.llm.wordhash import slices
from seqlake.operators.graph import components as connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 5)))
    docs = {0: "", 1: None, 2: " \t\n", 3: "one", 4: "ONE", 5: "one two", 6: "x" * 30_000}
    base = [word() for _ in range(120)]
    docs[10], docs[11] = " ".join(base), "\n".join(w.upper() for w in base)
    for i in range(20, 60):  # a star: near the base, less near to each other
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = word()
        docs[i] = " ".join(w)
    docs[12], docs[13] = docs[10] + " end", "start " + docs[10]
    docs[14] = " ".join(word() + str(k) for k in range(300))
    docs[15] = docs[14] + " tail"
    for i in range(60, 75):  # a chain
        w = docs[i - 1 if i > 60 else 10].split()
        w[(i * 7) % len(w)] = word()
        docs[i] = " ".join(w)
    for i in range(80, 110):
        docs[i] = " ".join(word() for _ in range(rng.randrange(1, 200)))
    return docs


def test_near_duplicates_match_brute_force(frame):
    docs = corpus()
    for k, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(frame(list(docs.items()), "doc_id long, text string"), shingle=k, percent=percent)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_groups(docs, k, percent)


def test_near_duplicates_edge_cases(frame):
    rows = [(None, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "A b c d", "z"), (3, None, None)]
    df = frame(rows, "doc_id long, text string, component_id string")
    got = neardup.near_duplicates(df).collect()
    assert sorted((r["id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_repeated_and_null_ids_are_rows_of_their_own(frame):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, one, "p"), (7, two, "p"), (8, one + " end", "p"), (9, two + " end", "p"), (None, one, "p"), (None, "x y z", "p"), (None, "x y z", "p"), (None, " ", "p"), (None, None, "p")]
    df = frame(rows, "doc_id long, text string, source string")
    got = sorted(((r["id"] is None, r["id"] or 0, r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()), key=str)
    want = [(False, 7, 36, 7), (False, 7, 36, 7), (False, 8, 37, 7), (False, 9, 37, 7), (True, 0, 36, 7), (True, 0, 1, None), (True, 0, 1, None), (True, 0, 0, None), (True, 0, 0, None)]
    assert got == sorted(want, key=str)
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in neardup.keep_one(df).collect())
    assert kept == sorted([("7", one), ("7", two), ("None", "x y z"), ("None", " "), ("None", "None")])


def test_a_star_of_far_edits_matches_brute_force(frame):
    """Edits on both sides of the threshold, some with rare edits in common, so that every step after the leaders runs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    docs = {}
    for i in range(120):
        w = list(docs[rng.randrange(i)].split()) if i % 5 == 4 else list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(["red", "blue", f"v{rng.randrange(10**6)}"])
        docs[i] = " ".join(w[rng.randrange(4) :])
    for k, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(frame(list(docs.items()), "doc_id long, text string"), shingle=k, percent=percent)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_groups(docs, k, percent)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    least = lambda *x: neardup.least(list(x), neardup.FINE, 2)
    assert (neardup.registers(least(a, b).min(0)) == neardup.registers(least(np.concatenate([a, b]))[0])).all()
    same = np.concatenate([a[:3600], b[:400]])
    reg = [neardup.registers(least(x)) for x in (a, same, b)]
    # least exponential variates of 4000: mean 1/4000; equal registers tell the similarity
    assert abs(least(a).mean() * 4000 - 1) < 0.2 and abs((reg[0] == reg[1]).mean() - 3600 / 4400) < 0.1
    few = neardup.least([a[:1], a[:3], a[:40]])
    assert np.isfinite(few).all() and (few[0] >= few[1]).all() and (few[1] >= few[2]).all()
    n = np.array([4000.0])
    assert neardup.likely(reg[0], reg[1], n, n, 0.8).all()
    assert not neardup.likely(reg[0], reg[2], n, n, 0.8).any()
    assert neardup.likely(reg[0], reg[0], n, n + 1, 0.8).all()


def test_components(frame):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    got = {r["node"]: r["component"] for r in connected_components(frame(links, "a int, b int")).collect()}
    assert got == {n: c for n, c in want.items() if any(x != n for x in near[n])}


def brute_passages(docs, n):
    first = {}
    for i in sorted(docs):
        w = WORDS.findall(docs[i] or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in docs.items():
        w = WORDS.findall(t or "")
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_passages_match_brute_force(frame):
    rng = random.Random(7)
    word = lambda: rng.choice("the of and a in to Ä é x1 y2".split()) + str(rng.randrange(40))
    share = [[word() for _ in range(n)] for n in (11, 12, 13, 40)]
    docs = {0: "", 1: None, 2: "z " * 50, 3: "z " * 12, 4: "Z " * 20}
    for i in range(5, 60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for s in rng.choices(share, k=rng.randrange(3)):
            at, cut = rng.randrange(len(w) + 1), rng.randrange(4)
            w[at:at] = s[cut:]
        docs[i] = "\n".join([" ".join(w[:9]), "  ".join(w[9:])])
    want = brute_passages(docs, 12)
    for batches in (1, 3):
        got = substring.dedup_passages(frame(list(docs.items()), "doc_id long, text string"), window=12, batches=batches)
        assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == want


def test_passages_edge_cases(frame):
    t = " ".join(f"w{i}" for i in range(60))
    df = frame([(None, t), (1, t), (1, t), (2, t + " end"), (3, None), (4, "b " + t), (4, t)], "doc_id long, text string")
    got = sorted((r["id"] or 0, r["n_words"], r["n_removed"]) for r in substring.dedup_passages(df).collect())
    assert got == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 61, 60), (3, 0, 0), (4, 60, 0), (4, 61, 60)]
    assert substring.dedup_passages(df.limit(0)).count() == 0


def test_a_stored_index_is_opened_again(spark, frame, tmp_path):
    """Batches added by other index objects, compaction between them, string ids, and a late batch of smaller ids."""
    rng = random.Random(5)
    share = [" ".join(f"s{k}_{i}" for i in range(15)) for k in range(3)]
    docs = {f"d{i:02}": " ".join(f"x{rng.randrange(10**6)}" for _ in range(9)) + " " + rng.choice(share) for i in range(20)}
    want = brute_passages(docs, 12)
    order = [list(docs)[8:14], list(docs)[14:], list(docs)[:8]]
    gone, seen = {}, []
    for names in order:
        index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", 12)
        kind = "id string, text string"
        found = index.add(frame([(x, docs[x]) for x in names], kind), frame([(x, docs[x]) for x in seen], kind))
        for r in found.collect():
            gone.setdefault(r["id"], set()).update(r["gone"])
        seen += names
    kept = {x: " ".join(w for i, w in enumerate(t.split()) if not any(a <= i < a + 12 for a in gone.get(x, ()))) for x, t in docs.items()}
    assert kept == {x: w[2] for x, w in want.items()}
    last = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", 12)
    assert last.version == 3 and len(last.runs) < 3
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, f"file://{tmp_path}/index", 50)


def test_a_hash_shared_by_other_words_is_settled_by_words(spark, frame, monkeypatch):
    index = substring.FingerprintIndex(spark, window=3)
    texts = frame([(1, "a b c", [0]), (2, "a b c", [0]), (3, "x y z", [0])], "id long, text string, marks array<long>")
    monkeypatch.setattr(substring.Words, "windows", lambda self, k, salt=0: np.zeros(max(0, len(self.hash) - k + 1), dtype=np.uint64))
    h = next(w for _, _, w in slices(pa.array(["a b c"]), False)).windows(3)
    assert list(h) == [0]
    exact = [b.to_pylist() for b in substring._exact(3)(iter(pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]]), pa.array([[0]], pa.list_(pa.int64()))], names=["id", "text", "hs"]) for r in texts.select("id", "text").collect()))]
    keys = {r[0]["id"]: r[0]["key"] for r in exact}
    assert keys[1] == keys[2] != keys[3] and index.runs == []


def test_words_agree_with_the_pattern():
    texts = ["", None, " a  b\tc\n", "é x\x0by", "one", "\x1f \x85q", "end "]
    got = [None] * len(texts)
    for i, j, w in slices(pa.array(texts), False):
        for r in range(j - i):
            got[i + r] = [bytes(w.data[s:e]).decode() for s, e in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)]
    assert got == [WORDS.findall(t or "") for t in texts]
    assert hashlib.sha256(next(w for _, _, w in slices(pa.array(["a bb a"]), False)).hash.tobytes()).hexdigest() == hashlib.sha256(next(w for _, _, w in slices(pa.array(["A BB a"]), True)).hash.tobytes()).hexdigest()
