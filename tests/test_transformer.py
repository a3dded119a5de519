"""Sentence model against plain loops; reading of weights; odd rows."""

import math
import pickle

import numpy as np
import pytest

from seqlake.operators import transformer
from seqlake.operators.transformer import SentenceModel


def _weights(rng, vocab=9, length=5, size=6, heads=2, hidden=4):
    d, n = size // heads, lambda *s: rng.normal(size=s)
    b = "encoder.layers."
    return {
        transformer.WORDS: n(vocab, size), transformer.PLACES: n(length, size), b + "attention.values.weight": n(d, d), b + "attention.keys.weight": n(d, d), b + "attention.queries.weight": n(d, d),
        b + "attention.fc_out.weight": n(size, size), b + "attention.fc_out.bias": n(size), b + "norm1.weight": n(size), b + "norm1.bias": n(size), b + "norm2.weight": n(size), b + "norm2.bias": n(size),
        b + "feed_forward.0.weight": n(4 * size, size), b + "feed_forward.0.bias": n(4 * size), b + "feed_forward.2.weight": n(size, 4 * size), b + "feed_forward.2.bias": n(size),
        "fc1.weight": n(hidden, length * size), "fc1.bias": n(hidden), "bn.running_mean": n(hidden), "bn.running_var": rng.uniform(0.5, 2, hidden), "bn.weight": n(hidden), "bn.bias": n(hidden), "out.weight": n(1, hidden), "out.bias": n(1),
    }


def _dot(w, x, b=None):
    return [sum(a * c for a, c in zip(row, x)) + (b[i] if b is not None else 0) for i, row in enumerate(w)]


def _plain_norm(x, g, b):
    m = sum(x) / len(x)
    v = sum((a - m) ** 2 for a in x) / len(x)
    return [(a - m) / math.sqrt(v + 1e-5) * c + d for a, c, d in zip(x, g, b)]


def _plain(tokens, w, heads, pad=0):
    b, size = "encoder.layers.", w[transformer.WORDS].shape[1]
    d = size // heads
    x = [[a + c for a, c in zip(w[transformer.WORDS][t], w[transformer.PLACES][p])] for p, t in enumerate(tokens)]
    out = []
    for p in range(len(tokens)):
        row = []
        for h in range(heads):
            part = lambda i: x[i][h * d : h * d + d]
            q = _dot(w[b + "attention.queries.weight"], part(p))
            e = [-1e20 if t == pad else sum(y * z for y, z in zip(q, _dot(w[b + "attention.keys.weight"], part(i)))) for i, t in enumerate(tokens)]
            e = [v / math.sqrt(size) for v in e]
            top = max(e)
            a = [math.exp(v - top) for v in e]
            a = [v / sum(a) for v in a]
            values = [_dot(w[b + "attention.values.weight"], part(i)) for i in range(len(tokens))]
            row += [sum(a[i] * values[i][k] for i in range(len(tokens))) for k in range(d)]
        y = _plain_norm([u + v for u, v in zip(_dot(w[b + "attention.fc_out.weight"], row, w[b + "attention.fc_out.bias"]), x[p])], w[b + "norm1.weight"], w[b + "norm1.bias"])
        wide = [max(0, v) for v in _dot(w[b + "feed_forward.0.weight"], y, w[b + "feed_forward.0.bias"])]
        out += _plain_norm([u + v for u, v in zip(_dot(w[b + "feed_forward.2.weight"], wide, w[b + "feed_forward.2.bias"]), y)], w[b + "norm2.weight"], w[b + "norm2.bias"])
    z = _dot(w["fc1.weight"], out, w["fc1.bias"])
    z = [(v - m) / math.sqrt(s + 1e-5) * g + c for v, m, s, g, c in zip(z, w["bn.running_mean"], w["bn.running_var"], w["bn.weight"], w["bn.bias"])]
    return _dot(w["out.weight"], z, w["out.bias"])[0]


def test_forward_pass_is_that_of_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    w = _weights(rng)
    tokens = rng.integers(0, 9, (12, 5))
    tokens[0], tokens[1] = 0, [3, 0, 0, 0, 0]
    want = [_plain(t, w, 2) for t in tokens]
    assert np.allclose(SentenceModel(w, 2)(tokens), want, atol=1e-9)
    monkeypatch.setattr(transformer, "CELLS", 100)  # two sentences at a time
    assert np.allclose(SentenceModel(w, 2)(tokens), want, atol=1e-9) and len(SentenceModel(w, 2)(tokens[:0])) == 0


def test_pads_change_nothing_at_other_places():
    rng = np.random.default_rng(5)
    w = _weights(rng)
    tokens = np.array([[3, 5, 0, 0, 0]])
    before = SentenceModel(w, 2).encode(tokens)
    w[transformer.WORDS][0] += 7.0
    assert np.allclose(SentenceModel(w, 2).encode(tokens)[0, :2], before[0, :2]) and not np.allclose(SentenceModel(w, 2).encode(tokens)[0, 2:], before[0, 2:])
    with pytest.raises(ValueError):
        SentenceModel(w, 4)


def test_scores_from_an_archive(spark, tmp_path):
    rng = np.random.default_rng(6)
    w = _weights(rng)
    at = str(tmp_path / "model.npz")
    np.savez(at, **w)
    read = transformer.read_weights(spark, at)
    assert set(read) == set(w) and all(np.array_equal(read[k], w[k]) for k in w)
    rows = [("a", [1, 2, 3, 0, 0], 9.0), ("b", [8, 0, 0, 0, 0], 9.0), ("n", None, 9.0), ("a", [1, 2, 3, 0, 0], 9.0)]
    df = spark.createDataFrame(rows, "accession string, tokens array<int>, score double").repartition(2)
    got = {(r.accession, r.score if r.score is None else round(r.score, 9)) for r in transformer.score_sentences(df, read, heads=2, batch_size=2).collect()}
    sig = lambda t: round(1 / (1 + math.exp(-_plain(t, w, 2))), 9)
    assert got == {("a", sig(rows[0][1])), ("b", sig(rows[1][1])), ("n", None)}
    assert transformer.score_sentences(df.limit(0), read, heads=2).count() == 0


def test_hostile_archives_are_refused(spark, tmp_path):
    class Bad:
        def __reduce__(self):
            return (print, ("run",))

    at = tmp_path / "bad.npz"
    np.savez(at, x=np.array([Bad()], dtype=object))
    with pytest.raises(ValueError):
        transformer.read_weights(spark, str(at))
    (tmp_path / "raw.npz").write_bytes(pickle.dumps({"a": 1}))
    with pytest.raises(Exception):
        transformer.read_weights(spark, str(tmp_path / "raw.npz"))
    (tmp_path / "empty.npz").write_bytes(b"")
    with pytest.raises(ValueError):
        transformer.read_weights(spark, str(tmp_path / "empty.npz"))
