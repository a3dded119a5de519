"""Densities of profile differences: mixtures fitted on the cluster, and the best reference of each query by blocks of both sides.

A fit passes over the differences once a round: tasks add up the responsibilities of their rows, a grouped sum adds up the
tasks, and only the parameters (a few hundred numbers for each component) come back. A search packs both sides into small
blocks of vectors and deals the blocks to tiles of bounded size; each pair of tiles is work of one task, which holds the
queries while the references pass by in chunks. So neither side passes through the driver, is copied to every task or is
sent again for each block of the other, and no reader, sorter or task holds a whole tile of references.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.storage import discard, materialize

#: Numbers in one block of vectors (8 bytes each), a row: Parquet and Arrow readers hold thousands of rows at once.
NUMBERS = 1 << 10
#: Numbers in a tile of queries, on average; a task holds one.
TILE = 1 << 22
#: Numbers in a tile of references, on average; they pass by a tile of queries.
STREAM = 1 << 25
#: Numbers of references that are scored at once, and of queries; a vector counts as WIDTH at least.
CHUNK, WIDTH = 1 << 20, 64
#: Vectors that are packed at once.
PACKED = 2048
#: Pairs of tiles that share the work where the tables are small.
SPREAD = 32


@dataclass(frozen=True)
class Mixture:
    """Gaussians with diagonal covariance: weights (k), means and variances (k x d)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component at the rows of x."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, v) in enumerate(zip(self.weights, self.means, self.variances, strict=True)):
            m, v = np.broadcast_to(m, x.shape[1]), np.broadcast_to(v, x.shape[1])
            out[:, k] = np.log(w) - 0.5 * (((x - m) ** 2 / v).sum(1) + np.log(2 * np.pi * v).sum())
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.parts(x), axis=1)

    def between(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Log-density of q - r for all rows of both: one matrix product for each component."""
        found = None
        for w, m, v in zip(self.weights, self.means, self.variances, strict=True):
            m, v = np.broadcast_to(m, q.shape[1]), np.broadcast_to(v, q.shape[1])
            a, b = (q - m) / np.sqrt(v), r / np.sqrt(v)
            one = a @ b.T
            one *= 2
            one -= (a * a).sum(1)[:, None]
            one -= (b * b).sum(1)
            np.minimum(one, 0, out=one)
            one *= 0.5
            one += np.log(w) - 0.5 * np.log(2 * np.pi * v).sum()
            found = one if found is None else np.logaddexp(found, one)
        return found


def gaussian(width: float) -> Mixture:
    """One isotropic Gaussian of standard deviation `width`."""
    return Mixture(np.ones(1), np.zeros((1, 1)), np.full((1, 1), float(width) ** 2))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sums(models: dict[int, Mixture]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each model: log-likelihood, rows, and by component the sums of responsibility, of values and of squares."""
        held: dict[int, np.ndarray] = {}
        for b in batches:
            kinds, x = b.column("model").to_numpy(), _vectors(b.column("x"))
            for k in set(kinds.tolist()):
                own, m = x[kinds == k], models[k]
                parts = m.parts(own)
                total = np.logaddexp.reduce(parts, axis=1)
                r = np.exp(parts - total[:, None])
                held[k] = held.get(k, 0) + np.concatenate([[total.sum(), len(own)], r.sum(0), (r.T @ own).ravel(), (r.T @ (own * own)).ravel()])
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["model", "sums"])

    return sums


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each model: rows, and the sums of values and of squares."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        kinds, x = b.column("model").to_numpy(), _vectors(b.column("x"))
        for k in set(kinds.tolist()):
            own = x[kinds == k]
            held[k] = held.get(k, 0) + np.concatenate([[len(own)], own.sum(0), (own * own).sum(0)])
    for k, v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["model", "sums"])


def fit_gaussians(differences: DataFrame, floor: float = 1e-6) -> dict[int, Mixture]:
    """The likeliest Gaussian of each model from rows (model, x), in one pass that stores nothing: see fit_mixtures()."""
    rows = differences.where("model IS NOT NULL AND x IS NOT NULL").select(F.col("model").cast("int").alias("model"), F.col("x").cast("array<double>").alias("x"))
    summed = rows.mapInArrow(_moments, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v"))
    found: dict[int, dict] = {}
    for r in summed.collect():  # two numbers for each model and dimension
        found.setdefault(r.model, {})[r.at] = r.v
    models = {}
    for k, own in sorted(found.items()):
        s = np.array([own[i] for i in range(len(own))])
        means, squares = (s[1:] / s[0]).reshape(2, 1, -1)
        models[k] = Mixture(np.ones(1), means, np.maximum(squares - means**2, floor))
    return models


def fit_mixtures(differences: DataFrame, components: int = 1, rounds: int = 50, gain: float = 1e-4, floor: float = 1e-6) -> dict[int, Mixture]:
    """Mixture of each model from rows (model, x), by expectation maximisation over all rows.

    The first means are the `components` rows of the least hash, the first variances those of all rows. Rounds end when no
    model's mean log-likelihood gains more than `gain`. Variances are at least `floor`. Rows with a null model or vector
    are left out; a model without rows has no mixture; fewer rows than components give as many components as rows. One
    component needs no rounds: mean and variance of all rows are the likeliest.
    """
    if components == 1:
        return fit_gaussians(differences, floor)
    rows = materialize(differences.where("model IS NOT NULL AND x IS NOT NULL").select(F.col("model").cast("int").alias("model"), F.col("x").cast("array<double>").alias("x")), "differences")
    first = rows.withColumn("_no", F.row_number().over(Window.partitionBy("model").orderBy(F.xxhash64("x"), "x"))).where(F.col("_no") <= components).orderBy("model", "_no").collect()
    spread = {r.model: r for r in rows.select("model", F.posexplode("x").alias("at", "v")).groupBy("model", "at").agg(F.var_pop("v").alias("v")).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).collect()}
    models: dict[int, Mixture] = {}
    for k in spread:
        means = np.array([r.x for r in first if r.model == k], float)
        models[k] = Mixture(np.full(len(means), 1 / len(means)), means, np.tile(np.maximum([x.v for x in spread[k].v], floor), (len(means), 1)))
    before = dict.fromkeys(models, -np.inf)
    for _ in range(rounds if models else 0):
        summed = rows.mapInArrow(_sums(models), "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v"))
        found = {}
        for r in summed.collect():  # two numbers for each component and dimension
            found.setdefault(r.model, {})[r.at] = r.v
        better = False
        for k, own in found.items():
            s = np.array([own[i] for i in range(len(own))])
            n, (size, d) = s[1], models[k].means.shape
            mass, s1, s2 = s[2 : 2 + size], s[2 + size : 2 + size + size * d].reshape(size, d), s[2 + size + size * d :].reshape(size, d)
            mass = np.maximum(mass, 1e-300)
            means = s1 / mass[:, None]
            models[k] = Mixture(np.maximum(mass / n, 1e-300), means, np.maximum(s2 / mass[:, None] - means**2, floor))
            better |= bool(s[0] / n - before[k] > gain)
            before[k] = s[0] / n
        if not better:
            break
    discard(rows)
    return models


def _pack(kind: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of NUMBERS numbers at most, compressed, rows by model, then id."""
        codec = pa.Codec("lz4")
        for b in (x.slice(k, PACKED) for x in batches for k in range(0, x.num_rows, PACKED)):
            ids, model, v = b.column("id").to_pylist(), b.column("model").to_pylist(), _vectors(b.column("v"))
            order = sorted(range(len(ids)), key=lambda k: (model[k], ids[k]))
            step = max(1, NUMBERS // max(1, v.shape[1]))
            v, starts = v[order], range(0, len(order), step)
            ends = pa.array([*starts, len(order)], pa.int32())
            blocks = [v[at : at + step] for at in starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends, pa.array([ids[k] for k in order], kind)), pa.ListArray.from_arrays(ends, pa.array([model[k] for k in order], pa.int32())),
                    pa.array([x.size for x in blocks], pa.int32()), pa.array([codec.compress(x.tobytes(), asbytes=True) for x in blocks], pa.binary()),
                ],
                ["ids", "models", "numbers", "v"],
            )

    return pack


def _unpacked(t: pa.Table, ids: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors and which rows are finite, of blocks."""
    names, sizes = pa.concat_arrays([c.flatten() for c in t[ids].chunks]), t["numbers"].to_pylist()
    x, at, codec = np.empty(sum(sizes)), 0, pa.Codec("lz4")
    for block, size in zip(t["v"], sizes, strict=True):
        x[at : at + size] = np.frombuffer(codec.decompress(block.as_buffer(), 8 * size))
        at += size
    x = x.reshape(len(names), -1)
    return names, x, np.isfinite(x).all(1)


def _distinct(r: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Of rows sorted by id (code: its number), for each vector those of the two least ids: a third is never a best one."""
    _, group = np.unique(np.ascontiguousarray(r).view(np.dtype((np.void, r.itemsize * r.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    g, c = group[order], code[order]
    new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
    order, g = order[new], g[new]
    return np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < 2])


def _nearest(rule: Mixture, q: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best row of r, score) of each row of q under one Gaussian, without rows low:high; -inf where none is left.

    Single precision finds which references can be the best one: its error is at most (d + 8) * 2**-24 times the product
    of both norms and half the reference's square. These are scored in double precision, ties to the first row.
    """
    d = q.shape[1]
    mean, dev = np.broadcast_to(rule.means[0], d), np.sqrt(np.broadcast_to(rule.variances[0], d))
    centre = r.mean(0)
    a, b = (q - mean - centre) / dev, (r - centre) / dev
    half, size = 0.5 * (b * b).sum(1), np.sqrt((a * a).sum(1))
    by = np.argsort(half, kind="stable")  # like norms together, so that an outlier loosens no other's bound
    place = np.argsort(by)
    b32 = np.concatenate([b[by], -half[by, None]], axis=1).astype(np.float32)
    del b
    best, score = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
    parts = [(x, min(x + 2048, len(r))) for x in range(0, len(r), 2048)]
    error = (d + 8) * 2.0**-24 * (size[:, None] * np.sqrt(2 * half[by[[y - 1 for _, y in parts]]]) + half[by[[y - 1 for _, y in parts]]])
    for at in range(0, len(q), 512):
        n = min(512, len(q) - at)
        near = np.concatenate([a[at : at + n], np.ones((n, 1))], axis=1).astype(np.float32) @ b32.T
        for i in np.flatnonzero(low[at : at + n] < high[at : at + n]).tolist():
            near[i, place[low[at + i] : high[at + i]]] = -np.inf
        top = np.stack([near[:, x:y].max(1) for x, y in parts], axis=1).astype(float)
        bound = (top - error[at : at + n]).max(1)[:, None] - error[at : at + n] - 1e-6
        for k, (x, y) in enumerate(parts):
            rows = np.flatnonzero((top[:, k] >= bound[:, k]) & (top[:, k] > -np.inf))
            i, j = np.nonzero(near[rows, x:y] >= bound[rows, k, None])
            i, j = at + rows[i], by[x + j]
            for z in range(0, len(i), 4096):
                u, w = i[z : z + 4096], j[z : z + 4096]
                value = np.round(rule(q[u] - r[w]), 7)
                order = np.lexsort((w, -value, u))
                order = order[np.append(True, u[order][1:] != u[order][:-1])]
                u, w, value = u[order], w[order], value[order]
                better = (value > score[u]) | ((value == score[u]) & (w < best[u]))
                best[u[better]], score[u[better]] = w[better], value[better]
    return best, score


def _plain(rule: Callable | Mixture | None, q: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _nearest, for any model: all pairs in double precision."""
    best, score = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
    for at in range(0, len(r), 2048):
        y, part = min(at + 2048, len(r)), r[at : at + 2048]
        for i in range(0, len(q), 512):
            own = q[i : i + 512]
            value = own @ part.T if rule is None else rule.between(own, part) if isinstance(rule, Mixture) else np.stack([rule(x - part) for x in own])
            value = np.round(value, 7)
            for k in np.flatnonzero((low[i : i + 512] < y) & (high[i : i + 512] > at)).tolist():
                value[k, max(0, low[i + k] - at) : max(0, high[i + k] - at)] = -np.inf
            top = value.argmax(1)
            value = value[np.arange(len(own)), top]
            better = i + np.flatnonzero(value > score[i : i + 512])
            best[better], score[better] = at + top[better - i], value[better - i]
    return best, score


def _best_of_tiles(models: dict, skip_same: bool, own: pa.DataType, kind: pa.DataType):
    held: dict = {}  # the last queries, which come again with each chunk of references

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("id", own), ("best", kind), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        if held.get("of") is not left:
            held.clear()
            names, q, whole = _unpacked(left, "ids")
            held.update(of=left, own=(names, names.to_pylist() if skip_same else [], q, whole, pa.concat_arrays([c.flatten() for c in left["models"].chunks]).to_numpy()))
        names, listed, q, whole, kinds = held["own"]
        refs, r, ok = _unpacked(right, "rids")
        order = pc.array_sort_indices(refs).to_numpy()
        order = order[ok[order]]
        refs = refs.take(pa.array(order))
        code: dict = {}
        number = np.array([code.setdefault(x, len(code)) for x in refs.to_pylist()], np.int64)
        if not len(number):
            return out.empty_table()
        keep = _distinct(r[order], number)
        r, refs, number = r[order[keep]], refs.take(pa.array(keep)), number[keep]
        same = np.array([code.get(x, -1) for x in listed] if skip_same else [-1] * len(names))
        low, high = np.searchsorted(number, same), np.searchsorted(number, same, side="right")
        found, score = np.zeros(len(names), np.int64), np.full(len(names), -np.inf)
        most, step = np.abs(r).max(initial=0), max(1, CHUNK // max(WIDTH, q.shape[1]))
        for m, rule in models.items():
            every = np.flatnonzero((kinds == m) & whole)
            for at in (every[k : k + step] for k in range(0, len(every), step)):
                one = isinstance(rule, Mixture) and len(rule.weights) == 1 and max(np.abs(q[at]).max(), most) < 1e12 * np.sqrt(np.min(rule.variances))
                found[at], score[at] = (_nearest if one else _plain)(rule, q[at], r, low[at], high[at])
        at = np.flatnonzero(score > -np.inf)
        return pa.Table.from_arrays([names.take(pa.array(at)), refs.take(pa.array(found[at])), pa.array(score[at])], schema=out)

    return best


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(tile, whether these are references, rows): neighbours of one tile and side, references of `most` numbers at most, or one row."""
    for b in batches:
        tile, refs = b.column("tile").to_numpy(), b.column("rids").is_valid().to_numpy(zero_copy_only=False)
        new = np.flatnonzero((tile[1:] != tile[:-1]) | (refs[1:] != refs[:-1])) + 1
        for at, end in zip([0, *new], [*new, len(tile)], strict=True):
            own = b.slice(at, end - at)
            step = max(1, most // _weights(own).max()) if end > at and refs[at] else max(1, end - at)
            for k in range(0, end - at, step):
                yield int(tile[at]), bool(refs[at]), own.slice(k, step)


def _weights(refs: pa.RecordBatch) -> np.ndarray:
    """Numbers of each block of references, at least WIDTH for a vector."""
    return np.maximum(refs.column("numbers").to_numpy(), WIDTH * pc.list_value_length(refs.column("rids")).to_numpy())


def _better(found: pa.Table, new: pa.Table) -> pa.Table:
    """Of two tables of (id, best, score) the row of each id of the highest score, then of the least reference."""
    both = pa.concat_tables([found, new])
    both = both.take(pc.sort_indices(both, sort_keys=[("id", "ascending"), ("score", "descending"), ("best", "ascending")])).combine_chunks()
    ids = both["id"]
    return both.filter(pa.array(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy()))) if len(both) else both


def _search(run: Callable[[pa.Table, pa.Table], pa.Table]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile, queries first: the queries of a tile are held, its references are let go chunk by chunk."""
        tile, left, right, weight, found = None, [], [], 0, []

        def scored() -> list[pa.Table]:
            new = run(left[0], pa.Table.from_batches(right)) if left and right else None
            return found if new is None else [_better(*found, new) if found else new]

        for at, refs, part in _runs(batches, CHUNK):
            if at != tile:
                for t in scored():
                    yield from t.to_batches()
                tile, left, right, weight, found = at, [], [], 0, []
            if not refs:
                left.append(part)
            elif left:  # without queries there is nothing to find
                if len(left) > 1 or not isinstance(left[0], pa.Table):
                    left = [pa.Table.from_batches(left).combine_chunks()]
                own = int(_weights(part).sum())
                if right and weight + own > CHUNK:
                    found, right, weight = scored(), [], 0
                right.append(part)
                weight += own
        for t in scored():
            yield from t.to_batches()

    return search


def best_reference(queries: DataFrame, refs: DataFrame, models: dict[int, Callable | Mixture | None], skip_same: bool = False) -> DataFrame:
    """(id, best, score): for each query (id, v, model) the reference (id, v) that its model scores highest, ties (seven
    places after the point) to the least id.

    A model is a Mixture of query less reference, a function from rows of differences to scores, or None for the dot
    product. A query of a null or unknown model, and one without any reference, gets no row; null ids, null vectors and
    vectors with a number that is not finite take no part. skip_same leaves out the reference of the query's own id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own, kind = queries.schema["id"].dataType, refs.schema["id"].dataType
    shape = lambda t: f"ids array<{t.simpleString()}>, models array<int>, numbers int, v binary"
    v = F.col("v").cast("array<double>").alias("v")
    q = queries.where(F.col("model").isin(list(models)) & F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", F.col("model").cast("int").alias("model"), v)
    r = refs.where("id IS NOT NULL AND v IS NOT NULL").select("id", F.lit(0).alias("model"), v)
    q = materialize(q.mapInArrow(_pack(to_arrow_type(own)), shape(own)), "query-blocks")
    r = materialize(r.mapInArrow(_pack(to_arrow_type(kind)), shape(kind)), "reference-blocks")
    numbers = lambda d: d.agg(F.coalesce(F.sum(F.col("numbers").cast("long")), F.lit(0)).alias("n"), F.count("*").alias("blocks")).first()
    nq, nr = numbers(q), numbers(r)
    rows = max(1, -(-nq.n // TILE))
    columns = max(1, -(-nr.n // STREAM), min(SPREAD // rows, nr.blocks))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda c: F.lit(None).cast(c)
    tile = (F.col("_row") * columns + F.col("_column")).alias("tile")
    left = q.withColumn("_row", dealt(rows)).withColumn("_column", every(columns)).select(tile, "ids", "models", none(f"array<{kind.simpleString()}>").alias("rids"), "numbers", "v")
    right = r.withColumn("_column", dealt(columns)).withColumn("_row", every(rows)).select(tile, none(f"array<{own.simpleString()}>").alias("ids"), none("array<int>").alias("models"), F.col("ids").alias("rids"), "numbers", "v")
    tiles = left.union(right).repartitionById(rows * columns, F.col("tile")).sortWithinPartitions("tile", F.col("rids").isNotNull())
    run = _best_of_tiles(models, skip_same, to_arrow_type(own), to_arrow_type(kind))
    found = tiles.mapInArrow(_search(run), f"id {own.simpleString()}, best {kind.simpleString()}, score double")
    top = F.struct((-F.col("score")).alias("s"), "best")
    return found.groupBy("id").agg(F.min(top).alias("t")).select("id", F.col("t.best").alias("best"), (-F.col("t.s")).alias("score"))
