"""Operator 8: near-duplicate groups by SetSketch registers, banding, joint likelihood and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import OWN, bounded_broadcast, discard, materialize, table
from seqlake.llm.wordhash import Words, mix, slices
from seqlake.operators.graph import components as connected_components

#: SetSketch parameters: register k holds 1 - log_b of the least exponential variate, cut to 0..LIMIT.
B = 1.001
RATE = 20.0
LIMIT = 65_534
#: 25 bands of 5 registers: a pair at similarity 0.85 is missed with probability (1 - 0.85**5)**25 = 4e-7.
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Registers of the likelihood test, apart from those of the bands; only texts that share a bucket get them.
FINE = 512
#: A candidate goes on unless the threshold is this many nats less likely than the best similarity (about 5 sigma).
NATS = 12.5
#: A shingle is rare if at most so many of the texts in open buckets hold it.
RARE = 8
#: Row keys of 8 bytes are broadcast up to this number (32 MB of hash table); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words; a shorter text is one shingle; no word, none."""

    def chained(h: np.ndarray, n: int, k: int) -> np.ndarray:
        acc = np.full(n, np.uint64(k), dtype=np.uint64)
        for c in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[c : c + n])
        return acc

    every = chained(w.hash, max(0, len(w.hash) - size + 1), size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        s = np.sort(every[a : b - size + 1]) if b - a >= size else chained(w.hash[a:b], min(1, b - a), b - a)
        if len(s) > 1:
            new = np.empty(len(s), dtype=bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        out.append(s)
    return out


def least(sets: list[np.ndarray], m: int = M, seed: int = 1) -> np.ndarray:
    """For each set (none empty) the least of its elements' exponential variates in each of m registers.

    An element's variates come in ascending order, as a Poisson process of its own hash: each point falls into a random
    register, so the first point in a register is exponential and the registers are independent. Only points up to a
    limit that fills all registers are made, about m * (ln m + 3) for a set of any size; a set with a register left
    empty goes again with twice the limit. Minima of two sets merge by np.minimum.
    """
    n = np.array([len(s) for s in sets])
    best = np.full(len(sets) * m, np.inf)
    limit = m * (math.log(m) + 3) / n
    rows = np.arange(len(sets))
    while len(rows):
        h = np.concatenate([sets[r] for r in rows]) ^ mix(np.array([seed], dtype=np.uint64))
        base, end, x = np.repeat(rows * m, n[rows]), np.repeat(limit[rows], n[rows]), np.zeros(int(n[rows].sum()))
        step = 0
        while len(h):
            step += 1
            z = mix(h + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            # 40 bits give the gap to the next point, the other 24 its register
            x = x - np.log(((z >> np.uint64(24)).astype(np.float64) + 0.5) / float(1 << 40))
            on = x <= end
            if not on.all():
                h, base, end, x, z = h[on], base[on], end[on], x[on], z[on]
            np.minimum.at(best, base + ((z & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64), x)
        rows = rows[np.isinf(best.reshape(-1, m)[rows]).any(1)]
        limit[rows] *= 2
    return best.reshape(-1, m) / m


def registers(minima: np.ndarray) -> np.ndarray:
    """SetSketch registers of least exponential variates."""
    k = np.floor(1 - np.log(np.maximum(minima / RATE, 1e-300)) / math.log(B))
    return np.clip(k, 0, LIMIT).astype("<u2")


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(2), lower=True):
                sets = shingle_sets(w, size)
                full = [s for s in sets if len(s)]
                g = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(full), axis=0)
                if full:
                    k = registers(least(full)).reshape(-1, BANDS, ROWS)
                    for c in range(ROWS):
                        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + k[:, :, c].astype(np.uint64) + np.uint64(1))
                # two independent sums over the set: equal for equal sets, whatever the order
                lo = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=np.uint64)
                hi = np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], dtype=np.uint64)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32))
                bands = pa.ListArray.from_arrays(ends, pa.array(g.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), bands],
                    names=["id", "key", "n", "lo", "hi", "bands"],
                )

    return run


def _fine(size: int):
    """(no, text) -> (no, n, regs, text): registers for the likelihood test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(1), lower=True):
                sets = shingle_sets(w, size)
                regs = registers(least(sets, FINE, 2))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), b.column(1).slice(i, j - i)],
                    names=["no", "n", "regs", "text"],
                )

    return run


def _each_shingle(size: int):
    """(no, comp, text) -> (h, no, comp), a row for each shingle of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(2), lower=True):
                sets = shingle_sets(w, size)
                row = pa.array(np.repeat(np.arange(i, j), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), b.column(0).take(row), b.column(1).take(row)], names=["h", "no", "comp"])

    return run


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Joint estimation: of pairs of register rows, those whose likeliest similarity is at least `threshold`, or not
    clearly below it by the counts of <, =, >.

    With known set sizes, u = na/(na+nb) and v = nb/(na+nb), a register of A exceeds B's with probability
    p(u - v*J), p(x) = -log_b(1 - x*(b-1)/b). The log-likelihood of J is concave; a grid finds its maximum.
    """
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)

    def score(j):
        a, b = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        safe = lambda c, q: np.where(c[:, None] > 0, c[:, None] * np.log(np.maximum(q, 1e-12)), 0)
        return safe(more, a) + safe(less, b) + safe(ra.shape[1] - more - less, 1 - a - b)

    at = np.minimum(threshold, top)[:, None]
    every = score(grid)
    best = np.take_along_axis(grid, every.argmax(1)[:, None], 1)[:, 0]
    return (top >= threshold - 1e-9) & ((best >= threshold) | (score(at)[:, 0] >= every.max(1) - NATS))


def _screen(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            ok = np.empty(b.num_rows, dtype=bool)
            for i in range(0, b.num_rows, 2000):
                read = lambda x: np.frombuffer(b"".join(x.slice(i, 2000).to_pylist()), dtype="<u2").reshape(-1, FINE)  # noqa: B023, E731
                num = lambda x: x.slice(i, 2000).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                ok[i : i + 2000] = likely(read(c["ra"]), read(c["rb"]), num(c["na"]), num(c["nb"]), threshold)
            yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(ok)), c["b"].filter(pa.array(ok))], names=["a", "b"])

    return run


def _verify(percent: int, size: int):
    """Exact: 100 * |A and B| >= percent * |A or B| on full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = object(), np.zeros(0, np.uint64)
        for b in batches:
            a_id, b_id, ta, tb = (b.column(b.schema.get_field_index(x)) for x in ("a", "b", "ta", "tb"))
            good = []
            for i, j, w in slices(tb, True):
                for r, other in zip(range(i, j), shingle_sets(w, size), strict=True):
                    if (x := a_id[r].as_py()) != last:  # rows come sorted by a, so a hub's set is made once
                        last, kept = x, next(shingle_sets(v, size) for _, _, v in slices(ta.slice(r, 1), True))[0]
                    both = len(np.intersect1d(kept, other, assume_unique=True))
                    good.append(100 * both >= percent * (len(kept) + len(other) - both) and both > 0)
            m = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_id.filter(m), b_id.filter(m)], names=["a", "b"])

    return run


def _row_key(docs: DataFrame) -> Column:
    """Hash of a whole row (but its maps, which have none): what tells rows of one id apart."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith("map")])


def groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, key, n, best) for each row of docs: key the hash of the row, n the size of its set, best the (last, id, key)
    that stands for its group (null if it has no word). See near_duplicates().
    """
    src = docs.select(F.col(id_col).alias("id"), _row_key(docs).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    sk = materialize(src.mapInArrow(_sketch(shingle), f"id {kind}, key bigint, n bigint, lo bigint, hi bigint, bands array<bigint>"), "near-sketch")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("best")
    classes = sk.where("n > 0").groupBy("lo", "hi").agg(first)
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "near-classes")
    rep = classes.select("lo", "hi", F.col("best.id").alias("rep_id"), F.col("best.key").alias("key"), "no")
    reps = sk.join(rep, ["lo", "hi", "key"]).where(F.col("id").eqNullSafe(F.col("rep_id")))
    buckets = reps.select("no", "n", F.explode("bands").alias("band"))
    # a bucket of one class has no pair; partial sums tell
    shared = buckets.groupBy("band").agg(F.min("no").alias("x"), F.max("no").alias("y"), F.count("*").alias("size")).where("x < y").select("band", "size")
    # how many classes a class meets over its buckets: largest for the text that the others are edits of
    met = F.sum("size").over(Window.partitionBy("no"))
    placed = materialize(buckets.join(shared, "band").withColumn("met", met).drop("size"), "near-buckets")
    texts = _texts(src, rep, placed, shingle)
    comp = _components(placed, reps, texts, percent, shingle)
    discard(placed, texts)

    of = classes.join(comp, classes["no"] == comp["node"], "left").select("lo", "hi", "best", F.coalesce("component", "no").alias("component"))
    of = materialize(of, "near-components")
    best = of.groupBy("component").agg(F.min("best").alias("best"))
    whole = of.drop("best").join(best, "component").select(F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), "best")
    return sk.select("id", "key", "n", "lo", "hi").join(whole, (F.col("n") > 0) & (F.col("lo") == F.col("c_lo")) & (F.col("hi") == F.col("c_hi")), "left").select("id", "key", "n", "best")


def _texts(src: DataFrame, rep: DataFrame, placed: DataFrame, shingle: int) -> DataFrame:
    """(no, n, regs, text) of one row of each class that shares a bucket."""
    need = rep.join(placed.select("no").distinct(), "no").select(F.col("rep_id"), F.col("key").alias("rep_key"), "no")
    need = bounded_broadcast(need, BROADCAST_KEYS)
    own = src.join(need, (F.col("key") == F.col("rep_key")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("no", "text")
    t = materialize(own.mapInArrow(_fine(shingle), "no bigint, n bigint, regs binary, text string"), "near-texts")
    # rows alike in everything stand for one class together: one of them is enough
    twice = t.groupBy("no").agg(F.count("*").alias("c")).where("c > 1").select("no")
    if twice.isEmpty():
        return t
    one = t.join(twice, "no", "left_anti").unionByName(t.join(twice, "no", "left_semi").dropDuplicates(["no"]))
    out = materialize(one, "near-texts")
    discard(t)
    return out


def _components(placed: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(node, component) of classes with a link. placed: (band, no, n, met); reps: (no, bands); texts: (no, n, regs, text)."""
    leader = placed.groupBy("band").agg(F.max_by(F.struct("no", "n"), F.struct("met", F.xxhash64("no"), "no")).alias("leader"))
    l, n = F.col("leader"), F.col("n")
    pairs = placed.join(leader, "band").where((F.col("no") != l["no"]) & (100 * F.least(n, l["n"]) >= percent * F.greatest(n, l["n"])))
    links = [_links(pairs.select(F.least(l["no"], F.col("no")).alias("a"), F.greatest(l["no"], F.col("no")).alias("b")).distinct(), texts, percent, shingle)]
    comp = connected_components(links[0])

    # classes of buckets that hold several components: shingles they share with few others, and with more
    label = lambda x: x.join(comp, x["no"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "no")).drop("node", "component")
    now = label(placed)
    some = now.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("lo")).where("x < y").select("band", "lo")
    pool = materialize(now.join(some, "band").join(leader.select("band", l["no"].alias("leader")), "band"), "near-open")
    open_ = pool.select("no", "n", "comp").distinct()
    held = open_.join(texts.select("no", "text"), "no").select("no", "comp", "text").mapInArrow(_each_shingle(shingle), "h bigint, no bigint, comp bigint")
    held = materialize(held, "near-shingles")
    often = held.join(held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h")
    # core: how many of a class's shingles are not rare
    core = open_.select("no", "n").join(often.where(F.col("c") > RARE).groupBy("no").agg(F.count("*").alias("core")), "no", "left")
    core = materialize(core.select("no", "n", F.coalesce("core", F.lit(0)).alias("core")), "near-core")
    lists = often.where(F.col("c") <= RARE).groupBy("h").agg(F.collect_list(F.struct("no", "comp")).alias("l"))
    both = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: (x["no"] < y["no"]) & (x["comp"] != y["comp"])), lambda y: F.struct(x["no"].alias("a"), y["no"].alias("b")))))
    rare = lists.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("r"))
    side = lambda x: core.toDF(x, "n" + x, "core" + x)
    rare = rare.join(side("a"), "a").join(side("b"), "b").where(_may(percent, F.least("corea", "coreb") + F.col("r"), F.col("na"), F.col("nb")))
    found = _links(rare.select("a", "b"), texts, percent, shingle)
    discard(held)
    if not found.isEmpty():
        links.append(found)
        discard(comp)
        comp = connected_components(_union(links))

    # pairs without a rare shingle share at most their cores: what passes that bound is compared bucket by bucket
    m, n, lo = F.col("core"), F.col("n"), F.col("lo")
    fits = F.when(m <= lo, 100 * m >= percent * (n + lo - m)).otherwise(100 * m >= percent * n)
    old = pool
    pool = pool.drop("comp").join(core.select("no", "core"), "no").where(fits)
    pool = materialize(pool.join(reps.select("no", "bands").dropDuplicates(["no"]), "no"), "near-pool")
    discard(old, core)
    # one that has led in a bucket has been compared with all of it, and leaves it
    rest = pool.where("no <> leader")
    turn = 16
    while True:
        now = label(rest)
        per = now.groupBy("band", "comp").agg(F.count("*").alias("k"))
        main = per.groupBy("band").agg(F.max_by("comp", F.struct("k", F.hash("comp"))).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
        lead = materialize(_some(now.join(main, "band").where("comp <> main"), turn), "near-lead")
        if lead.isEmpty():
            break
        cols = ("no", "n", "core", "comp", "bands")
        x, y = (t.select("band", F.struct(*cols).alias(c)) for t, c in ((lead, "x"), (now, "y")))
        cx, cy = F.col("x"), F.col("y")
        common = F.array_position(F.zip_with(cx["bands"], cy["bands"], lambda a, b: a == b), True)
        at = F.array_position(cx["bands"], F.col("band"))
        # the size test first, then a pair only in the first bucket that both are in
        pairs = x.join(y, "band").where((cx["comp"] != cy["comp"]) & _may(percent, F.least(cx["core"], cy["core"]), cx["n"], cy["n"]) & (common == at))
        found = _links(pairs.select(F.least("x.no", "y.no").alias("a"), F.greatest("x.no", "y.no").alias("b")).distinct(), texts, percent, shingle)
        old = rest
        rest = materialize(old.join(lead.select("band", "no"), ["band", "no"], "left_anti"), "near-rest")
        discard(old, lead)
        if not found.isEmpty():
            links.append(found)
            discard(comp)
            comp = connected_components(_union(links))
        turn *= 16
    discard(pool, rest, lead, *links)
    return comp


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _may(percent: int, shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b that share at most `shared` elements can reach the threshold."""
    return 100 * shared >= percent * (a + b - shared)


def _some(outside: DataFrame, turn: int) -> DataFrame:
    """About `turn` outsiders of each bucket, by hash, and always the one that meets most: found by sums, without a window."""
    h = F.pmod(F.xxhash64("no"), F.lit(1 << 20))
    n = outside.groupBy("band").agg(F.count("*").alias("left"), F.max_by("no", F.struct("met", F.xxhash64("no"), "no")).alias("first"))
    return outside.join(n, "band").where((F.col("no") == F.col("first")) | (h * F.col("left") < (turn - 1) * (1 << 20))).drop("left", "first", "main")


def _links(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) that are linked: likelihood test on registers, then exact sets of whole texts."""
    side = lambda x: texts.select(F.col("no").alias(x), F.col("regs").alias("r" + x), F.col("n").alias("n" + x))
    likely_ = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_screen(percent / 100), "a bigint, b bigint")
    both = likely_.join(texts.select(F.col("no").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("no").alias("a"), F.col("text").alias("ta")), "a")
    return materialize(both.sortWithinPartitions("a").select("a", "b", "ta", "tb").mapInArrow(_verify(percent, shingle), "a bigint, b bigint"), "near-found")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; two documents are linked when the Jaccard similarity of their
    sets of `shingle`-word shingles is at least percent/100; component_id is the least id that links reach.

    1. One pass makes set size, a 128-bit key of the set and band keys. Equal sets collapse to a class, so copies never
       meet in pairs; only classes that share a bucket get the registers of the likelihood test.
    2. Every bucket (band key) compares each class with one leader, the class that meets most others over all its
       buckets (of a text and its edits, the text): linear in the bucket.
    3. Pairs of possible sizes pass the joint likelihood test, then are verified on full sets; components of the links follow.
    4. In buckets that still hold several components, shingles are counted. Pairs that share a rare one are found under
       it, at most RARE * (RARE - 1) / 2 for each. All others share at most the part of their sets that is not rare;
       if that can't reach the threshold they are no link, which settles edits of one text that are too far from it.
    5. What is left leads in its buckets in turn, more each round, against members of other components, each pair in the
       first bucket that holds both. A bucket is done when all classes outside its largest component have led or
       joined, so every candidate pair that could still merge two components is compared: no cap, no all-pairs.

    Null text or text without words: n_shingles 0, alone. A null id comes after every other: it names a group only if no
    other id is in it. Rows that repeat an id are documents of their own. Extra columns are ignored. Empty input: no rows.
    """
    g = groups(docs.select(id_col, text_col), id_col, text_col, shingle, percent)
    return g.select("id", F.col("n").alias("n_shingles"), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group, same columns: that of the least id, a null id last, then of the
    least row hash; of rows alike in all columns one stays. Rows without a word are in no group and all stay.
    """
    g = groups(docs, id_col, text_col, shingle, percent)
    best = F.col("best")
    stays = best.isNull() | (F.col("id").eqNullSafe(best["id"]) & (F.col("key") == best["key"]))
    g = materialize(g.select("id", "key", "n", stays.alias("stays")), "near-stays")
    gone = materialize(g.where("not stays").select(F.col("key").alias(OWN + "gone"), F.col("id").alias(OWN + "id")).distinct(), "near-gone")
    twice = materialize(g.where("stays and n > 0").groupBy("id", "key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias(OWN + "gone"), F.col("id").alias(OWN + "id")), "near-twice")
    rows = docs.withColumn(OWN + "key", _row_key(docs))
    on = (F.col(OWN + "key") == F.col(OWN + "gone")) & F.col(id_col).eqNullSafe(F.col(OWN + "id"))
    out = rows.join(bounded_broadcast(gone, BROADCAST_KEYS), on, "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, on, "left_anti").unionByName(out.join(twice, on, "left_semi").dropDuplicates([OWN + "key", id_col]))
    return out.drop(OWN + "key")


def op8_setsketch(spark, sf_dir: str) -> DataFrame:
    """Query: components at 3-word shingles and similarity 0.85."""
    g = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85)
    return g.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
