"""Cached intermediates: reuse, change, crash, expiry. Pickled tables: plain ones read, hostile and damaged ones refused."""

import collections
import os
import pickle
import random
import time

import pytest

from seqlake import cache
from seqlake.sources import pickles


def test_equal_runs_read_and_changed_ones_build(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(10).write.parquet(source)
    built = []

    def run(**parameters):
        def build():
            built.append(parameters)
            return spark.read.parquet(source).selectExpr(f"id * {parameters.get('by', 1)} AS x", "CAST(NULL AS array<int>) AS n")

        return cache.cached(spark, root, "times", parameters, [source], build)

    first = run(by=2)
    assert sorted(r.x for r in first.collect()) == list(range(0, 20, 2)) and first.dtypes == [("x", "bigint"), ("n", "array<int>")]
    assert sorted(r.x for r in run(by=2).collect()) == list(range(0, 20, 2)) and len(built) == 1
    assert max(r.x for r in run(by=3).collect()) == 27 and len(built) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert max(r.x for r in run(by=2).collect()) == 22 and len(built) == 3
    assert run(by=2).count() == 12 and len(built) == 3
    assert cache.entry_key(spark, "a", {"x": 1, "y": 2}, [source]) == cache.entry_key(spark, "a", {"y": 2, "x": 1}, [source]) != cache.entry_key(spark, "b", {"x": 1, "y": 2}, [source])


def test_a_crashed_write_is_never_read(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(3).write.parquet(source)

    def crash():
        return spark.range(3).selectExpr("raise_error('broken') AS x")

    with pytest.raises(Exception, match="broken"):
        cache.cached(spark, root, "f", {}, [source], crash)
    key = cache.entry_key(spark, "f", {}, [source])
    spark.range(99).write.parquet(f"{root}/{key}/data-left")  # a table whose manifest was never written
    os.makedirs(f"{root}/{key}/manifest-started/_temporary")
    assert cache.cached(spark, root, "f", {}, [source], lambda: spark.range(4)).count() == 4


def test_old_entries_expire(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "cache")
    assert cache.expire(spark, root, 0) == 0
    spark.range(3).write.parquet(source)
    cache.cached(spark, root, "f", {}, [source], lambda: spark.range(4))
    os.makedirs(f"{root}/other")
    assert cache.expire(spark, root, 3600) == 0
    time.sleep(0.1)
    assert cache.expire(spark, root, 0) == 1 and os.listdir(root) == ["other"]
    assert cache.cached(spark, root, "f", {}, [source], lambda: spark.range(5)).count() == 5


@pytest.mark.parametrize("protocol", range(pickle.HIGHEST_PROTOCOL + 1))
def test_plain_values_come_back(protocol):
    rng = random.Random(protocol)

    def some(depth):
        if depth and rng.random() < 0.5:
            n = rng.randint(0, 5)
            return rng.choice([lambda: {rng.choice([str(rng.random()), rng.randint(-5, 5), None, (1, "a")]): some(depth - 1) for _ in range(n)}, lambda: [some(depth - 1) for _ in range(n)], lambda: tuple(some(depth - 1) for _ in range(n))])()
        return rng.choice([None, True, False, "", "é漢", "x" * 300, 0, -1, 255, 70000, 2**40, -(2**70), 1.5, float("inf")])

    for _ in range(200):
        value = some(4)
        assert pickles.plain_value(pickle.dumps(value, protocol)) == value
    shared = ["a"]
    assert pickles.plain_value(pickle.dumps({"x": shared, "y": shared}, protocol)) == {"x": ["a"], "y": ["a"]}


class Bad:
    def __reduce__(self):
        return (os.system, ("touch /tmp/seqlake-must-not-exist",))


def test_hostile_and_damaged_pickles_are_refused():
    for protocol in range(pickle.HIGHEST_PROTOCOL + 1):
        for value in (Bad(), {"a": Bad()}, collections.OrderedDict(a=1), {1, 2} if protocol > 3 else Bad(), complex(1, 2)):
            with pytest.raises(ValueError):
                pickles.plain_value(pickle.dumps(value, protocol))
    good = pickle.dumps({f"k{i}": i for i in range(50)}, 4)
    rng = random.Random(1)
    for _ in range(300):
        broken = bytearray(good[: rng.randint(0, len(good))])
        for _ in range(rng.randint(0, 3)):
            if broken:
                broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            value = pickles.plain_value(bytes(broken))
            assert isinstance(value, dict | list | tuple | str | int | float | type(None))
        except ValueError:
            pass
    assert not os.path.exists("/tmp/seqlake-must-not-exist")


def test_pickled_tables(spark, tmp_path):
    (tmp_path / "a.pkl").write_bytes(pickle.dumps({"p1": 3, "p2": None, "é": 70000}))
    (tmp_path / "b.pkl").write_bytes(pickle.dumps(["x", "y"]))
    got = {tuple(r) for r in pickles.pickled_table(spark, str(tmp_path / "*.pkl"), value="string").collect()}
    assert got == {("a.pkl", "p1", "3"), ("a.pkl", "p2", None), ("a.pkl", "é", "70000"), ("b.pkl", "0", "x"), ("b.pkl", "1", "y")}
    assert {tuple(r) for r in pickles.pickled_table(spark, str(tmp_path / "a.pkl"), value="int").select("key", "value").collect()} == {("p1", 3), ("p2", None), ("é", 70000)}
    for k, value in enumerate((Bad(), {"a": [1]}, "text")):
        (tmp_path / f"bad{k}.pickle").write_bytes(pickle.dumps(value))
        with pytest.raises(Exception, match=f"bad{k}.pickle"):
            pickles.pickled_table(spark, str(tmp_path / f"bad{k}.pickle")).collect()
