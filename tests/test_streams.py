"""Stateful best and near-top hits on a stream of files: equal to the batch rule in any order and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from seqlake import streaming
from seqlake.operators import besthit

SCHEMA = "qseqid string, sseqid string, pident double, bitscore double"


@pytest.mark.parametrize("strict", [False, True])
def test_stream_equals_the_batch_rule(spark, tmp_path, strict):
    rng = random.Random(4)
    hits = [(f"q{rng.randint(0, 12)}", f"t{i}", float(rng.randint(50, 99)), float(rng.choice([100, 95, 90, 89, 60, 200, 180]))) for i in range(150)] + [(None, "t", 1.0, 1.0), ("q1", "t", 1.0, None), ("q2", "same", None, 200.0)]
    rng.shuffle(hits)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, order in enumerate((hits, hits[::-1])):
            source, out, check = (str(tmp_path / f"{n}{k}") for n in ("in", "out", "check"))
            for half in (order[:80], order[80:]):  # the second half comes after a restart
                for part in range(0, len(half), 20):
                    spark.createDataFrame(half[part : part + 20], SCHEMA).coalesce(1).write.mode("append").parquet(source)
                stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
                streaming.upsert_latest(streaming.near_top_hits(stream, 0.9, strict), out, check).awaitTermination()
            whole = spark.createDataFrame(order, SCHEMA).where("qseqid IS NOT NULL AND bitscore IS NOT NULL").fillna(0.0, ["pident"])
            best = {r.qseqid: (r.sseqid, r.bitscore) for r in besthit.best_hit(whole).collect()}
            near = {r.qseqid: sorted(r.h) for r in besthit.near_top(whole, 0.9, strict).groupBy("qseqid").agg(F.collect_list("sseqid").alias("h")).collect()}
            got = {r.qseqid: r for r in streaming.latest(spark, out).collect()}
            assert {q: (r.best, r.bitscore) for q, r in got.items()} == best and {q: sorted(r.hits) for q, r in got.items()} == near
            assert all(r.hits[0] == r.best for r in got.values())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
