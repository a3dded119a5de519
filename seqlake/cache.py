"""Cached intermediates: results by what made them, never by where they lie.

An entry's key is a digest of the operator, its parameters and its input files (path, length, time of change). Its table is
written under a fresh name first; a manifest, written last, makes it an entry. A table without a manifest is never read.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.storage import delete

MANIFEST = "data string, schema string, operator string, made double"


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """For each path the number, total length and two order-free digests of its files' names, lengths and times of change.

    Files' contents are not read, and files are not listed on the driver but aggregated.
    """
    found = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
        one = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "at")).alias("x"), F.sum(F.crc32(F.concat_ws("|", "path", "length", "at").cast("binary"))).alias("y")).first()
        found.append([str(v) for v in one])
    return found


def entry_key(spark: SparkSession, operator: str, parameters: dict, inputs: Sequence[str]) -> str:
    """Digest of operator, parameters (whatever JSON can state) and inputs, each in a fixed order."""
    text = json.dumps([operator, parameters, list(inputs), fingerprint(spark, inputs)], sort_keys=True, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def _manifests(spark: SparkSession, at: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{at}/manifest-*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def cached(spark: SparkSession, root: str, operator: str, parameters: dict, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this operator, these parameters and these input files: read if an entry has it, else built and kept.

    root is a folder that all executors share. Of two writers at once each writes its own table; the earlier manifest counts
    from then on. A build that fails leaves no entry.
    """
    at = f"{root.rstrip('/')}/{entry_key(spark, operator, parameters, inputs)}"
    known = _manifests(spark, at)
    first = known.orderBy("made", "data").first() if known is not None else None
    if first is None:
        made = build()
        name = f"data-{uuid.uuid4().hex}"
        made.write.option("compression", "zstd").parquet(f"{at}/{name}")
        row = [(name, made.schema.json(), operator, time.time())]
        spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{at}/manifest-{uuid.uuid4().hex}")
        first = _manifests(spark, at).orderBy("made", "data").first()
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(json.loads(first.schema))).parquet(f"{at}/{first.data}")


def expire(spark: SparkSession, root: str, older_than: float) -> int:
    """Delete entries made more than `older_than` seconds ago; gives their number. Other folders under root are left alone.

    A table whose manifest is missing (a crashed write) goes with its key's entry, or stays if the key has none yet.
    """
    known = _manifests(spark, f"{root.rstrip('/')}/*")
    if known is None:
        return 0
    folder = F.regexp_extract(F.input_file_name(), "/([0-9a-f]{64})/manifest-", 1)
    old = known.select(folder.alias("key"), "made").groupBy("key").agg(F.max("made").alias("made")).where((F.col("made") < time.time() - older_than) & (F.col("key") != "")).collect()
    for r in old:  # one row for each entry that goes
        delete(spark, f"{root.rstrip('/')}/{r.key}")
    return len(old)
