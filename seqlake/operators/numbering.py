"""Consecutive numbers over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.storage import materialize


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add `out`, 1, 2, ... in the given order.

    Rows are range-partitioned and written once; each partition numbers its own rows, and the sizes of the partitions
    before it (one row for each partition) are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "numbering")
    before = parts.groupBy("_pid").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return parts.withColumn(out, own).join(F.broadcast(before), "_pid").withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_pid", "_before")
