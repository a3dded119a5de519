"""Append-safe operators on file streams: the reference work is batch, so these are the batch rules row by row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seqlake.operators.models import virus_call
from seqlake.sources import records


def contigs(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """FASTA files as they arrive: (accession, length, score, proportion); a score or proportion must be joined from a batch table."""
    raw = records(spark.readStream.option("maxFilesPerTrigger", max_files), folder)
    body = F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)")
    return raw.select(F.substring_index(F.regexp_replace(F.substring_index("value", "\n", 1), "\\s", " "), " ", 1).alias("accession"), F.length(F.regexp_replace(body, "\\s", "")).cast("bigint").alias("length"))


def calls(stream: DataFrame, shares: DataFrame, min_length: int = 3000, reject: float = 0.1) -> DataFrame:
    """Virus calls of arriving contigs against a static (accession, score, proportion) table."""
    return virus_call(stream.join(shares, "accession", "left"), min_length, reject)


def annotate(stream: DataFrame, best_hits: DataFrame, names: DataFrame) -> DataFrame:
    """Arriving genes with the name of their best hit; both tables are static, one row for each gene or protein."""
    from seqlake.operators.annotation import annotate as rule

    return rule(stream, best_hits, names)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) in tumbling windows, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class _NearTop(StatefulProcessor):
    """State of one query: its hits within the share of the best so far, and the best."""

    def __init__(self, share: float, strict: bool):
        self.share, self.strict = share, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "sseqid string, pident double, bitscore double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = [tuple(r) for r in self.hits.get()] if self.hits.exists() else []
        before = set(own)
        for part in rows:
            own += list(part[["sseqid", "pident", "bitscore"]].itertuples(index=False, name=None))
        top = max(h[2] for h in own)
        kept = [h for h in own if (h[2] > top * self.share if self.strict else h[2] >= top * self.share)]
        self.hits.put([(s, float(p), float(b)) for s, p, b in kept])
        if set(kept) != before or len(kept) != len(before):
            order = sorted(kept, key=lambda h: (-h[2], -h[1], h[0]))
            yield pd.DataFrame({"qseqid": [key[0]], "best": [order[0][0]], "bitscore": [float(top)], "hits": [[h[0] for h in order]]})

    def close(self) -> None:
        pass


def near_top_hits(stream: DataFrame, share: float = 0.9, strict: bool = False) -> DataFrame:
    """Best and near-top hits of each query as hit files arrive: (qseqid, best, bitscore, hits), a row whenever they change.

    The last row of a query is what besthit.best_hit and besthit.near_top give for all hits so far, in whatever order they
    came; hits is ordered by bit score, identity and name. Only hits within the share stay in the state. The stream needs
    the RocksDB state store and output mode update; null queries and scores are left out.
    """
    rows = stream.where("qseqid IS NOT NULL AND bitscore IS NOT NULL").select("qseqid", "sseqid", F.coalesce("pident", F.lit(0.0)).cast("double").alias("pident"), F.col("bitscore").cast("double"))
    return rows.groupBy("qseqid").transformWithStateInPandas(_NearTop(share, strict), "qseqid string, best string, bitscore double, hits array<string>", "update", "none")


def upsert_latest(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every change with the batch it came in; latest() gives the last of each query. Ends when what is there is processed."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}/")

    return df.writeStream.foreachBatch(lambda b, n: put(b, n)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each query from upsert_latest(); a batch that was written twice counts once."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("qseqid").agg(F.max_by(F.struct("best", "bitscore", "hits"), "batch").alias("x")).select("qseqid", "x.*")


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append; ends when what is there is processed."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
