"""What the training-data operators share: word rules, size-checked broadcast; scratch tables come from seqlake.storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.storage import discard, materialize, scratch_dir

__all__ = ["OWN", "SPACES", "SPACE_RUN", "bounded_broadcast", "discard", "materialize", "scratch_dir", "table", "word_count", "words"]

#: The whitespace of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Prefix of internal columns; input columns must not use it.
OWN = "__sl_"


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; empty for null or no word."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    """Number of words (bigint), 0 for null, without building them as columns."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("bigint")


def bounded_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves the side has at most max_rows rows; else leave the shuffle join."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
