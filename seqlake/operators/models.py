"""Contig sentences, virus and lifestyle calls. Models are plugged in as score columns or batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqlake.functions import argmax, genome_of, orf_index, sigmoid, softmax
from seqlake.operators.besthit import first_per_key, near_top


def sentences(hits: DataFrame, vocabulary: DataFrame, length: int = 300, lexicographic: bool = False, share: float = 0.9) -> DataFrame:
    """(accession, tokens): each ORF's best tokenisable near-top hit, in ORF order, padded with 0 to `length`.

    vocabulary: (protein, token) with tokens from 0; 1 is added so that 0 can pad. `lexicographic` orders ORF
    numbers as text.
    """
    h = near_top(hits, share, strict=True).join(vocabulary, F.col("sseqid") == F.col("protein"))
    one = first_per_key(h, ["qseqid"], [F.col("bitscore").desc(), F.col("pident").desc(), F.col("sseqid")])
    idx = orf_index(F.col("qseqid"))
    key = idx if lexicographic else F.expr("try_cast(substring_index(qseqid, '_', -1) as bigint)")
    g = one.groupBy(genome_of(F.col("qseqid")).alias("accession")).agg(F.sort_array(F.collect_list(F.struct(key.alias("i"), (F.col("token") + 1).cast("int").alias("t")))).alias("x"))
    tokens = F.slice("x.t", 1, length)
    return g.select("accession", F.concat(tokens, F.array_repeat(F.lit(0), (F.lit(length) - F.size(tokens)).cast("int"))).alias("tokens"))


def sentence_text(tokens: Column, length: int = 298) -> Column:
    """Tokens up to the first pad, at most `length`, joined by spaces."""
    return F.array_join(F.slice(F.filter(tokens, lambda x: x != 0), 1, length).cast("array<string>"), " ")


def mapped_share(orfs: DataFrame, hits: DataFrame) -> DataFrame:
    """(accession, proportion) of a contig's ORFs that have a hit."""
    hit = hits.select(F.col("qseqid").alias("orf_id")).distinct().withColumn("hit", F.lit(1))
    j = orfs.select("orf_id").distinct().join(hit, "orf_id", "left")
    return j.groupBy(genome_of(F.col("orf_id")).alias("accession")).agg((F.count("hit") / F.count("*")).alias("proportion"))


#: What the confidence column says.
REJECTED, LOW_SHARE = "rejected", "lower than reject threshold"
LOW_SCORE = "lower than viral score threshold; proteinal prophage, please run contamination detection task"
HIGH, MEDIUM, LOW = "high-confidence", "medium-confidence", "low-confidence; please run contamination detection task"


def virus_call(df: DataFrame, min_length: int = 3000, reject: float = 0.1) -> DataFrame:
    """Add pred, call_score and confidence to (length, score or null, proportion or null).

    Scored contigs are viral at score >= 0.5 and proportion >= reject, whatever their length; the mean of both grades the
    confidence, and a proportion below reject is named before a low score. Contigs without a score that are too short
    are only named so; others go by their proportion alone, and score 0 if that is below reject.
    """
    s, p = F.col("score"), F.coalesce("proportion", F.lit(0.0))
    scored, low = s.isNotNull(), p < reject
    short = ~scored & (F.col("length") < min_length)
    pred = F.when(short, "filtered by length").when(low | F.coalesce(s < 0.5, F.lit(False)), "non-virus").otherwise("virus")
    out = F.when(short, F.lit(0.0)).when(scored & (s < 0.5), s).when(scored, F.when(low, p).otherwise(s)).when(low, F.lit(0.0)).otherwise(p)
    grade = lambda x, hi, mid: F.when(x > hi, HIGH).when(x > mid, MEDIUM).otherwise(LOW)
    conf = F.when(short, REJECTED).when(low, LOW_SHARE).when(s < 0.5, LOW_SCORE).when(scored, grade((p + s) / 2, 0.8, 0.6)).otherwise(grade(p, 0.75, 0.25))
    return df.withColumn("pred", pred).withColumn("call_score", out).withColumn("confidence", conf)


def lifestyle(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add type (temperate or virulent) and type_score from two-class logits; null logits give null, not a guess."""
    p = softmax(F.col(logits))
    return df.withColumn("type", F.when(argmax(p) == 1, "temperate").when(p.isNotNull(), "virulent")).withColumn("type_score", F.array_max(p))


def infer(df: DataFrame, tokens: str, make_predict: Callable, batch_size: int = 500, length: int = 300) -> DataFrame:
    """Add score: the sigmoid of a model's output, batched. make_predict loads the model once for each worker.

    make_predict returns predict(array of rows of `length` tokens) -> array of numbers; transformer.score_sentences has one.
    """
    from pyspark.ml.functions import predict_batch_udf

    raw = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[length]])
    return df.withColumn("_raw", raw(F.col(tokens).cast("array<double>"))).withColumn("score", sigmoid(F.col("_raw"))).drop("_raw")
