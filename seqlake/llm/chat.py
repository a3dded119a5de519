"""Operator 5: multi-party perspective rotation of dialogues (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import materialize, table


@dataclass(frozen=True)
class Template:
    """Turn markers; `{}`-free so that lengths can be summed in SQL."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: What a marker inside a message becomes, so that content can't forge turns.
    guard: str = "<\\|"
    guarded: str = "< |"
    #: A dialogue of more characters is rendered in blocks, so that a row fits in memory.
    block: int = 8_000_000


def number_turns(turns: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add pos, 1.. in each conv, and before_chars, the sum of `size` over the turns before, without ever holding a
    conversation in one task.

    Rows are range-partitioned by (conv, order); a row's place is its place in its partition's part of the
    conversation plus the sizes of the parts before, of which there are at most as many as partitions.
    """
    keys = [F.col("conv").asc_nulls_first(), *[F.col(c).asc_nulls_last() for c in order]]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(turns.repartitionByRange(n, *keys).withColumn("pid", F.spark_partition_id()), "chat-parts")
    sizes = parts.groupBy("conv", "pid").agg(F.count("*").alias("c"), F.sum(size).alias("s"))
    up = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("conv").alias("b_conv"), F.col("pid").alias("b_pid"), F.sum("c").over(up).alias("b_c"), F.sum("s").over(up).alias("b_s")).where("b_c > 0")
    own = Window.partitionBy("conv", "pid").orderBy(*keys[1:])
    placed = parts.withColumn("rn", F.row_number().over(own)).withColumn("rs", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size))
    placed = placed.join(before, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("pid") == F.col("b_pid")), "left")
    placed = placed.withColumn("pos", F.col("rn") + F.coalesce("b_c", F.lit(0))).withColumn("before_chars", F.col("rs") + F.coalesce("b_s", F.lit(0)))
    return placed.drop("rn", "rs", "b_c", "b_s", "b_conv", "b_pid", "pid")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", template: Template | None = None) -> DataFrame:
    """(conv, block, speaker, n_messages, n_own, rendered, mask): the dialogue from each participant's side.

    For every speaker but `system`: its messages are the assistant's, system's stay system's, others are users with
    their name. mask holds (start, end) code points of rendered, end exclusive, of the spans to train on: the
    assistant's content with its end marker, merged per message. Turns are ordered by turn, speaker, text, nulls last.
    A dialogue of more than template.block characters of text is rendered in blocks of about that many, numbered from 0,
    each with all participants' perspectives, so a very long dialogue is many rows of many tasks; blocks after the first
    begin with the dialogue's first system message, if there is one, again. Markers in texts and names are broken up,
    and line breaks in names become spaces, so neither can forge a turn.

    Null speaker is the participant "unknown"; null text is an empty message; null conv is a conversation of its own;
    repeated rows are repeated messages. Extra columns are ignored. Empty input gives no rows.
    """
    t = template or Template()
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("who"), F.coalesce(F.col(text_col), F.lit("")).alias("say"))
    base = base.withColumn("chars", F.length("say"))
    placed = number_turns(base, ["turn", "who", "say"], "chars").withColumn("block", F.floor(F.col("before_chars") / t.block))
    one = F.struct("pos", "who", F.regexp_replace("say", t.guard, t.guarded).alias("say"))
    blocks = placed.groupBy("conv", "block").agg(F.sort_array(F.collect_list(one)).alias("m"))
    first = placed.where(F.col("who") == system).groupBy(F.col("conv").alias("s_conv")).agg(F.min_by(one, "pos").alias("s"))
    blocks = blocks.join(first, F.col("conv").eqNullSafe(F.col("s_conv")), "left")
    again = (F.col("block") > 0) & (F.col("s.pos") < F.get("m", F.lit(0))["pos"])
    blocks = blocks.withColumn("m", F.when(again, F.concat(F.array("s"), F.col("m"))).otherwise(F.col("m")))
    people = base.where(F.col("who") != system).groupBy(F.col("conv").alias("p_conv")).agg(F.sort_array(F.collect_set("who")).alias("people"))
    each = blocks.join(people, F.col("conv").eqNullSafe(F.col("p_conv"))).select("conv", "block", "m", F.explode("people").alias("speaker"))
    name = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\r\n]+", " "), t.guard, t.guarded)
    own = lambda x: x["who"] == F.col("speaker")
    head: Column = lambda x: F.concat(
        F.lit(t.start), F.when(own(x), F.lit("assistant")).when(x["who"] == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), name(x["who"]))), F.lit("\n")
    )
    each = each.withColumn("part", F.transform("m", lambda x: F.struct(head(x).alias("head"), F.concat(x["say"], F.lit(t.end)).alias("body"), own(x).alias("own"))))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 1
    at = F.aggregate(
        "part",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda a, p: F.struct(
            (a["at"] + size(p)).alias("at"),
            F.when(p["own"], F.array_append(a["mask"], F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + size(p) - 1).alias("end")))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    return each.select(
        "conv", "block", "speaker", F.size("m").cast("bigint").alias("n_messages"), F.size(F.filter("part", lambda p: p["own"])).cast("bigint").alias("n_own"),
        F.array_join(F.transform("part", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"), at.alias("mask"),
    )


def op5_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    """Query: every conversation from every participant's side."""
    r = rotate(table(spark, sf_dir, "conversations"))
    return r.select(
        F.col("conv").alias("conv_id"), F.col("block").cast("int").alias("block"), "speaker", "n_messages", "n_own", F.sha2("rendered", 256).alias("rendered_sha256"),
        F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("mask"),
    )


OP5_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS say, coalesce(text, '') AS raw FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, raw) AS pos FROM t),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
r AS (SELECT n.conv_id, 0 AS block, pos, speaker, who = speaker AS own,
    '<|im_start|>' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || replace(regexp_replace(who, '[\r\n]+', ' ', 'g'), '<|', '< |') END || chr(10) AS head, say || '<|im_end|>' AS body
    FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, block, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM r)
SELECT conv_id, block, speaker, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_own, sha256(string_agg(head || body || chr(10), '' ORDER BY pos)) AS rendered_sha256,
    coalesce(string_agg(CAST(pre + length(head) AS BIGINT) || ':' || CAST(pre + length(head) + length(body) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM c GROUP BY conv_id, block, speaker"""
