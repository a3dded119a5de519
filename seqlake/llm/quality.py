"""Operator 1: quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import OWN, bounded_broadcast, materialize, table, words

#: Shares are counted in basis points. Each metric: name -> least distance from the upper quartile that is an outlier.
METRICS = {"symbol_bp": 500, "dup_line_bp": 5000, "repeat_bp": 2500, "upper_bp": 2500, "word_len_centi": 250}
#: An outlier lies more than FENCE interquartile ranges above the upper quartile.
FENCE = 3
#: Below this many documents a (lang, source) sketch is merged into its language's, and that into all documents'.
LEAST_DOCS = 30
#: Sketch bins: exact to 2**SUB_BITS, then 2**SUB_BITS bins for each doubling, so a quantile is within 1/2**SUB_BITS.
SUB_BITS = 6
BROADCAST_ROWS = 20_000


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Add the base counts of `text` as OWN columns: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper, n_repeat.

    All work stays within the row: the 3-word windows of a text are hashed, sorted, and equal neighbours looked up.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns(
        {
            OWN + "w": words(F.col(text)),
            OWN + "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            OWN + "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint"),
            OWN + "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("bigint"),
        }
    )
    w = F.col(OWN + "w")
    df = df.withColumns(
        {
            OWN + "n_words": F.size(w).cast("bigint"),
            OWN + "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
            OWN + "n_lines": F.size(OWN + "lines").cast("bigint"),
            OWN + "n_dup_lines": (F.size(OWN + "lines") - F.size(F.array_distinct(OWN + "lines"))).cast("bigint"),
            # windows as (hash, index), sorted: equal windows of a text become neighbours
            OWN + "win": F.sort_array(
                F.transform(
                    F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                    lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
                )
            ),
        }
    ).drop(OWN + "lines", OWN + "w")
    s = F.col(OWN + "win")
    same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    df = df.withColumn(OWN + "hit", F.sort_array(F.transform(F.filter(s, lambda x, i: same(i, i + 1) | same(i, i - 1)), lambda x: x["i"]))).drop(OWN + "win")
    h = F.col(OWN + "hit")
    # a window adds the words up to the next repeated window, three at most
    covered = F.aggregate(
        F.transform(h, lambda x, i: F.least(F.coalesce(F.get(h, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumn(OWN + "n_repeat", covered.cast("bigint")).drop(OWN + "hit")


def _bp(part: Column, whole: Column, scale: int) -> Column:
    return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(F.lit(0)).cast("bigint")


def metrics() -> dict[str, Column]:
    c = lambda x: F.col(OWN + x)
    return {
        "symbol_bp": _bp(c("n_symbols"), c("word_chars"), 10_000),
        "dup_line_bp": _bp(c("n_dup_lines"), c("n_lines"), 10_000),
        "repeat_bp": _bp(c("n_repeat"), c("n_words"), 10_000),
        "upper_bp": _bp(c("n_upper"), c("word_chars"), 10_000),
        "word_len_centi": _bp(c("word_chars"), c("n_words"), 100),
    }


def sketch_bin(v: Column) -> Column:
    """Bin of a count v >= 0: v itself below 2**SUB_BITS, then 2**SUB_BITS bins for each doubling."""
    e = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double") + 0.5)) - SUB_BITS, F.lit(0)).cast("int")
    return e.cast("bigint") * (1 << SUB_BITS) + F.call_function("shiftright", v, e)


def bin_value(b: Column) -> Column:
    """The least count of a bin."""
    n = 1 << SUB_BITS
    e = F.greatest(F.floor(b / n) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - e.cast("bigint") * n, e)


def sketches(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Mergeable quantile sketch of every metric by (lang, source): rows (lang, source, metric, bin, n).

    Two sketches merge by adding n for equal bins, so sketches of days, shards or sources can be kept and added.
    """
    long = stats.select(lang, source, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bin(F.col(m)).alias("bin")) for m in METRICS])).alias("x"))
    return long.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source) -> an upper bound for each metric, from the sketch of the group, its language or all documents."""
    merged = (
        sketch.withColumn("lv", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("k_lang", F.when(F.col("lv") < 2, F.col("lang"))).withColumn("k_source", F.when(F.col("lv") < 1, F.col("source")))
        .groupBy("lv", "k_lang", "k_source", "metric", "bin").agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("lv", "k_lang", "k_source", "metric")
    up = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = merged.withColumn("upto", F.sum("n").over(up)).withColumn("docs", F.sum("n").over(group))
    q = q.groupBy("lv", "k_lang", "k_source", "metric").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("bin"))).alias("b1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("bin"))).alias("b3"),
        F.max("docs").alias("docs"),
    )
    q1, q3 = bin_value(F.col("b1")), bin_value(F.col("b3"))
    slack = F.create_map(*[x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v))])
    q = q.select("lv", "k_lang", "k_source", "metric", "docs", (q3 + F.greatest(F.lit(FENCE) * (q3 - q1), slack[F.col("metric")])).alias("most"))
    groups = sketch.select("lang", "source").distinct()
    lv = lambda i: q.where(F.col("lv") == i).groupBy("k_lang", "k_source").agg(F.max("docs").alias(f"d{i}"), F.map_from_entries(F.collect_list(F.struct("metric", "most"))).alias(f"m{i}")).withColumnsRenamed({"k_lang": f"l{i}", "k_source": f"s{i}"})
    g = groups.join(lv(0), F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
    g = g.join(lv(1), F.col("lang").eqNullSafe(F.col("l1")), "left").join(F.broadcast(lv(2)), F.lit(True), "left")  # lv(2) is one row
    most = F.when(F.col("d0") >= LEAST_DOCS, F.col("m0")).when(F.col("d1") >= LEAST_DOCS, F.col("m1")).otherwise(F.col("m2"))
    return g.withColumn("m", most).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[F.col("m")[m].alias("most_" + m) for m in METRICS])


def judge(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Add base_failed and kept to rows that have the OWN counts and metrics, by joining each row's thresholds.

    The thresholds are broadcast only behind a check of their number; beyond it they are joined by shuffle,
    where AQE splits a hot (lang, source).
    """
    limits = bounded_broadcast(materialize(thresholds(sketches(stats, lang, source)), "quality-limits"), BROADCAST_ROWS)
    j = stats.join(limits, F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")), "left")
    failed = (F.col(OWN + "n_words") < 50) | (100 * F.col(OWN + "n_repeat") > 50 * F.col(OWN + "n_words"))
    outlier = F.lit(False)
    for m in METRICS:
        outlier = outlier | F.coalesce(F.col(m) > F.col("most_" + m), F.lit(False))
    return j.withColumn("base_failed", failed).withColumn("kept", ~failed & ~outlier)


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with the columns they came with.

    Null text counts as no words, so it fails (under 50 words). Null lang or source form groups of their own.
    Ties and repeated rows are judged alike. Empty input gives empty output. Extra columns pass through; none may
    start with `__sl_`.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(OWN + "row"), F.col(text_col).alias(OWN + "t"), F.col(lang_col).alias(OWN + "lang"), F.col(source_col).alias(OWN + "source"))
    stats = materialize(text_counts(row, OWN + "t").withColumns(metrics()).drop(OWN + "t"), "quality-rows")
    return judge(stats, OWN + "lang", OWN + "source").where("kept").select(OWN + "row.*")


def op1_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    """Query: counts and verdict for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = materialize(text_counts(docs, "text").withColumns(metrics()).drop("text"), "quality-stats")
    names = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "n_dup_lines", "n_repeat": "n_repeat_words"}
    return judge(stats, "lang", "source").select("doc_id", *[F.col(OWN + k).alias(v) for k, v in names.items()], "base_failed", "kept")


_METRIC_SQL = """
    SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS symbol_bp,
      CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_line_bp,
      CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeat_bp,
      CASE WHEN word_chars > 0 THEN n_upper * 10000 // word_chars ELSE 0 END AS upper_bp,
      CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_len_centi"""


def stats_sql(docs: str) -> str:
    """DuckDB CTEs `stats` over the relation `docs`, one row for each of its rows (told apart by rid)."""
    return f"""
d0 AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
d1 AS (SELECT rid, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d0),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j:j+2])) AS k FROM d1 WHERE len(w) >= 3),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY rid),
s AS (SELECT d1.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_upper,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d1 LEFT JOIN r USING (rid)),
stats AS ({_METRIC_SQL} FROM s)"""


def verdict_sql() -> str:
    """DuckDB CTE `verdict` over `stats`: base_failed and kept of every rid."""
    n = 1 << SUB_BITS
    e = f"greatest(CAST(floor(log2(greatest(v, 1) + 0.5)) AS BIGINT) - {SUB_BITS}, 0)"
    bv = lambda b: f"(({b} - greatest({b} // {n} - 1, 0) * {n}) << CAST(greatest({b} // {n} - 1, 0) AS INT))"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS slack, {m} AS v FROM stats" for m, v in METRICS.items())
    over = " OR ".join(f"coalesce({m} > max(CASE WHEN metric = '{m}' THEN most END), false)" for m in METRICS)
    keys = ", ".join(METRICS)
    return f"""
lg AS ({long}),
bins AS (SELECT lang, source, metric, slack, ({e}) * {n} + (v >> CAST({e} AS INT)) AS bin, count(*) AS n FROM lg GROUP BY ALL),
lv AS (SELECT lv, CASE WHEN lv < 2 THEN lang END AS kl, CASE WHEN lv < 1 THEN source END AS ks, metric, slack, bin, sum(n) AS n
    FROM bins, (VALUES (0), (1), (2)) t(lv) GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lv, kl, ks, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lv, kl, ks, metric) AS docs FROM lv),
q AS (SELECT lv, kl, ks, metric, max(slack) AS slack, max(docs) AS docs, min(CASE WHEN 4 * upto >= docs THEN bin END) AS b1, min(CASE WHEN 4 * upto >= 3 * docs THEN bin END) AS b3 FROM cum GROUP BY ALL),
lim AS (SELECT lv, kl, ks, metric, docs, {bv('b3')} + greatest({FENCE} * ({bv('b3')} - {bv('b1')}), slack) AS most FROM q),
grp AS (SELECT x.lang, x.source, a.metric, CASE WHEN a.docs >= {LEAST_DOCS} THEN a.most WHEN b.docs >= {LEAST_DOCS} THEN b.most ELSE c.most END AS most
    FROM (SELECT DISTINCT lang, source FROM stats) x JOIN lim a ON a.lv = 0 AND a.kl IS NOT DISTINCT FROM x.lang AND a.ks IS NOT DISTINCT FROM x.source
    JOIN lim b ON b.lv = 1 AND b.kl IS NOT DISTINCT FROM x.lang AND b.metric = a.metric JOIN lim c ON c.lv = 2 AND c.metric = a.metric),
verdict AS (SELECT rid, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND NOT ({over}) AS kept
    FROM stats JOIN grp ON stats.lang IS NOT DISTINCT FROM grp.lang AND stats.source IS NOT DISTINCT FROM grp.source
    GROUP BY rid, n_words, n_repeat_words, {keys})"""


OP1_SQL = f"""WITH {stats_sql('documents')}, {verdict_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM stats JOIN verdict USING (rid)"""
