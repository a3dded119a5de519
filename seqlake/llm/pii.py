"""Operator 10: personal data by pattern, and terms that disclose it by corpus co-occurrence (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import OWN, bounded_broadcast, discard, materialize, table

#: kind -> pattern. They match what `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+` and the like match, leftmost
#: and non-overlapping, but never backtrack: possessive runs, and a start inside a run only where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind that counts, so it is not split.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}{3,}"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: A term discloses an entity value when knowing the term leaves at most this many bits of the value's information.
LEFT_BITS = 1.0
#: ... as seen in at least so many distinct texts, so that copies of one text are no evidence.
LEAST_TEXTS = 3
#: A token with a digit or @ holds entities and no terms.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: At most so many terms, or rows of texts with such terms, are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 50_000


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        two = 2 * d
        return a + F.when(i % 2 == 0, F.when(two > 9, two - 9).otherwise(two)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(v, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.when(F.length(part(x)).between(1, 3), part(x)).otherwise(F.lit("0")).cast("int") <= 255))
    if kind == "card":
        digits = F.regexp_replace(v, r"[\x20-]", "")
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(v, r"[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column]) -> Column:
    """Matches of pattern in text that `keep` accepts, with code-point positions: pieces between matches and matches alternate.

    The running state is copied at every match, so it holds only what is kept.
    """
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.array().cast(SPAN)
    span = lambda at, v: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"))
    # the last piece has no match after it
    return F.aggregate(
        F.filter(steps, lambda x: x["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(keep(x["hit"]), F.array_append(a["out"], span(a["at"] + F.length(x["gap"]), x["hit"]))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind in order; an empty array for null. Matches that fail are dropped, without a retry."""
    found = _located(text, PATTERNS[kind], kind, lambda v: _valid(kind, v))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPAN))


def _terms(t: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(t, TOKEN, " "), F.lit(TERM), F.lit(0)), F.lower))


def _entities(base: Column) -> Column:
    """Distinct protected entities of base spans: each value, and the group it belongs to (an e-mail's domain, the first
    three parts of an ip, the first six digits of a card, a phone number without its last four digits)."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    group = lambda k, v: (
        F.when(k == "email", F.concat(F.lit("domain:"), F.lower(F.substring_index(v, "@", -1))))
        .when(k == "ip", F.concat(F.lit("net:"), F.substring_index(v, ".", 3)))
        .when(k == "card", F.concat(F.lit("bin:"), F.substring(digits(v), 1, 6)))
        .otherwise(F.concat(F.lit("line:"), F.substring(digits(v), F.lit(1), F.length(digits(v)) - 4)))
    )
    return F.array_distinct(F.flatten(F.transform(base, lambda x: F.array(F.concat_ws(":", x["kind"], x["value"]), group(x["kind"], x["value"])))))


def co_occurrences(found: DataFrame) -> DataFrame:
    """(term, with_value): the most documents in which the term meets one protected entity, for terms that may disclose it.

    Counted over whole texts with an entity. An entity or pair in fewer than LEAST_TEXTS distinct texts is no evidence.
    A term that stands in more than 2**LEFT_BITS times as many of these documents as it shares with any entity
    can't disclose: its documents in all are no fewer.
    """
    t = F.col(OWN + "t")
    own = found.where(F.size(OWN + "base") > 0).select(F.xxhash64(t).alias("doc"), _entities(F.col(OWN + "base")).alias("values"), _terms(t).alias("terms"))
    own = materialize(own, "pii-bearing")
    # one row for each distinct text, with the number of documents that have it
    copies = own.groupBy("doc").agg(F.count("*").alias("copies"))
    own2 = materialize(own.dropDuplicates(["doc"]).join(copies, "doc"), "pii-texts")
    discard(own)
    values = own2.select("doc", F.explode("values").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS).select("value")
    per = values.join(often, "value").groupBy("doc").agg(F.collect_list("value").alias("often"))
    pair = own2.join(per, "doc").select("copies", "terms", F.explode("often").alias("value")).select("copies", "value", F.explode("terms").alias("term"))
    pair = pair.groupBy("value", "term").agg(F.sum("copies").alias("docs"), F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    pair = pair.groupBy("term").agg(F.max("docs").alias("with_value"))
    bearing = own2.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("docs"))
    out = pair.join(bearing, "term").where(F.col("docs") <= 2.0**LEFT_BITS * F.col("with_value")).select("term", "with_value")
    out = materialize(out, "pii-pairs")
    discard(own2)
    return out


def disclosing_terms(found: DataFrame) -> DataFrame:
    """(term, docs, with_value, bits): terms whose presence reveals a protected entity.

    With D(x) the documents that hold x: PMI(term; entity) = log2(D(term, entity) * D / (D(term) * D(entity))), and the
    entity's information is log2(D / D(entity)). What the term leaves is their difference, log2(D(term) / D(term, entity)),
    never below 0. A term discloses if that is at most LEFT_BITS and the pair stands in LEAST_TEXTS distinct texts. Both
    counts are of whole texts, over all documents.
    """
    pair = co_occurrences(found)
    if pair.isEmpty():
        return pair.select("term", F.lit(0).cast("bigint").alias("docs"), "with_value", F.lit(0.0).alias("bits"))
    # a plain word count, summed in each task before the shuffle
    docs = found.select(F.explode(_terms(F.col(OWN + "t"))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    docs = docs.join(bounded_broadcast(pair, BROADCAST_TERMS), "term").where(F.col("docs") <= 2.0**LEFT_BITS * F.col("with_value"))
    return materialize(docs.select("term", "docs", "with_value", F.log2(F.col("docs") / F.col("with_value")).alias("bits")), "pii-terms")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base (array of base spans by kind, then start), and terms (spans of disclosing terms) to every row.

    Spans are (kind, start, end, value), code points, end exclusive. Null text is empty. Term spans that overlap a base
    span are left out. Rows are judged alone but for the corpus counts, in which equal texts count once. Empty input
    gives no rows. Columns of docs named base or terms are replaced; none may start with `__sl_`.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.drop("base", "terms").withColumn(OWN + "t", t)
    d = d.withColumn(OWN + "base", F.concat(*[base_spans(F.col(OWN + "t"), k) for k in KINDS]))
    terms = disclosing_terms(d.select(OWN + "t", OWN + "base"))
    if terms.isEmpty():
        return d.withColumn("base", F.col(OWN + "base")).withColumn("terms", F.array().cast(SPAN)).drop(OWN + "t", OWN + "base")
    # the texts that hold one, by their hash; rows without any need no join of texts if these are few
    hits = d.select(F.xxhash64(OWN + "t").alias(OWN + "doc"), F.explode(_terms(F.col(OWN + "t"))).alias("term"))
    hits = hits.join(bounded_broadcast(terms.select("term"), BROADCAST_TERMS), "term").groupBy(OWN + "doc").agg(F.collect_set("term").alias(OWN + "own"))
    hits = bounded_broadcast(materialize(hits, "pii-hits"), BROADCAST_TERMS)
    d = d.join(hits, F.xxhash64(OWN + "t") == F.col(OWN + "doc"), "left")
    base = F.col(OWN + "base")
    own = _located(F.col(OWN + "t"), TERM, "term", lambda v: F.array_contains(F.col(OWN + "own"), F.lower(v)))
    spans = F.filter(own, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    d = d.withColumn("base", base).withColumn("terms", F.when(F.col(OWN + "own").isNotNull(), spans).otherwise(F.array().cast(SPAN)))
    return d.drop(OWN + "t", OWN + "base", OWN + "doc", OWN + "own")


def sanitise(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with base spans replaced by [EMAIL], [IP], [CARD], [PHONE] and disclosing terms by [TERM], same columns.

    Overlapping spans become one label, that of the span that starts first (the longer on a tie). Null text stays null.
    """
    d = find_pii(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(OWN + "row"), F.col(text_col).alias(OWN + "text")), OWN + "text")
    t = F.col(OWN + "text")
    order = F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    new = F.aggregate(
        order,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda a, x: F.struct(
            F.when(x["start"] < a["at"], a["s"]).otherwise(F.concat(a["s"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("s"),
            F.greatest(a["at"], x["end"]).alias("at"),
        ),
        lambda a: F.concat(a["s"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    d = d.withColumn(OWN + "new", F.when(F.size("base") + F.size("terms") > 0, new).otherwise(t))
    cols = []
    for c in docs.columns:
        v = F.col(OWN + "new") if c == text_col else F.col(f"{OWN}row.`{c}`")
        if c == chars_col:
            v = F.when(F.col(OWN + "row")[c].isNotNull() & F.col(OWN + "new").isNotNull(), F.length(OWN + "new")).otherwise(F.col(OWN + "row")[c]).cast(docs.schema[c].dataType)
        cols.append(v.alias(c))
    return d.select(*cols)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_disclosure(spark, sf_dir: str) -> DataFrame:
    """Query: spans of personal data and of disclosing terms in each document."""
    d = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias("n_" + k)
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"))
