"""Secret scans: patterns of credentials, and strings that a tokenizer's vocabulary can't shorten.

A byte-pair vocabulary was made from ordinary text, so its tokens cover several characters of a word, but hardly two of a
random string. A run of key characters that takes as many tokens as a random string would is reported, unless it is a digest
of a known length, a UUID, or an identifier put together from words and numbers.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import table

#: A file with one `base64(token) rank` in each line, readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Shortest string that the ratio is taken of, and the characters a token up to which it counts as random.
LEAST, RATIO = 20, 2.0

# The split pattern of the byte-level vocabulary, the key words and pattern of each base kind.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

KINDS = ("assign", "access", "hex", "random")
SECRETS = "array<struct<kind:string,start:int,end:int,chars_per_token:double>>"

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CHUNK = re.compile(r"[A-Za-z0-9]+")
#: Parts of a chunk: capitals, a word with or without a capital, a number.
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def identifier(s: str) -> bool:
    """Whether s is a digest of a known length, a UUID, or words and numbers in any of the usual spellings.

    Between separators, an identifier changes seldom from small letters to capitals or digits: at most once in four
    characters. A string of one kind of letters only therefore counts as a word.
    """
    if _DIGEST.fullmatch(s) or _UUID.fullmatch(s):
        return True
    return 4 * sum(len(_PART.findall(c)) - 1 for c in _CHUNK.findall(s)) <= len(s)


def scan(text: str, tokens: Callable[[str], int], least: int = LEAST, ratio: float = RATIO) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, characters a token) of one text, by start, then by kind as listed in KINDS."""
    found = [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in found)
    k, reach = 0, -1  # taken[:k] begin before the run's end; reach: the last of their ends
    for m in _RUN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        s = m[0].strip("=-/_+")
        if reach > m.start() or len(s) < least or identifier(s):
            continue
        chars = len(s) / tokens(s)
        if chars <= ratio:
            start = m.start() + m[0].index(s)
            found.append(("random", start, start + len(s), chars))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scanner(vocabulary: str, least: int, ratio: float):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("chars_per_token", pa.float64())]))
        for b in batches:
            found = [scan(t or "", lambda s: len(encoding.encode_ordinary(s)), least, ratio) for t in b.column("text").to_pylist()]
            rows = [[dict(zip(("kind", "start", "end", "chars_per_token"), x, strict=True)) for x in own] for own in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, "secrets"])

    return scanned


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """The documents with a column `secrets`: an array of (kind, start, end, chars_per_token), by start, then kind.

    Positions are code points of the whole text, the end exclusive. Kinds `assign`, `access` and `hex` are patterns; `random`
    strings have at least `least` characters and at most `ratio` characters a token, and overlap no other span. Nothing is
    shuffled: each text is scanned in the task that reads it. A null or empty text has an empty array. A column named
    `secrets` is replaced; other columns, repeated ids and repeated rows stay as they are.
    """
    kept = docs.drop("secrets")
    schema = T.StructType([*kept.schema.fields, T.StructField("secrets", T.DataType.fromDDL(SECRETS))])
    return kept.mapInArrow(_scanner(vocabulary, least, ratio), schema)


def redact_secrets(docs: DataFrame, **options) -> DataFrame:
    """The documents with every secret replaced by `[SECRET]`; overlapping spans become one."""
    text = F.expr(
        "aggregate(secrets, struct('' AS made, 0 AS at), (acc, x) -> CASE WHEN x.start >= acc.at THEN struct(concat(acc.made, substring(text, acc.at + 1, x.start - acc.at), '[SECRET]') AS made, x.end AS at) "
        "ELSE struct(acc.made AS made, greatest(acc.at, x.end) AS at) END, acc -> concat(acc.made, substring(text, acc.at + 1)))"
    )
    return find_secrets(docs, **options).withColumn("text", text).select(*(c for c in docs.columns if c != "secrets"))


def op12_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = listed(F.filter("secrets", lambda x: x["kind"] != "random"))
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
