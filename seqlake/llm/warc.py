"""Operator 2: WARC archives of Zstandard frames: dictionary in a leading skippable frame, one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import materialize, scratch_dir, table

#: Archives are read in at most so many tasks.
READ_TASKS = 20_000
#: Fixed values of the .warc.zst format: the dictionary's skippable frame, and a frame's magic.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed at so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on at most so many payloads, each cut to SAMPLE_BYTES (it affects size alone, never results).
DICT_SAMPLES, SAMPLE_BYTES, DICT_BYTES = 400, 16_384, 65_536
#: Records are read in pieces of so many bytes, and rows go out in batches of so many payload bytes.
PIECE, OUT_BYTES = 1 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    block = _HTTP + (b"" if refers_to is not None else payload)
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "about:blank").split()) or "about:blank"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, type and payload facts of one record; `error` names the first rule it breaks."""
    out: dict = {"record_type": None, "page_id": None, "refers_to": None, "url": None, "payload": None, "payload_digest": None, "error": None}
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        return out | {"error": "no WARC version line and header"}
    h = {}
    for x in lines[1:]:
        k, colon, v = x.partition(b":")
        if not colon:
            return out | {"error": "header line without a colon"}
        h[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            return out | {"error": f"no {need}"}
    out |= {"record_type": h["warc-type"], "page_id": h.get("x-page-id"), "refers_to": h.get("x-refers-to-page-id"), "url": h.get("warc-target-uri")}
    if not h["content-length"].isdigit() or int(h["content-length"]) + 4 != len(rest) or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": "content-length does not match the block"}
    block = rest[:-4]
    _, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
    out["payload_digest"] = said or None
    if out["record_type"] == "revisit":
        return out
    out["payload"] = payload
    if said and said != base32_sha1(payload):
        return out | {"error": "payload digest does not match"}
    out["payload_digest"] = base32_sha1(payload)
    return out


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the joined samples as a raw-content one where training finds too little."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[:DICT_BYTES]


def _dict(raw: bytes) -> zstd.ZstdCompressionDict:
    return zstd.ZstdCompressionDict(raw)


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write (page_id, url, html, refers_to) rows to archives in a shared folder; returns the written manifest (path, records).

    A task writes archives of names no other attempt uses and only then reports them; the manifest is stored
    by Spark's committer, so a lost executor or a second attempt leaves unnamed files at worst.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        c = zstd.ZstdCompressor(level=3, dict_data=_dict(dictionary) if dictionary else None)
        sink, done, n = None, [], 0

        for b in batches:
            for r in range(b.num_rows):
                page_id, url, html, refers = (b.column(i)[r].as_py() for i in range(4))
                if sink is None:
                    done.append([f"{base}/{uuid.uuid4().hex}.warc.zst", 0])
                    sink, n = fs.open_output_stream(done[-1][0]), 0
                    if dictionary:
                        sink.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                frame = c.compress(build_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers))
                sink.write(frame)
                done[-1][1] += 1
                n += len(frame)
                if n >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return materialize(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records bigint"), "warc-manifest")


def read_records(fs: pafs.FileSystem, path: str) -> Iterator[dict]:
    """Records of one archive in order. A damaged frame or tail gives one record with an error and ends the archive."""
    with fs.open_input_stream(path) as f:
        data = f.read(8)
        dictionary = None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICT_MAGIC:
            size = struct.unpack("<I", data[4:])[0]
            raw = f.read(size)
            if len(raw) != size:
                yield parse_record(b"") | {"error": "dictionary frame is cut short"}
                return
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
            dictionary, data = _dict(raw), b""
        while True:
            data = data or f.read(PIECE)
            if not data:
                return
            d, parts = zstd.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
            try:
                while not d.eof:
                    parts.append(d.decompress(data))
                    data = d.unused_data if d.eof else f.read(PIECE)
                    if not d.eof and not data:
                        raise zstd.ZstdError("frame is cut short")
            except zstd.ZstdError as e:
                yield parse_record(b"") | {"error": str(e)}
                return
            yield parse_record(b"".join(parts))


RECORD = "page_id string, record_type string, refers_to string, url string, payload_bytes bigint, payload_digest string, error string"


def read_archives(paths: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the archives named in the `path` column, one row each, parsed and validated, in bounded batches."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = names + ["payload"] * payload
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in read_records(*open_store(path)):
                    r["payload_bytes"] = None if r["payload"] is None else len(r["payload"])
                    held += payload and (r["payload_bytes"] or 0)
                    rows.append([r[c] for c in cols])
                    if held >= OUT_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in zip(cols, zip(*rows, strict=True), strict=True)], names=cols)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in zip(cols, zip(*rows, strict=True), strict=True)], names=cols)

    return paths.select("path").mapInArrow(run, RECORD + ", payload binary" * payload)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of at least min_bytes bytes the least page_id is kept, others refer to it.

    Equal ids of equal payloads are all responses. A null page_id is a response that nothing refers to; null html is
    an empty payload. Only digests and ids are grouped; pages move once, by their id, so a payload that many pages
    share makes no large partition of pages.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select("page_id", "url", "html").withColumn("sha", F.sha2(body, 256)).withColumn("len", F.octet_length(F.coalesce("html", F.lit(""))))
    narrow = materialize(p.where(f"page_id is not null and len >= {int(min_bytes)}").select("page_id", "sha"), "warc-digests")
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    refers = narrow.join(first, "sha").where("page_id > first").select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "first").distinct()
    out = p.join(refers, (F.col("page_id") == F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    return out.select("page_id", "url", "html", F.col("first").alias("refers_to"))


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives with revisit records; returns the manifest (path, records)."""
    some = [r[0].encode("utf-8", "surrogatepass") for r in pages.where("length(html) > 0").select(F.substring("html", 1, SAMPLE_BYTES)).limit(DICT_SAMPLES).toLocalIterator()]
    return write_archives(with_revisits(pages, min_bytes), folder, train_dictionary(some) if some else b"")


def resolve(records: DataFrame) -> DataFrame:
    """Give revisit records the payload length of the response that they refer to."""
    full = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest")).agg(F.max("payload_bytes").alias("o_bytes"))
    j = records.join(full, (F.col("refers_to") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    return j.withColumn("payload_bytes", F.coalesce("payload_bytes", "o_bytes")).drop("o_id", "o_digest", "o_bytes")


def op2_warc_zstd(spark, sf_dir: str) -> DataFrame:
    """Query: all pages written as archives in the shared scratch folder and read back."""
    manifest = archive_pages(spark, table(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
    # as many tasks as archives: the manifest is small, so Spark would read them all in one
    back = resolve(materialize(read_archives(manifest.repartition(max(1, min(manifest.count(), READ_TASKS)))), "warc-records"))
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "error")
