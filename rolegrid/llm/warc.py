"""A content-addressed WARC archive.

``write_archive`` keeps three tables in the shared folder:

* ``dictionary``: one row with a zstandard dictionary shared by all payloads, and its SHA-256. It is fitted on at most
  2 x SAMPLE pages, SAMPLE_CHARS characters of each, chosen by the hash of their ids (a documented bound on fitting);
* ``payloads``: each distinct payload once, under its SHA-256, with its length and its bytes in a zstandard frame;
* ``headers``: one row per record with the exact bytes of its WARC header and HTTP header, the payload's SHA-256,
  and the part of the payload's references it belongs to.

Of the records with equal payloads the one with the largest page_id is the response and the others revisit it;
payloads shorter than ``min_bytes`` are always responses. ``read_archive`` joins headers to payloads, checks both
digests and the lengths, and parses the records; ``record_bytes`` gives the WARC records as they would stand in a
.warc file. A payload with many references (a hot digest) is joined in several parts of at most REFERENCES rows
each, so no task holds them all.

Edge cases: null html is an empty payload; a null url has no target line, and CR and LF in one are
percent-encoded; rows without a page_id are responses of their own (nothing can refer to them) sharing the stored
payload; rows that repeat page_id and payload are the same response twice; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.llm.shared import as_bytes, narrow, new_path, stash

MIN_BYTES = 0
REFERENCES = 500
LEVEL = 3
DICTIONARY_BYTES = 32_768
SAMPLE = 300
SAMPLE_CHARS = 16_384
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _stamps(pages: DataFrame) -> DataFrame:
    """(page_id, url, sha256, sha1, n_bytes): what the records need of the payloads, without the payloads."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bodies = as_bytes(part.column(2))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
                pa.array([base32_sha1(b) for b in bodies], pa.string()), pa.array([len(b) for b in bodies], pa.int64()),
            ], names=["page_id", "url", "sha256", "sha1", "n_bytes"])

    return narrow(pages, "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, sha256 string, sha1 string, n_bytes bigint")


def _parts(n: Column) -> Column:
    return F.ceil(n / REFERENCES).cast("int")


def _lines(*fields: tuple[str, str | None]) -> bytes:
    return b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields if v is not None)


def _headers(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            warc, http = [], []
            for r in part.to_pylist():
                http.append(b"HTTP/1.1 200 OK" + CRLF + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(r["n_bytes"]))) + CRLF)
                again = r["refers_to"] is not None
                url = r["url"].replace("\r", "%0D").replace("\n", "%0A") if r["url"] is not None else None
                warc.append(b"WARC/1.1" + CRLF + _lines(
                    ("WARC-Type", "revisit" if again else "response"),
                    ("WARC-Record-ID", f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>"),
                    ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{r['sha1']}"),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None),
                    ("WARC-Refers-To", f"<urn:page:{r['refers_to']}>" if again else None),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("Content-Length", str(len(http[-1]) + (0 if again else r["n_bytes"]))),
                ) + CRLF)
            yield pa.RecordBatch.from_arrays([
                part["page_id"], part["sha256"], part["part"], pa.array(warc, pa.binary()), pa.array(http, pa.binary()),
            ], names=["page_id", "sha256", "part", "warc_header", "http_header"])

    return rows.mapInArrow(run, "page_id bigint, sha256 string, part int, warc_header binary, http_header binary")


def write_archive(pages: DataFrame, min_bytes: int = MIN_BYTES, path: str | None = None) -> str:
    """Write both tables; returns the archive's folder."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    stamps = stash(_stamps(pages), "stamps")
    owners = stash(stamps.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n_refs")), "owners")
    owned = stamps.join(owners, "sha256")
    again = (F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("owner"))
    rows = owned.select(
        "page_id", "url", "sha256", "sha1", "n_bytes", F.when(again, F.col("owner")).alias("refers_to"),
        F.pmod(F.xxhash64("page_id", "url", F.when(F.col("page_id").isNull(), F.rand())), _parts(F.col("n_refs"))).cast("int").alias("part"))
    _headers(rows).write.parquet(f"{path}/headers")
    # A payload's copies meet in one row per task before they are sent anywhere.
    shared = _train(pages)
    spark.createDataFrame([(hashlib.sha256(shared).hexdigest(), shared)], "hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    once = _packed(pages, shared).groupBy("sha256").agg(F.any_value("n_bytes").alias("n_bytes"), F.any_value("packed").alias("packed"))
    counted = once.join(owners.select("sha256", _parts(F.col("n_refs")).alias("parts")), "sha256")
    counted.select("sha256", "parts", "n_bytes", "packed").write.option("compression", "none").parquet(f"{path}/payloads")
    return path


def _train(pages: DataFrame) -> bytes:
    held = narrow(pages, "page_id", "html")
    every = max(1, held.count() // SAMPLE)
    # Of a longer page a part that starts anywhere, so that long pages shape it too.
    at = F.pmod(F.xxhash64("page_id", F.lit(1)), F.greatest(F.char_length("html") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    some = held.where((F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0) & (F.octet_length("html") >= 64))
    samples = [r.html.encode() for r in some.select(F.substring("html", at, F.lit(SAMPLE_CHARS)).alias("html")).limit(2 * SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:  # samples too alike or too short to train on
        return b""


def _read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.hash:
        raise ValueError(f"the dictionary of {path} does not have its hash")
    return bytes(row.dictionary)


def _data(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _packed(pages: DataFrame, dictionary: bytes) -> DataFrame:
    """(sha256, n_bytes, packed): payloads as zstandard frames."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_data(dictionary))
        for part in parts:
            bodies = as_bytes(part.column(0))
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()), pa.array([len(b) for b in bodies], pa.int64()),
                pa.array([pack.compress(b) for b in bodies], pa.binary()),
            ], names=["sha256", "n_bytes", "packed"])

    return narrow(pages, "html").mapInArrow(run, "sha256 string, n_bytes bigint, packed binary")


def _joined(spark: SparkSession, path: str) -> DataFrame:
    headers = spark.read.schema("page_id bigint, sha256 string, part int, warc_header binary, http_header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, parts int, n_bytes bigint, packed binary").parquet(f"{path}/payloads")
    copies = payloads.select("sha256", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "n_bytes", "packed")
    return headers.join(copies, ["sha256", "part"])


def parse_header(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode().rstrip("\r\n").split("\r\n")
    return first, dict(x.split(": ", 1) for x in lines)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record, parsed from its header
    and checked against its payload."""
    dictionary = _read_dictionary(spark, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_data(dictionary))
        for part in parts:
            out = []
            for r in part.to_pylist():
                payload = unpack.decompress(r["packed"])
                version, h = parse_header(r["warc_header"])
                digest = base32_sha1(payload)
                if (version != "WARC/1.1" or hashlib.sha256(payload).hexdigest() != r["sha256"] or h["WARC-Payload-Digest"] != f"sha1:{digest}"
                        or len(payload) != r["n_bytes"] or parse_header(r["http_header"])[1]["Content-Length"] != str(len(payload))):
                    raise ValueError(f"the record of page {r['page_id']} does not match its payload")
                own, refers = h["WARC-Record-ID"][10:-1], h.get("WARC-Refers-To")
                out.append((int(own) if own else None, len(payload), digest, h["WARC-Type"], int(refers[10:-1]) if refers else None, h.get("WARC-Target-URI")))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return _joined(spark, path).mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def record_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact WARC record, headers and block, with the empty lines that end it."""
    dictionary = _read_dictionary(spark, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_data(dictionary))
        for part in parts:
            records = []
            for r in part.to_pylist():
                again = "WARC-Refers-To" in parse_header(r["warc_header"])[1]
                records.append(r["warc_header"] + r["http_header"] + (b"" if again else unpack.decompress(r["packed"])) + 2 * CRLF)
            yield pa.RecordBatch.from_arrays([part["page_id"], pa.array(records, pa.binary())], names=["page_id", "record"])

    return _joined(spark, path).mapInArrow(run, "page_id bigint, record binary")
