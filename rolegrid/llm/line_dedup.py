"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without ASCII space at both ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points held by two or more documents lose all their lines except those in the smallest
doc_id that holds them.

1. ``line_keys`` hashes keys to 128 bits and writes one row per document and key.
2. ``build_index`` aggregates per key (map-side combine, so a hot line costs one row per task), then gives each
   shard a minimal perfect hash with a fingerprint array, a count array and an owner array.
3. ``probe`` sends only (shard, key, doc_id) to the arrays. A shard hit by many rows (a hot line) is split by
   document over several tasks, each with its own copy of the small arrays.
4. ``apply_drops`` brings the decisions to the documents.

Edge cases: null or empty text is one empty line; rows without a doc_id keep their text and count for no key;
rows that repeat a doc_id are one document, each row keeping its own text; an empty table gives an empty result.
A key's identity is its 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.perfect_hash import PerfectHash
from rolegrid.llm.shared import SPACE, as_bytes, narrow, shuffle_partitions, stash

MIN_CHARS = 10
#: A shard asked for by more than twice the mean rows, and more than these, is split over several tasks.
PROBE_ROWS = 1_000


def _key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # bytes.lower() changes A-Z only


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(shard, h1, h2, doc_id): each key once per row of docs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests, owners = [], []
            for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                keys = {k for k in (_key(x, min_chars) for x in text.split(b"\n")) if k is not None}
                digests += map(_digest, keys)
                owners += [doc_id] * len(keys)
            if not owners:
                continue
            h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array((h[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(h[:, 0].view(np.int64)),
                pa.array(h[:, 1].view(np.int64)), pa.array(owners, pa.int64()),
            ], names=["shard", "h1", "h2", "doc_id"])

    held = narrow(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    return held.mapInArrow(run, "shard int, h1 bigint, h2 bigint, doc_id bigint")


INDEX = (
    "shard int, n_rows bigint, sizes array<int>, levels array<binary>, fingerprints binary, counts binary, owners binary"
)


def build_index(keys: DataFrame) -> DataFrame:
    """One row per shard: the hash's levels and the arrays it points into. counts is 1 or 2 (two or more documents)."""
    distinct = keys.groupBy("shard", "h1", "h2").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_rows"))

    def run(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        h2, owner = table["h2"].to_numpy(), table["owner"].to_numpy()
        # Two keys of one shard that share h1 but not h2: fold the second half in where that happens.
        mixed = len(np.unique(h1)) < len(h1)
        at = PerfectHash.build(_slot_key(h1, h2.view(np.uint64)) if mixed else h1)
        order = at(_slot_key(h1, h2.view(np.uint64)) if mixed else h1)
        prints, owners, counts = np.empty(at.n, np.int64), np.empty(at.n, np.int64), np.empty(at.n, np.uint8)
        prints[order], owners[order] = h2, owner
        counts[order] = np.where(table["last"].to_numpy() > owner, 2, 1)
        return pa.table({
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "n_rows": pa.array([int(table["n_rows"].to_numpy().sum())], pa.int64()),
            "sizes": pa.array([([-1] if mixed else [0]) + at.sizes], pa.list_(pa.int32())),
            "levels": pa.array([at.packed], pa.list_(pa.binary())),
            "fingerprints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "owners": pa.array([owners.tobytes()], pa.binary()),
        })

    return distinct.groupBy("shard").applyInArrow(run, INDEX)


def _slot_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ ((h2 << np.uint64(31)) | (h2 >> np.uint64(33)))


def probe(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, h1, h2) of the keys that lose their lines in doc_id."""
    mean = index.agg(F.coalesce(F.avg("n_rows"), F.lit(0.0))).first()[0]
    # As many rows as there are shards, a parameter: small enough to send to every task.
    split = index.select("shard", F.ceil(F.col("n_rows") / F.lit(max(2 * mean, PROBE_ROWS))).cast("int").alias("parts"))
    asked = keys.join(F.broadcast(split), "shard").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "h1"), F.col("parts")).cast("int"))
    arrays = index.drop("n_rows").join(F.broadcast(split), "shard").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(one: pa.Table, rows: pa.Table) -> pa.Table:
        if not one.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("doc_id", "h1", "h2")})
        kind, *sizes = one["sizes"][0].as_py()
        at = PerfectHash(sizes, one["levels"][0].as_py())
        prints = np.frombuffer(one["fingerprints"][0].as_py(), np.int64)
        counts = np.frombuffer(one["counts"][0].as_py(), np.uint8)
        owners = np.frombuffer(one["owners"][0].as_py(), np.int64)
        h1, h2, doc = (rows[n].to_numpy() for n in ("h1", "h2", "doc_id"))
        key = h1.view(np.uint64) if kind == 0 else _slot_key(h1.view(np.uint64), h2.view(np.uint64))
        slot = at(key)
        hit = (slot >= 0) & (prints[slot] == h2) & (counts[slot] > 1) & (owners[slot] != doc)
        return pa.table({"doc_id": doc[hit], "h1": h1[hit], "h2": h2[hit]})

    return (
        arrays.groupBy("shard", "part").cogroup(asked.select("shard", "part", "h1", "h2", "doc_id").groupBy("shard", "part"))
        .applyInArrow(run, "doc_id bigint, h1 bigint, h2 bigint")
    )


def apply_drops(docs: DataFrame, drops: DataFrame, extra: list[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines of the dropped keys gone, n_lines, n_dropped and kept_sha256."""
    lists = drops.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("h1", "h2")).alias("_drops"))
    joined = docs.join(lists, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in extra] + ["text string", "n_lines bigint", "n_dropped bigint", "kept_sha256 string"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            text, lines, gone, sha = [], [], [], []
            for body, drop in zip(as_bytes(part["text"]), part["_drops"].to_pylist()):
                rows = body.split(b"\n")
                kept = rows
                if drop:
                    away = {(x["h1"], x["h2"]) for x in drop}
                    kept = []
                    for row in rows:
                        key = _key(row, min_chars)
                        if key is None or tuple(np.frombuffer(_digest(key), "<i8").tolist()) not in away:
                            kept.append(row)
                    body = b"\n".join(kept)
                lines.append(len(rows))
                gone.append(len(rows) - len(kept))
                sha.append(hashlib.sha256(body).hexdigest())
                text.append(body)
            yield pa.RecordBatch.from_arrays(
                [part[n] for n in extra]
                + [pa.array(text, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
                names=[*extra, "text", "n_lines", "n_dropped", "kept_sha256"])

    return joined.select(*extra, "text", "_drops").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents with repeated lines removed: doc_id, the columns named in carry, text, n_lines, n_dropped,
    kept_sha256. shards defaults to eight per shuffle partition, so a shard shrinks as partitions are added."""
    spark = docs.sparkSession
    shards = shards or 8 * shuffle_partitions(spark)
    keys = stash(line_keys(docs, shards, min_chars), "line-keys")
    index = stash(build_index(keys), "line-index")
    kept = narrow(docs, "doc_id", *carry, "text")
    return apply_drops(kept, probe(keys, index), ["doc_id", *carry], min_chars)
