"""Removal of long repeated byte strings over run-length indexes.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else (in the same document or another, never
across documents) is removed. A document here is a row; rows that are equal in doc_id and text repeat each other.

One index over a whole corpus fits no machine, so the corpus is first dealt by content:

1. ``segments``: each window of LENGTH bytes belongs to its smallest ANCHOR-byte hash. Equal windows have equal
   anchors, so a repeat is always found inside one anchor. Neighbouring windows with one anchor form a segment, kept as
   (anchor, digest of its bytes, document, first window, windows): no text travels. Anchors met once are dropped,
   but for segments in which the anchor occurs more than once (periodic text can repeat within one segment).
2. Segments with equal anchor and digest are copies: all their windows repeat. One of each stays as a representative.
3. Anchors with several different representatives, or a periodic one, fetch their bytes and go to a shard. Each shard builds a
   ``RunIndex`` (run-compressed Burrows-Wheeler transform with samples at run ends) over its representatives and
   streams matching statistics; positions whose longest match reaches LENGTH are marked.
4. An anchor whose representatives together exceed HOT_BYTES (the edge of a passage in very many documents) is not
   one group: its representatives are cut into windows, and equal windows meet by their 128-bit hash, combined on the
   map side. Both ways give the same marks.
5. Marks are gathered per document and cut out of its text.

Edge cases: null text is empty; texts shorter than LENGTH keep everything; rows without a doc_id take part under the
id null; rows that repeat a doc_id are told apart by 32 bits of their text's hash; an empty table gives no rows.
Texts are handled as UTF-8 bytes, so what is kept may break a character; it is returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.run_index import RunIndex
from rolegrid.llm.shared import as_bytes, batches, narrow, shuffle_partitions, stash

LENGTH = 200
ANCHOR = 64
#: Windows of one segment at most; longer ones are cut.
WINDOWS = 4_096
#: Windows hashed at a time in a long text.
STEP = 1 << 19
SHARD_BYTES = 512 * 1024
HOT_BYTES = 192 * 1024
END = 0xFF  # never part of UTF-8

_BASE = 0xD6E8FEB86659FD93


def _anchor_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every width-byte string (width a power of two), by doubling."""
    base, w = _BASE, 1
    h = text.astype(np.uint64) + np.uint64(1)
    while w < width:
        m = len(h) - w
        h = h[:m] * np.uint64(base) + h[w:]
        base, w = base * base % 2**64, 2 * w
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every width neighbours: block-wise minima from both sides."""
    n = len(h) - width + 1
    rows = np.concatenate([h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    right = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : width - 1 + n]
    return np.minimum(left, right)


def cut_segments(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor hash, first window, windows, whether the anchor occurs in it more than once) of a text."""
    whole, span = np.frombuffer(text, np.uint8), length - anchor + 1
    for base in range(0, len(text) - length + 1, STEP):
        hashes = _anchor_hashes(whole[base : base + STEP + length - 1], anchor)
        least = _smallest(hashes, span)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        n = np.diff(np.append(first, len(least)))
        value, across = least[first], np.arange(span)
        leftmost = (hashes[first[:, None] + across] == value[:, None]).argmax(axis=1) + first
        rightmost = (first + n - 1 + span - 1) - (hashes[(first + n - 1)[:, None] + across[::-1]] == value[:, None]).argmax(axis=1)
        for h, s, w, p in zip(value.view(np.int64).tolist(), first.tolist(), n.tolist(), (leftmost != rightmost).tolist()):
            for more in range(0, w, WINDOWS):
                yield h, base + s + more, min(WINDOWS, w - more), p


def _mark(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text) - 2**31


SEGMENTS = "h bigint, d bigint, doc_id bigint, t int, s int, w int, p boolean"
_SEG = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int32()), ("s", pa.int32()), ("w", pa.int32()), ("p", pa.bool_())])


def segments(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for part in parts:
            for doc_id, text in zip(part["doc_id"].to_pylist(), as_bytes(part["text"])):
                found = list(cut_segments(text, length, anchor)) if len(text) >= length else []
                if found:
                    h, s, w, p = map(np.array, zip(*found))
                    d = np.fromiter((digest(text[a : a + n + length - 1]) for _, a, n, _ in found), np.uint64, len(found))
                    k = len(found)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h, pa.int64()), pa.array(d.view(np.int64)), pa.array([doc_id] * k, pa.int64()), pa.array(np.full(k, _mark(text), np.int32)),
                        pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(p)], schema=_SEG)

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(parts):
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return narrow(docs, "doc_id", "text").mapInArrow(merged, SEGMENTS)


def _packed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, t, packed): texts as zstandard frames, to be moved by document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for part in parts:
            texts = as_bytes(part["text"])
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array([_mark(x) for x in texts], pa.int32()), pa.array([pack.compress(x) for x in texts], pa.binary())],
                names=["doc_id", "t", "packed"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, t int, packed binary").select(_key().alias("key"), "doc_id", "t", "packed")


def _key() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (h, d, doc_id, t, s, w, n) with the bytes of the segments. One row of a repeated document serves."""
    lists = wanted.groupBy(_key().alias("key"), "t").agg(F.collect_list(F.struct("h", "d", "s", "w", "n")).alias("wants"))
    schema = "h bigint, d bigint, doc_id bigint, t int, s int, w int, n bigint, body binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple]:
            for part in parts:
                for doc_id, t, packed, wants in zip(*(part[c].to_pylist() for c in ("doc_id", "t", "packed", "wants"))):
                    text = unpack.decompress(packed)
                    for x in wants:
                        yield x["h"], x["d"], doc_id, t, x["s"], x["w"], x["n"], text[x["s"] : x["s"] + x["w"] + length - 1]

        yield from batches(rows(), pa.schema([
            ("h", pa.int64()), ("d", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int32()), ("s", pa.int32()), ("w", pa.int32()), ("n", pa.int64()), ("body", pa.binary())]), 2_000)

    joined = _packed(docs).join(lists, ["key", "t"]).select("doc_id", "t", "packed", "wants")
    return joined.mapInArrow(run, schema).dropDuplicates(["h", "d"])


MARKS = "doc_id bigint, t int, s int, w int"


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _index_marks(bodies: DataFrame, shards: int, length: int) -> DataFrame:
    """Marks (doc_id, t, first window, windows) of representatives that are alone with their digest, by shard."""

    def run(table: pa.Table) -> pa.Table:
        body = table["body"].to_pylist()
        text = np.frombuffer(b"".join(b + bytes([END]) for b in body), np.uint8)
        far = RunIndex(text).matching_statistics() >= length
        out, at = [], 0
        for doc_id, t, s, w, n, b in zip(*(table[c].to_pylist() for c in ("doc_id", "t", "s", "w", "n")), body):
            if n == 1:
                for a, m in zip(*_spans(far[at : at + w])):
                    out.append((doc_id, t, s + int(a), int(m)))
            at += len(b) + 1
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "t", "s", "w"])

    dealt = bodies.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, MARKS)


def _window_marks(bodies: DataFrame, length: int) -> DataFrame:
    """The same marks for anchors with too many bytes for one group: equal windows meet by hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc_id, t, s, w, n, body in zip(*(part[c].to_pylist() for c in ("doc_id", "t", "s", "w", "n", "body"))):
                got = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[k : k + length]) for k in range(w)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1])), pa.array([doc_id] * w, pa.int64()),
                    pa.array([t] * w, pa.int32()), pa.array(np.arange(s, s + w, dtype=np.int32)), pa.array([n] * w, pa.int64())],
                    names=["a", "b", "doc_id", "t", "s", "n"])

    cut = stash(bodies.mapInArrow(run, "a bigint, b bigint, doc_id bigint, t int, s int, n bigint"), "hot-windows")
    again = cut.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("a", "b")
    return cut.where("n = 1").join(again, ["a", "b"]).select("doc_id", "t", "s", F.lit(1).alias("w"))


def repeat_marks(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, t, s, w): windows s .. s + w - 1 of document (doc_id, t) also start elsewhere."""
    spark = docs.sparkSession
    every = stash(segments(docs, length, anchor), "segments")
    often = every.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("p").alias("p")).where("m > 1 or p").select("h")
    met = stash(every.join(often, "h"), "met-segments")
    kinds = stash(met.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"), F.min(F.struct("doc_id", "t", "s", "w")).alias("rep")), "segment-kinds")
    copies = met.join(kinds.where("n > 1").select("h", "d"), ["h", "d"]).select("doc_id", "t", "s", "w")
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("p").alias("p"), F.sum(F.col("rep.w") + length - 1).alias("bytes")).where("k > 1 or p").drop("p")
    wanted = kinds.join(groups, "h").select("h", "d", "rep.*", "n", (F.col("bytes") > HOT_BYTES).alias("hot"), "bytes")
    wanted = stash(wanted, "representatives")
    total = wanted.where("not hot").agg(F.coalesce(F.sum(F.col("w") + length), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD_BYTES), shuffle_partitions(spark) if total > SHARD_BYTES else 1)
    bodies = stash(_fetch(docs, wanted.select("h", "d", "doc_id", "t", "s", "w", "n"), length), "bodies")
    hot = wanted.where("hot").select("h").distinct()
    marks = copies.unionByName(_index_marks(bodies.join(hot, "h", "left_anti"), shards, length))
    return marks.unionByName(_window_marks(bodies.join(hot, "h", "left_semi"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""
    lists = repeat_marks(docs, length, anchor).groupBy(_key().alias("key"), "t").agg(
        F.collect_list(F.struct("s", "w")).alias("marks"))
    joined = _packed(docs).join(lists, ["key", "t"], "left").select("doc_id", "packed", "marks")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            out = []
            for packed, marks in zip(part["packed"].to_pylist(), part["marks"].to_pylist()):
                text = unpack.decompress(packed)
                kept, end, n = [], 0, 0
                spans: list[list[int]] = []
                for m in sorted((x["s"], x["s"] + x["w"] + length - 1) for x in marks or ()):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                for a, b in spans:
                    kept.append(text[end:a])
                    end, n = b, n + b - a
                kept.append(text[end:])
                body = b"".join(kept)
                out.append((body, len(text), n, len(spans), hashlib.sha256(body).hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"]] + [pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
