"""Token ids on disk: one zstandard frame per document, compressed with a dictionary that all frames share.

File format (a folder in the shared folder, written by Spark's own committers, so a task that is run again
leaves no second copy):

* ``dictionary``: one row (hash, dictionary). hash is the SHA-256 of the dictionary's bytes.
* ``blocks``: rows in ascending doc_id order, a file per range of doc_ids. Each row is a block of whole documents:
  shard, block, first_doc, last_doc, the dictionary's hash, the arrays doc_ids, n_tokens and offsets (the offset
  index), and data (the frames one after the other). A frame holds the ids as little-endian unsigned 32-bit
  integers. Parquet's statistics of first_doc and last_doc let ``read_documents`` open only the blocks it needs.

Encoding: the tokenizers library, special tokens not added. Where the file's normaliser and splitter never join
across a blank or line feed (``cuts_at_blanks``), a text is encoded piece by piece and the ids of a piece are kept in a
bounded per-worker cache; other files encode whole texts. Either way ids are those of the whole text (tests compare them).

Edge cases: null or empty text is the end id alone; null doc_ids sort first; rows that repeat a doc_id each get an
entry, ordered by text; an empty table gives an empty store. The dictionary is fitted on at most SAMPLE_DOCS
documents (twice that at most), SAMPLE_CHARS characters of each, chosen by the hash of their ids: a documented bound for
fitting; every document is compressed. With too few of them there is none, and frames stand alone.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.llm.shared import as_bytes, narrow, new_path, shuffle_partitions

END_ID = 1
LEVEL = 3
DICTIONARY_BYTES = 32_768
SAMPLE_DOCS = 400
SAMPLE_CHARS = 4_096
BLOCK_BYTES = 1 << 20
CACHE_PIECES = 500_000

_encoders: dict[str, PieceEncoder | WholeTexts] = {}


class PieceEncoder:
    """Ids of whole texts by a tokenizers file, piece by piece.

    The vocabulary splits letters from everything else and ends each word with a mark of its own, so pieces of
    letters only are encoded many in one call and cut apart after the ids that end a word; a piece of letters and one
    comma or full stop is put together from both. Words of a-z, which no normaliser changes, go to the library's model
    directly. Any other piece is encoded by itself. Known pieces live in two
    generations; a full young one becomes the old one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails = {mark: self._ids(mark).tobytes() for mark in ",."}
        if self._ids("ab,").tobytes() != self._ids("ab").tobytes() + self.tails[","]:
            self.tails = {}
        self.model = self.tokenizer.model
        probes = ["a", "the", "probes", "internationalisation", "zyxwvut"]
        self.direct = all([t.id for t in self.model.tokenize(w)] == self._ids(w).tolist() for w in probes)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _find(self, piece: str) -> bytes | None:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is not None:
                self.young[piece] = ids
        return ids

    def _learn(self, pieces: list[str]) -> None:
        built, words = [], set()
        for p in pieces:
            tail = self.tails.get(p[-1:])
            core = p[:-1] if tail else p
            if core.isalpha():
                if core.isascii():
                    core = core.lower()
                built.append((p, core, tail or b""))
                if self._find(core) is None:
                    words.add(core)
            else:
                self.young[p] = self._ids(p).tobytes()
        if self.direct:
            tokenize, plain = self.model.tokenize, {w for w in words if w.isascii()}
            for w in plain:
                self.young[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
            words -= plain
        if words:
            ordered = list(words)
            ids = self._ids(" ".join(ordered))
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(ordered):
                raw = ids.tobytes()
                for w, a, b in zip(ordered, [0, *cuts], cuts):
                    self.young[w] = raw[4 * a : 4 * b]
            else:  # letters that the vocabulary's splitter does not take for letters
                for w in ordered:
                    self.young[w] = self._ids(w).tobytes()
        for p, core, tail in built:
            self.young[p] = self.young[core] + tail

    def __call__(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        new = set(pieces).difference(self.young)
        if new:
            if len(self.young) > CACHE_PIECES:
                self.old, self.young = self.young, {}
                new = set(pieces)
            unknown = [p for p in new if self._find(p) is None]
            if unknown:
                self._learn(unknown)
        return b"".join(map(self.young.__getitem__, pieces))


class WholeTexts:
    """Ids of whole texts by any tokenizers file, a text at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cuts_at_blanks(path: str) -> bool:
    """Whether the ids of a text are those of its pieces between blanks and line feeds, one after the other: the file's
    normaliser and splitter drop both, whatever stands beside them, and its model marks the end of each word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.pre_tokenizer is None or getattr(tokenizer.model, "end_of_word_suffix", None) != "</w>":
        return False
    probe = "ab  c\nde. \n, f"
    text = tokenizer.normalizer.normalize_str(probe) if tokenizer.normalizer else probe
    return [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == ["ab", "c", "de", ".", ",", "f"]


def encoder(path: str) -> PieceEncoder | WholeTexts:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path) if cuts_at_blanks(path) else WholeTexts(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    held = narrow(docs, "doc_id", "text")
    every = max(1, held.count() // SAMPLE_DOCS)  # a bounded sample at every size; it only shapes the dictionary
    # Of a longer text a part that starts anywhere, so that long texts shape it too.
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    rows = (
        held.where((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & (F.octet_length("text") > 0))
        .select(F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("text")).limit(2 * SAMPLE_DOCS).collect()
    )
    encode = encoder(vocabulary)
    samples = [s for s in (encode(r.text) for r in rows) if s]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too short to train on
        return b""


BLOCKS = ("shard int, block int, first_doc bigint, last_doc bigint, dictionary_hash string, doc_ids array<bigint>, "
          "n_tokens array<bigint>, offsets array<bigint>, data binary")
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                    ("dictionary_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
                    ("offsets", pa.list_(pa.int64())), ("data", pa.binary())])


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_store(docs: DataFrame, vocabulary: str, end_id: int = END_ID, path: str | None = None) -> str:
    """Encode, compress and write every document; returns the store's folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    dictionary = train_dictionary(docs, vocabulary)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def block(shard: int, k: int, ids: list, sizes: list[int], frames: list[bytes]) -> pa.RecordBatch:
        offsets = np.cumsum([0] + [len(f) for f in frames]).tolist()
        row = [shard, k, ids[0], ids[-1], digest, ids, sizes, offsets, b"".join(frames)]
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _ARROW)], schema=_ARROW)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack, shard, k = encoder(vocabulary), _compressor(dictionary), TaskContext.get().partitionId(), 0
        ids, sizes, frames, held = [], [], [], 0
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = encode(text or "") + end
                ids.append(doc_id)
                sizes.append(len(raw) // 4)
                frames.append(pack.compress(raw))
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield block(shard, k, ids, sizes, frames)
                    ids, sizes, frames, held, k = [], [], [], 0, k + 1
        if ids:
            yield block(shard, k, ids, sizes, frames)

    ordered = narrow(docs, "doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.hash:
        raise ValueError(f"the dictionary of {path} does not have its hash")
    return bytes(row.dictionary)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, dictionary_hash) of every document, from the files.

    start counts the ids of all documents before it. The running sum is taken inside blocks and files, and over
    one total per file."""
    dictionary = _dictionary(spark, path)
    digest = hashlib.sha256(dictionary).hexdigest()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary)
        for part in parts:
            for row in part.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, sizes, crcs = row["offsets"], np.array(row["n_tokens"], np.int64), []
                for k, n in enumerate(sizes.tolist()):
                    raw = unpack.decompress(row["data"][at[k] : at[k + 1]])
                    if len(raw) != 4 * n:
                        raise ValueError(f"document {row['doc_ids'][k]} has {len(raw)} bytes for {n} ids")
                    crcs.append(zlib.crc32(raw))
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.array(crcs, pa.int64()), pa.array([digest] * n),
                ], names=["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32", "dictionary_hash"])

    rows = blocks.mapInArrow(run, "shard int, block int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint, dictionary_hash string")
    totals = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    # One row per block of a MiB and one per file: the window over files has as many rows as the writer had tasks.
    files = totals.groupBy("shard").agg(F.sum("n").alias("n")).selectExpr(
        "shard", "sum(n) over (order by shard rows between unbounded preceding and current row) - n as file_base")
    bases = totals.join(F.broadcast(files), "shard").selectExpr(
        "shard", "block", "file_base + sum(n) over (partition by shard order by block rows between unbounded preceding and current row) - n as base")
    return rows.join(bases, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "dictionary_hash")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked documents: only their blocks are read and only their frames are decompressed."""
    dictionary = _dictionary(spark, path)
    wanted = sorted(set(doc_ids))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(
        F.col("last_doc").between(wanted[0], 2**63 - 1) & (F.col("first_doc") <= wanted[-1]) if wanted else F.lit(False))
    blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("bigint") for x in wanted])))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, asked = _decompressor(dictionary), set(wanted)
        for part in parts:
            for row in part.to_pylist():
                at = row["offsets"]
                for k, doc_id in enumerate(row["doc_ids"]):
                    if doc_id in asked:
                        ids = np.frombuffer(unpack.decompress(row["data"][at[k] : at[k + 1]]), "<u4").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, ids array<bigint>")
