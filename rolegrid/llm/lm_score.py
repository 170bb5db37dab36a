"""Language-model scores: prediction by partial matching over bytes, and word unigrams beside it.

``score_texts`` learns from the rows where ``learn`` holds and scores all rows, whole texts, A-Z lower-cased:

* ``score``: log10 of the text's probability (its UTF-8 bytes, then an end) in a byte-context trie of order 5
  with escape method C and symbol exclusion (``byte_trie``), pretrained on all learned texts;
* ``base_score``: the sum over words and one end of log10((c + 0.5) / (N + 0.5 (V + 1))).

Nothing is capped or pruned: the trie has every window of every learned text. It never stands in one place.

1. Texts go into blocks of bounded size, written once (``block`` is frozen by that).
2. Each block gives its distinct windows and words with their learned counts, packed by shard: windows by the
   two nearest context symbols, so that every node of order 2 and above is whole in one shard; words by hash.
3. Shards are merged over at most ``FAN`` blocks at a time, level by level; orders 0 and 1 (at most 258 x 257
   entries) are summed and given to every task.
4. Each shard answers the windows and words of its blocks, again at most ``FAN`` blocks a task, and a block's
   answers meet its texts by a cogroup.

A row with a null text is an empty text (its end is scored); a null ``learn`` counts as false. Repeated
``doc_id`` s are scored row by row. Without learned rows every byte is uniform over 257 symbols. An empty table
gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from rolegrid.llm import byte_trie as bt
from rolegrid.llm.shared import narrow, new_path, stash

BLOCK_BYTES = 32 << 20
SHARDS = 64
FAN = 256
FLUSH = 4 << 20

BODY = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("body", pa.binary())])
PACKED = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("learned", pa.int64())])
ANSWER = pa.schema([("kind", pa.string()), ("block", pa.string()), ("keys", pa.binary()), ("vals", pa.binary())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

# The end of a text as a word: no word is empty.
END_WORD = b""


def ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def rows(schema: pa.Schema, values: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*values)) if values else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --- packed sorted keys ---------------------------------------------------------------------------------


def pack(keys: np.ndarray) -> bytes:
    """Sorted integers as differences, which compress."""
    return np.diff(keys, prepend=np.int64(0)).astype("<i8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i8"))


def pack_words(words: list[bytes]) -> bytes:
    return b" ".join(words)


def unpack_words(data: bytes) -> list[bytes]:
    return data.split(b" ")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the two nearest context symbols."""
    context = (keys >> (bt.BITS * (bt.DEPTH - 1))).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


# --- blocks ---------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a block name: consecutive texts of one task, up to BLOCK_BYTES together."""
    task, seq, filled = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 256):
            part, names, bodies = texts.slice(at, 256), [], []
            for x in part.to_pylist():
                body = (x or b"").lower()
                if filled and filled + len(body) > BLOCK_BYTES:
                    seq, filled = seq + 1, 0
                filled += len(body)
                names.append(f"{task}-{seq}")
                bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), batch.column("doc_id").slice(at, 256), batch.column("learn").slice(at, 256), pa.array(bodies, pa.binary())], schema=BODY)


class _Tally:
    """Distinct windows and words of a block with learned counts, 0 for those that only unlearned texts have."""

    def __init__(self):
        self.keys, self.counts, self.words = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def take(self, bodies: list[bytes], learn: bool) -> None:
        for keys, _, _ in bt.windows(bodies):
            found, n = np.unique(keys, return_counts=True)
            self.fresh.append((found, n if learn else np.zeros(len(found), np.int64)))
            self.size += len(found)
            if self.size > FLUSH:
                self.settle()
        for body in bodies:
            if learn:
                self.words.update(body.split())
                self.words[END_WORD] += 1
            else:
                self.words.update(dict.fromkeys(body.split(), 0))
                self.words.setdefault(END_WORD, 0)

    def settle(self) -> None:
        self.keys, self.counts = bt.add(
            np.concatenate([self.keys, *[k for k, _ in self.fresh]]), np.concatenate([self.counts, *[n for _, n in self.fresh]]))
        self.fresh, self.size = [], 0

    def packed(self, block: str, shards: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        shard = shard_of(self.keys, shards)
        for s in np.unique(shard):
            k, n = self.keys[shard == s], self.counts[shard == s]
            yield rows(PACKED, [("window", int(s), block, pack(k), n.astype("<i8").tobytes(), int(n.sum()))])
        yield from _packed_words(block, self.words, shards)


def _packed_words(block: str, words: dict[bytes, int], shards: int) -> Iterator[pa.RecordBatch]:
    parts: dict[int, list[bytes]] = {}
    for w in sorted(words):
        parts.setdefault(zlib.crc32(w) % shards, []).append(w)
    for s, held in parts.items():
        n = [words[w] for w in held]
        yield rows(PACKED, [("word", s, block, pack_words(held), np.array(n, "<i8").tobytes(), sum(n))])


def _count(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tally = None, _Tally()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, learn, bodies = (part.column(c).to_pylist() for c in ("block", "learn", "body"))
                for name in dict.fromkeys(names):
                    if name != block:
                        if block is not None:
                            yield from tally.packed(block, shards)
                        block, tally = name, _Tally()
                    for flag in (True, False):
                        own = [b for n, f, b in zip(names, learn, bodies) if n == name and f == flag]
                        if own:
                            tally.take(own, flag)
        if block is not None:
            yield from tally.packed(block, shards)

    return count


# --- the model ------------------------------------------------------------------------------------------


def _merge(shards: int):
    """Packed rows of one shard as one, with the learned keys only."""

    def merge(table: pa.Table) -> pa.Table:
        kind, shard, block = (table.column(c)[0].as_py() for c in ("kind", "shard", "block"))
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        if kind == "window":
            k, n = bt.add(np.concatenate([unpack(x) for x in keys]), np.concatenate([np.frombuffer(x, "<i8") for x in counts]))
            k, n = k[n > 0], n[n > 0]
            return pa.Table.from_batches([rows(PACKED, [(kind, shard, block, pack(k), n.tobytes(), int(n.sum()))] if len(k) else [])])
        total: Counter = Counter()
        for x, c in zip(keys, counts):
            for w, m in zip(unpack_words(x), np.frombuffer(c, "<i8").tolist()):
                if m:
                    total[w] += m
        return pa.Table.from_batches(list(_packed_words(block, total, shards)), schema=PACKED)

    return merge


def model(tallies: DataFrame, shards: int, n_blocks: int) -> DataFrame:
    """One packed row per kind and shard: all learned windows and words with their counts. A task merges the
    rows of about FAN blocks; what comes out is merged again until one row is left."""
    out, groups = tallies.where("learned > 0"), n_blocks
    while True:
        groups = -(-groups // FAN)
        out = out.groupBy("kind", "shard", F.pmod(F.xxhash64("block", F.lit(groups)), F.lit(groups)).alias("part")).applyInArrow(_merge(shards), ddl(PACKED))
        if groups == 1:
            return stash(out, "lm-model")
        out = stash(out, "lm-merge")


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of order 1 of a shard's windows."""
    schema = pa.schema([("entry", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            k, n = bt.add(bt.shorten(unpack(keys), 1), np.frombuffer(counts, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], schema=schema)


def shortest_orders(trie: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Entries of orders 0 and 1 over all shards: at most 258 x 257 rows, whatever the input."""
    found = trie.where("kind = 'window'").select("keys", "counts").mapInArrow(_short, "entry bigint, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).toPandas()
    one = bt.add(found["entry"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    return [bt.add(one[0] & bt.LOW, one[1]), one]


# --- answers and scores ---------------------------------------------------------------------------------


def _answer(shared: list[tuple[np.ndarray, np.ndarray]]):
    """Log probabilities of the windows, and counts of the words, of the blocks asked of one shard."""

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if not asked.num_rows:
            return pa.Table.from_batches([], schema=ANSWER)
        kind = asked.column("kind")[0].as_py()
        blocks = list(zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist()))
        keys, counts = (held.column(c).to_pylist() for c in ("keys", "counts"))
        if kind == "window":
            known = (unpack(keys[0]), np.frombuffer(counts[0], "<i8")) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            trie = bt.levels(*known, shared)
            every = np.unique(np.concatenate([unpack(k) for _, k in blocks]))
            value = bt.log_probability(trie, every)
            for block, packed in blocks:
                out.append((kind, block, packed, value[np.searchsorted(every, unpack(packed))].tobytes()))
        else:
            count = {w: n for k, c in zip(keys, counts) for w, n in zip(unpack_words(k), np.frombuffer(c, "<i8").tolist())}
            for block, packed in blocks:
                out.append((kind, block, packed, np.array([count.get(w, 0) for w in unpack_words(packed)], "<i8").tobytes()))
        return pa.Table.from_batches([rows(ANSWER, out)])

    return answer


def _score(n_learned: int, n_distinct: int):
    """Scores of a block's texts from its answers."""
    below = n_learned + 0.5 * (n_distinct + 1)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_batches([], schema=SCORED)
        packed = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "vals"))))
        # A block that was read by two tasks asked twice for some windows: one answer each.
        keys, first = np.unique(np.concatenate([unpack(k) for kind, k, _ in packed if kind == "window"]), return_index=True)
        log_p = bt.Lookup(keys, np.concatenate([np.frombuffer(v, "<f8") for kind, _, v in packed if kind == "window"])[first])
        counts = {w: n for kind, k, v in packed if kind == "word" for w, n in zip(unpack_words(k), np.frombuffer(v, "<i8").tolist())}
        out = []
        for batch in texts.to_batches(max_chunksize=256):
            bodies, sums = batch.column("body").to_pylist(), np.zeros(batch.num_rows)
            for windows, places, sizes in bt.windows(bodies):
                np.add.at(sums, places, np.add.reduceat(log_p(windows), np.r_[0, np.cumsum(sizes)[:-1]]))
            n_tokens, n_known, base = [], [], []
            for body in bodies:
                c = np.array([counts[w] for w in body.split()] + [counts[END_WORD]], np.float64)
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                base.append(float(np.log10((c + 0.5) / below).sum()))
            out.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([not x for x in batch.column("learn").to_pylist()], pa.bool_()), pa.array(n_tokens, pa.int64()),
                 pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64())], schema=SCORED))
        return pa.Table.from_batches(out, schema=SCORED)

    return score


def learns(doc_id: str = "doc_id") -> Column:
    """Whether a row is learned from: crc32 of its doc_id as text, modulo 5, is not 1. A null doc_id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def score_texts(docs: DataFrame, learn: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    spark = docs.sparkSession
    asked = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text", F.coalesce(learns() if learn is None else learn, F.lit(False)).alias("learn"))
    texts = _compact(asked.mapInArrow(_blocks, ddl(BODY)), "lm-texts")
    tallies = _compact(texts.mapInArrow(_count(shards), ddl(PACKED)), "lm-tallies")
    n_blocks = max(1, texts.agg(F.count_distinct("block")).first()[0])
    trie = model(tallies, shards, n_blocks)
    shared = shortest_orders(trie)
    known = trie.where("kind = 'word'").agg(F.sum("learned"), F.sum(F.octet_length("counts") / 8).cast("bigint")).first()
    n_learned, n_distinct = (x or 0 for x in known)
    salts = -(-n_blocks // FAN)
    salted = trie.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asks = tallies.select("kind", "shard", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "keys")
    answers = salted.groupBy("kind", "shard", "salt").cogroup(asks.groupBy("kind", "shard", "salt")).applyInArrow(_answer(shared), ddl(ANSWER))
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(n_learned, n_distinct), ddl(SCORED))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_learned).cast("bigint").alias("train_tokens"), "base_score", "score")


def _compact(df: DataFrame, name: str) -> DataFrame:
    """stash with a dense codec: these tables are as large as the texts."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
