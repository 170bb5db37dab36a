"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The result is that of the sentencepiece library on the whole text with the given BPE model file. The public file holds
a BPE model, so the scan runs over the max-plus values 0 and minus infinity: a sequence of pieces is the BPE encoding
exactly if every two neighbours are (encoding their joined text gives the two back), so one path between two states
has value 0 and all others minus infinity.

* A document of at most CHUNK characters is encoded by the library.
* A longer one is cut every CHUNK characters. The state at a cut is the piece across or up to it, (characters before,
  characters after). Where a word begins right at the cut, no piece can cross and there is one state. ``transfer``
  gives a chunk's matrix: which state at its right cut follows from which at its left. Words wholly inside are encoded
  by the library once, whatever the states; only the parts of words at the ends (or a chunk without a word beginning)
  are searched.
* ``combine`` is the associative product of two matrices. Each RANGE neighbouring chunks are combined by a task of their
  own; the products of a document leave one state at each border of the ranges, and ``resolve`` one at each cut inside a range.
* ``backtrace`` then finds each chunk's pieces by itself.

A model that is not BPE, or that normalises texts, is refused.

Decoding joins the pieces' bytes (byte pieces included), turns U+2581 into a blank and drops the first one.

Edge cases: null or empty text has no ids; U+2581 in a text counts as a blank, as in the library; characters outside
the vocabulary become byte pieces; rows without a doc_id or with a repeated one are encoded each; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.shared import narrow, stash

CHUNK = 16_384
#: Chunks whose matrices one task combines.
RANGE = 256
#: Documents whose ids are held as Python numbers at a time.
ROWS = 128
BLANK = "▁"
EDGE = (0, 0)
State = tuple[int, int]
_models: dict[str, Pieces] = {}


def check_model(serialized: bytes) -> None:
    """Raise unless the scan gives this model's ids: BPE, texts taken as they are but for blanks."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(serialized)
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != train.BPE:
        raise ValueError("not a BPE model: its pieces are not decided by their neighbours alone")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("the model changes texts before it cuts them")
    if not train.byte_fallback:
        raise ValueError("the model has no byte pieces for characters outside its vocabulary")


class Pieces:
    """A BPE model file: its pieces, and which pieces may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp.serialized_model_proto())
        plain = [n for n in range(sp.vocab_size()) if not (sp.is_control(n) or sp.is_unknown(n) or sp.is_byte(n) or sp.is_unused(n))]
        self.ids = {sp.id_to_piece(n): n for n in plain}
        self.scores = {p: sp.get_score(n) for p, n in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(sp.id_to_piece(n)[1:-1], 16): n for n in range(sp.vocab_size()) if sp.is_byte(n)}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces of this model reach across the beginning of a word")
        self.raw = [b""] * sp.vocab_size()
        for p, n in self.ids.items():
            self.raw[n] = p.replace(BLANK, " ").encode()
        for b, n in self.byte_ids.items():
            self.raw[n] = bytes([b])
        self._whole: dict[str, bool] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: join the neighbours whose piece scores best, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                got = self.scores.get(parts[k] + parts[k + 1])
                if got is not None and (best is None or got > best):
                    best, at = got, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, piece: str) -> bool:
        """Does encoding the piece's text give the piece? Single characters always stand."""
        if piece not in self._whole:
            self._whole[piece] = len(piece) == 1 or piece in self.ids and self.merge(piece) == [piece]
        return self._whole[piece]

    def beside(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self._pairs:
            if len(self._pairs) > 100_000:
                self._pairs.clear()
            self._pairs[key] = self.merge(a + b) == [a, b]
        return self._pairs[key]

    def id_list(self, piece: str) -> list[int]:
        n = self.ids.get(piece)
        return [n] if n is not None else [self.byte_ids[b] for b in piece.encode()]

    def words(self, normal: str) -> list[int]:
        """The library's ids of whole words; normal begins with U+2581."""
        return self.library.encode(normal[1:], num_threads=1) if normal != BLANK else self.id_list(BLANK)

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1) if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def pieces(path: str) -> Pieces:
    """One model per Python worker and file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def begins(s: str, k: int) -> bool:
    """Does a word begin at k, so that no piece crosses k?"""
    return k <= 0 or k >= len(s) or s[k] == BLANK != s[k - 1]


class Part:
    """One chunk [left, right) of a normalised text, with up to ``longest`` characters around it."""

    def __init__(self, model: Pieces, s: str, left: int, right: int, first: bool, last: bool):
        self.model, self.s, self.left, self.right = model, s, left, right
        self.open_left = not (first or begins(s, left))
        self.open_right = not (last or begins(s, right))
        # Where the part of a word that comes in ends, and where the one that goes out begins; both or neither.
        self.head_end: int | None = left
        self.tail_start: int | None = right
        if self.open_left:
            self.head_end = next((k for k in range(left + 1, right) if begins(s, k)), None if self.open_right else right)
        if self.open_right:
            self.tail_start = next((k for k in range(right - 1, left, -1) if begins(s, k)), None if self.open_left else left)

    def states(self, at: int) -> list[State]:
        """Pieces that cover the characters on both sides of the cut, or end at it."""
        s, out = self.s, []
        for lead in range(1, min(self.model.longest, at) + 1):
            if lead > 1 and begins(s, at - lead + 1):
                break
            for over in range(0, min(self.model.longest - lead, len(s) - at) + 1):
                if over > 0 and begins(s, at + over - 1) and over > 1:
                    break
                if self.model.whole(s[at - lead : at + over]):
                    out.append((lead, over))
        return out

    def search(self, start: int, seeds: dict[tuple[int, int], int], stop: int) -> dict[tuple[int, int], tuple[int, tuple[int, int] | None]]:
        """Pieces (begin, end) that the seeds lead to, with the seeds' bits and one piece before each; pieces that
        begin before stop only. No seeds: the search starts freely at start, with bit 1."""
        s, model = self.s, self.model
        nodes: dict[tuple[int, int], tuple[int, tuple[int, int] | None]] = {n: (bit, None) for n, bit in seeds.items()}
        ends: dict[int, list[tuple[int, int]]] = {}
        for n in seeds:
            ends.setdefault(n[1], []).append(n)
        limit = next((k for k in range(stop, min(len(s), stop + model.longest) + 1) if begins(s, k)), min(len(s), stop + model.longest))
        for k in range(start, stop):
            before = ends.get(k, ())
            free = not seeds and k == start
            if not before and not free:
                continue
            for e in range(k + 1, min(limit, k + model.longest) + 1):
                piece = s[k:e]
                if not model.whole(piece):
                    continue
                bits, back = (1, None) if free else (0, None)
                for n in before:
                    if model.beside(s[n[0] : n[1]], piece):
                        bits |= nodes[n][0]
                        back = back or n
                if bits:
                    nodes[(k, e)] = (bits, back)
                    ends.setdefault(e, []).append((k, e))
            ends.pop(k - 1, None)
        return nodes

    def transfer(self) -> list[tuple[State, State]]:
        """(left state, right state) of value 0; all others have value minus infinity."""
        ins = self.states(self.left) if self.open_left else [EDGE]
        closed = self.head_end is not None and self.tail_start is not None
        if closed and self.open_left:
            seeds = {(self.left - a, self.left + b): 1 << k for k, (a, b) in enumerate(ins)}
            found = self.search(self.left, seeds, self.head_end)
            bits = 0
            for (_, e), (got, _) in found.items():
                bits |= got if e == self.head_end else 0
            ins = [x for k, x in enumerate(ins) if bits >> k & 1]
        if closed:
            outs = [EDGE]
            if self.open_right:
                found = self.search(self.tail_start, {}, self.right)
                outs = [(self.right - b, e - self.right) for b, e in found if e >= self.right]
            return [(a, b) for a in ins for b in outs]
        seeds = {(self.left - a, self.left + b): 1 << k for k, (a, b) in enumerate(ins)}
        found = self.search(self.left, seeds, self.right)
        return [(x, (self.right - b, e - self.right)) for (b, e), (got, _) in found.items() if e >= self.right and b < self.right
                for k, x in enumerate(ins) if got >> k & 1]

    def _path(self, nodes: dict, last: tuple[int, int], seeds: dict) -> list[int]:
        out: list[tuple[int, int]] = []
        at: tuple[int, int] | None = last
        while at is not None and at not in seeds:
            out.append(at)
            at = nodes[at][1]
        return [n for b, e in reversed(out) for n in self.model.id_list(self.s[b:e])]

    def backtrace(self, came: State, goes: State) -> list[int]:
        """Ids of the pieces that begin inside the chunk, between the given states."""
        seed = {(self.left - came[0], self.left + came[1]): 1} if self.open_left else {}
        ids: list[int] = []
        closed = self.head_end is not None and self.tail_start is not None
        end = (self.right - goes[0], self.right + goes[1])
        if not closed:
            nodes = self.search(self.left, seed, self.right)
            return self._path(nodes, end, seed)
        if self.open_left:
            nodes = self.search(self.left, seed, self.head_end)
            last = next(n for n in nodes if n[1] == self.head_end)
            ids += self._path(nodes, last, seed)
        if self.head_end < self.tail_start:
            ids += self.model.words(self.s[self.head_end : self.tail_start])
        if self.open_right:
            nodes = self.search(self.tail_start, {}, self.right)
            ids += self._path(nodes, end, {})
        return ids


def combine(a: list[tuple[State, State]], b: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """Max-plus product of two matrices over 0 and minus infinity; associative."""
    after: dict[State, list[State]] = {}
    for x, y in b:
        after.setdefault(x, []).append(y)
    return sorted({(x, z) for x, y in a for z in after.get(y, ())})


def product(matrices: list[list[tuple[State, State]]]) -> list[tuple[State, State]]:
    """All matrices combined, in order."""
    return reduce(combine, matrices)


def resolve(matrices: list[list[tuple[State, State]]], came: State = EDGE, goes: State = EDGE) -> list[State]:
    """The one state at every cut, ends included, that lies on a path of value 0 from came to goes."""
    reach: list[set[State]] = [{came}]
    for m in matrices:
        reach.append({y for x, y in m if x in reach[-1]})
    back: set[State] = {goes}
    out = [goes]
    for k in range(len(matrices) - 1, -1, -1):
        back = {x for x, y in matrices[k] if y in back} & reach[k]
        if len(back) != 1:
            raise ValueError(f"{len(back)} states are left at cut {k}")
        out.append(next(iter(back)))
    return out[::-1]


def split(s: str, size: int, around: int) -> list[tuple[int, str, int, int]]:
    """(number, chunk with its surroundings, its beginning, its end) of a normalised text."""
    out = []
    for k, left in enumerate(range(0, len(s), size)):
        right = min(len(s), left + size)
        a, b = max(0, left - around), min(len(s), right + around)
        out.append((k, s[a:b], left - a, right - a))
    return out


def normal(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


CHUNKS = "doc_id bigint, mark string, k int, n int, body string, left int, right int"


def _chunks(docs: DataFrame, model: str, size: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = 2 * pieces(model).longest
        for part in parts:
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                mark = hashlib.sha256(f"{doc_id}\n{text}".encode()).hexdigest()
                cut = split(normal(text), size, around)
                for at in range(0, len(cut), 64):
                    some = cut[at : at + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_id] * len(some), pa.int64()), pa.array([mark] * len(some)), pa.array([c[0] for c in some], pa.int32()),
                        pa.array([len(cut)] * len(some), pa.int32()), pa.array([c[1] for c in some]), pa.array([c[2] for c in some], pa.int32()),
                        pa.array([c[3] for c in some], pa.int32()),
                    ], names=["doc_id", "mark", "k", "n", "body", "left", "right"])

    return docs.mapInArrow(run, CHUNKS)


def _part(model: Pieces, r: dict) -> Part:
    return Part(model, r["body"], r["left"], r["right"], r["k"] == 0, r["k"] == r["n"] - 1)


def _packed(matrix: list[tuple[State, State]]) -> list[list[int]]:
    return [[*a, *b] for a, b in matrix]


def _matrices(table: pa.Table) -> list[list[tuple[State, State]]]:
    return [[((a, b), (c, d)) for a, b, c, d in m] for m in table["matrix"].to_pylist()]


def _states(found: list[State]) -> pa.Array:
    return pa.array([list(x) for x in found], pa.list_(pa.int32()))


def _giants(docs: DataFrame, model: str, size: int) -> DataFrame:
    """(doc_id, ids, n_chunks) of documents that are cut into chunks."""
    rows = stash(_chunks(docs, model, size), "chunks")
    once = rows.dropDuplicates(["mark", "k"])  # rows that are repeated whole

    def transfers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [_packed(_part(pieces(model), r).transfer()) for r in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([part["mark"], part["k"], pa.array(got, pa.list_(pa.list_(pa.int32())))], names=["mark", "k", "matrix"])

    def products(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        return pa.table({"mark": table["mark"][:1], "r": table["r"][:1], "matrix": pa.array([_packed(product(_matrices(table)))], pa.list_(pa.list_(pa.int32())))})

    def borders(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        found = resolve(_matrices(table))
        return pa.table({"mark": table["mark"], "r": table["r"], "first": _states(found[:-1]), "last": _states(found[1:])})

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        found = resolve(_matrices(table), tuple(table["first"][0].as_py()), tuple(table["last"][0].as_py()))
        return pa.table({"mark": table["mark"], "k": table["k"], "came": _states(found[:-1]), "goes": _states(found[1:])})

    def traces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [np.array(_part(pieces(model), r).backtrace(tuple(r["came"]), tuple(r["goes"])), "<i4").tobytes() for r in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([part["mark"], part["k"], pa.array(got, pa.binary())], names=["mark", "k", "ids"])

    matrices = stash(once.mapInArrow(transfers, "mark string, k int, matrix array<array<int>>").withColumn("r", F.floor(F.col("k") / RANGE).cast("int")), "matrices")
    ranges = matrices.groupBy("mark", "r").applyInArrow(products, "mark string, r int, matrix array<array<int>>")
    ends = ranges.groupBy("mark").applyInArrow(borders, "mark string, r int, first array<int>, last array<int>")
    resolved = matrices.join(ends, ["mark", "r"]).groupBy("mark", "r").applyInArrow(states, "mark string, k int, came array<int>, goes array<int>")
    found = once.join(resolved, ["mark", "k"]).mapInArrow(traces, "mark string, k int, ids binary")
    whole = found.groupBy("mark").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("parts"))
    return rows.where("k = 0").select("doc_id", "mark", F.col("n").alias("n_chunks")).join(whole, "mark").select("doc_id", "parts", "n_chunks")


ENCODED = "doc_id bigint, ids array<int>, n_chunks int"


def encode(docs: DataFrame, model: str, size: int = CHUNK, with_text: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, n_chunks) of every row of docs; with_text: and the text that its ids stand for, as
    ``decode`` gives it, made by the same task."""
    held = narrow(docs, "doc_id", "text")
    long = F.char_length(F.coalesce("text", F.lit(""))) >= size

    def rows(some: pa.RecordBatch, ids: list[np.ndarray], n_chunks: pa.Array) -> pa.RecordBatch:
        columns, names = [some["doc_id"], pa.array(ids, pa.list_(pa.int32())), n_chunks], ["doc_id", "ids", "n_chunks"]
        if with_text:
            columns.append(pa.array([pieces(model).decode(x.tolist()) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names + ["text"] * with_text)

    def short(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, ROWS):
                some = part.slice(k, ROWS)
                ids = [np.array(pieces(model).encode(t or ""), np.int32) for t in some["text"].to_pylist()]
                yield rows(some, ids, pa.array([1] * len(ids), pa.int32()))

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            # A giant document at a time.
            for k in range(part.num_rows):
                some = part.slice(k, 1)
                yield rows(some, [np.frombuffer(b"".join(p), "<i4") for p in some["parts"].to_pylist()], some["n_chunks"])

    out = ENCODED + ", text string" * with_text
    return held.where(~long).mapInArrow(short, out).unionByName(_giants(held.where(long), model, size).mapInArrow(join, out))


def _id_rows(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the ids of their rows, as views."""
    for k in range(0, part.num_rows, ROWS):
        some = part.slice(k, ROWS)
        ids = some["ids"]
        flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        yield some, [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with the text its ids stand for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some, ids in _id_rows(part):
                text = [pieces(model).decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["ids"], some["n_chunks"], pa.array(text, pa.string())], names=["doc_id", "ids", "n_chunks", "text"])

    return encoded.select("doc_id", "ids", "n_chunks").mapInArrow(run, "doc_id bigint, ids array<int>, n_chunks int, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_sha256, n_chunks): ids as little-endian 32-bit integers, and the decoded text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some, ids in _id_rows(part):
                yield pa.RecordBatch.from_arrays([
                    some["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in some["text"].to_pylist()], pa.string()), some["n_chunks"],
                ], names=["doc_id", "n_tokens", "ids_crc32", "text_sha256", "n_chunks"])

    return decoded.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_sha256 string, n_chunks int")
