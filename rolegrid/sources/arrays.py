"""JSON arrays cut into the texts of their elements, exactly as written, whatever their size.

Nesting and strings are found on byte arrays: a quote counts unless an odd run of backslashes stands before it, the number
of quotes so far says what is inside a string, and the sum of brackets outside strings is the depth. Commas at depth 0
are cuts.

A body of more than ``BLOCK`` bytes is one row but not one task. Its blocks are dealt out; each is summarised as a
transition: for every state it may begin in (in a string or not, after a backslash or not), the state it ends in
and the change of depth. Transitions combine associatively, so the blocks' summaries alone give each block's real beginning; then
every block finds its own cuts, and only the pieces at block borders meet again.

An array is accepted if every element is JSON by itself; that also settles whether brackets match, as a body with
one that does not has an element that is not JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.operators.scans import running_sum
from rolegrid.session import cut

BLOCK = 1 << 20
SPACE = " \t\n\r"
_BODY, _K = "__body", "__k"


class _Tools:
    """What runs in the tasks. Functions are made inside, so that they reach the executors by value."""

    def __init__(self):
        import json

        import numpy as np

        def scan(data: bytes, starts: np.ndarray, in_string: bool = False, escaped: bool = False):
            """(codes, inside a string, depth) per byte, and the state at the end, of texts that begin at ``starts``,
            each outside strings and at depth 0; ``in_string`` and ``escaped`` are for the first of them. Texts but the
            last end with a byte that is neither a quote nor a backslash."""
            b = np.frombuffer(data, np.uint8)
            place = np.arange(len(b))
            plain = np.maximum.accumulate(np.where(b == 92, -1, place))  # the last byte so far that is no backslash
            before = np.concatenate([[-1], plain[:-1]])
            run = place - 1 - before + ((before == -1) & escaped)
            quote = (b == 34) & (run % 2 == 0)
            quotes = np.cumsum(quote)
            text = np.searchsorted(starts, place, side="right") - 1
            since = np.concatenate([[0], quotes])[starts]
            inside = (quotes - since[text] + (in_string & (text == 0))) % 2 == 1
            step = np.where(inside, 0, np.isin(b, (91, 123)).astype(np.int64) - np.isin(b, (93, 125)))
            depth = np.cumsum(step)
            depth -= np.concatenate([[0], depth])[starts][text]
            tail = len(b) - 1 - int(plain[-1]) + (plain[-1] == -1 and escaped)
            return b, inside, depth, (bool(inside[-1]), tail % 2 == 1)

        def refuse(name):
            raise ValueError(name)

        def matched(text: str) -> bool:
            open_, quoted, skip = [], False, False
            for ch in text:
                if quoted:
                    quoted, skip = skip or ch != '"', not skip and ch == "\\"
                elif ch == '"':
                    quoted = True
                elif ch in "[{":
                    open_.append(ch)
                elif ch in "]}" and (not open_ or open_.pop() + ch not in ("[]", "{}")):
                    return False
            return not open_ and not quoted

        def valid(text: str) -> bool:
            try:
                json.loads(text, parse_constant=refuse)
            except RecursionError:
                return matched(text)  # nested beyond the parser
            except ValueError:
                return False
            return True

        def then(first: list[int], second: list[int]) -> list[int]:
            """The transition of two blocks side by side: (end state, change of depth) for each of the four states."""
            out = []
            for state in range(4):
                middle, depth = first[2 * state], first[2 * state + 1]
                out += [second[2 * middle], depth + second[2 * middle + 1]]
            return out

        self.scan, self.valid, self.then = scan, valid, then


def _small(tools: _Tools, per_slice: int = 1 << 20):
    """Elements of bodies of one block, many bodies in one scan."""
    import numpy as np

    scan, valid, space = tools.scan, tools.valid, SPACE

    def cuts(bodies: list[bytes]) -> list[list[str]]:
        data = b"\n".join(bodies)
        lengths = np.array([len(x) for x in bodies])
        starts = np.cumsum(lengths + 1) - lengths - 1
        if not data:
            return [[] for _ in bodies]
        b, inside, depth, _ = scan(data, starts[starts < len(data)])
        at = np.flatnonzero((b == 44) & ~inside & (depth == 0))
        own = np.split(at, np.searchsorted(at, starts[1:]))
        out = []
        for start, length, found in zip(starts.tolist(), lengths.tolist(), own):
            edges = [start, *(found + 1).tolist()]
            parts = [data[a:e].decode().strip(space) for a, e in zip(edges, [*found.tolist(), start + length])]
            out.append(parts if len(parts) > 1 or parts[0] else [])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner, parts, filled = batch.column("__inner").to_pylist(), [], 0
            held: list[bytes] = []
            for x in inner:
                held.append(x)
                filled += len(x)
                if filled > per_slice:
                    parts += cuts(held)
                    held, filled = [], 0
            parts += cuts(held) if held else []
            good = [p if all(map(valid, p)) else None for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__inner"]).columns, pa.array(good, pa.list_(pa.string()))], names=[*(n for n in batch.schema.names if n != "__inner"), "__parts"])

    return run


def _summaries(tools: _Tools):
    import numpy as np

    scan = tools.scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("__bytes").to_pylist():
                moves = []
                for in_string in (False, True):
                    for escaped in (False, True):
                        _, _, depth, end = scan(data, np.zeros(1, np.int64), in_string, escaped)
                        moves += [2 * end[0] + end[1], int(depth[-1])]
                rows.append(moves)
            yield pa.RecordBatch.from_arrays([batch.column(_BODY), batch.column(_K), pa.array(rows, pa.list_(pa.int64()))], names=[_BODY, _K, "moves"])

    return run


def _beginnings(tools: _Tools):
    then = tools.then

    def run(table: pa.Table) -> pa.Table:
        """The state and depth in which each block of a body begins: products of the transitions before it."""
        table = table.sort_by(_K)
        so_far, state, depth = [0, 0, 1, 0, 2, 0, 3, 0], [], []
        for moves in table.column("moves").to_pylist():
            state.append(so_far[0])
            depth.append(so_far[1])
            so_far = then(so_far, moves)
        return pa.table({_BODY: table.column(_BODY), _K: table.column(_K), "state": pa.array(state, pa.int64()), "depth": pa.array(depth, pa.int64())})

    return run


def _pieces(tools: _Tools):
    """Each block cut at its commas: its pieces with their places, and how many cuts it has."""
    import numpy as np

    scan = tools.scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, count = [], []
            for data, state, base in zip(*(batch.column(c).to_pylist() for c in ("__bytes", "state", "depth"))):
                b, inside, depth, _ = scan(data, np.zeros(1, np.int64), state >= 2, state % 2 == 1)
                at = np.flatnonzero((b == 44) & ~inside & (depth + base == 0)).tolist()
                pieces.append([data[a:e] for a, e in zip([0, *(x + 1 for x in at)], [*at, len(data)])])
                count.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(_BODY), batch.column(_K), pa.array(pieces, pa.list_(pa.binary())), pa.array(count, pa.int64())], names=[_BODY, _K, "pieces", "cuts"])

    return run


def _judged(tools: _Tools):
    valid, space = tools.valid, SPACE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [x.decode("utf-8", "replace").strip(space) for x in batch.column("element").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(_BODY), batch.column("idx"), pa.array(text, pa.string()), pa.array([valid(x) for x in text], pa.bool_())], names=[_BODY, "idx", "element", "good"])

    return run


def split_large(bodies: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(elements (__body, idx, element), refused (__body)) of bodies (__body, __inner): the bytes between an array's
    brackets, not empty. A body's blocks are spread over tasks."""
    tools = _Tools()
    size = F.octet_length("__inner")
    slices = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda k: F.substring(F.col("__inner"), k * block + 1, F.lit(block)))
    blocks = cut(bodies.select(_BODY, F.posexplode(slices).alias(_K, "__bytes")).repartition(_BODY, _K))
    moves = blocks.mapInArrow(_summaries(tools), f"{_BODY} bigint, {_K} int, moves array<bigint>")
    begin = moves.groupBy(_BODY).applyInArrow(_beginnings(tools), f"{_BODY} bigint, {_K} int, state bigint, depth bigint")
    found = cut(blocks.join(begin, [_BODY, _K]).mapInArrow(_pieces(tools), f"{_BODY} bigint, {_K} int, pieces array<binary>, cuts bigint"))
    counted = running_sum(found.select(_BODY, _K, "cuts"), [_BODY], [_K], F.lit(0), {"through": F.col("cuts")})
    placed = found.drop("cuts").join(counted, [_BODY, _K]).select(
        _BODY, _K, "cuts", F.posexplode("pieces").alias("j", "piece"), (F.col("through") - F.col("cuts")).alias("offset"))
    inner = (F.col("j") > 0) & (F.col("j") < F.col("cuts"))
    numbered = placed.select(_BODY, _K, (F.col("offset") + F.col("j")).alias("idx"), "piece", inner.alias("whole"))
    joined = numbered.filter(~F.col("whole")).groupBy(_BODY, "idx").agg(
        F.array_sort(F.collect_list(F.struct(_K, "piece"))).alias("all")
    ).select(_BODY, "idx", F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("element"))
    every = numbered.filter("whole").select(_BODY, "idx", F.col("piece").alias("element")).unionByName(joined)
    judged = cut(every.mapInArrow(_judged(tools), f"{_BODY} bigint, idx bigint, element string, good boolean"))
    # Blanks between the brackets are an array without elements.
    many = judged.groupBy(_BODY).agg(F.count(F.lit(1)).alias("n"), F.bool_and("good").alias("fine"), F.bool_and(F.col("element") == "").alias("blank"))
    empty = (F.col("n") == 1) & F.col("blank")
    refused = many.filter(~F.col("fine") & ~empty).select(_BODY)
    kept = many.filter(F.col("fine") & ~empty).select(_BODY)
    return judged.join(kept, _BODY, "left_semi").select(_BODY, "idx", "element"), refused


def split_arrays(captures: DataFrame, body: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(elements, rest): an element per row with its ``idx``, and the rows whose body is no valid array, as they were.

    Other columns are kept. Bodies up to a block are cut where they are; larger ones by ``split_large``.
    """
    others = [x for x in captures.columns if x != body]
    text = F.btrim(F.coalesce(F.col(body), F.lit("")), F.lit(SPACE))
    array = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")) & (F.octet_length(text) >= 2)
    bracketed = captures.filter(array)
    rest = captures.filter(~array)
    inner = lambda t: F.substring(t.cast("binary"), F.lit(2), F.octet_length(t) - 2)
    tools = _Tools()
    small = bracketed.filter(F.octet_length(text) <= block + 2)
    schema = T.StructType([*(captures.schema[x] for x in [*others, body]), T.StructField("__parts", T.ArrayType(T.StringType()))])
    parted = small.select(*others, body, inner(text).alias("__inner")).mapInArrow(_small(tools), schema)
    elements = parted.filter("__parts is not null").select(*others, F.posexplode("__parts").alias("idx", "element")).withColumn("idx", F.col("idx").cast("bigint"))
    rejects = rest.select(*others, body).unionByName(parted.filter("__parts is null").select(*others, body))
    large = bracketed.filter(F.octet_length(text) > block + 2)
    # Numbered once and written, so that every later step sees the same numbers.
    numbered = cut(large.select(*others, body, F.monotonically_increasing_id().alias(_BODY)))
    if numbered.isEmpty():
        return elements, rejects
    pieces, refused = split_large(numbered.select(_BODY, inner(F.btrim(F.col(body), F.lit(SPACE))).alias("__inner")), block)
    more = pieces.join(numbered.drop(body), _BODY).select(*others, "idx", "element")
    return elements.unionByName(more), rejects.unionByName(numbered.join(refused, _BODY, "left_semi").select(*others, body))
