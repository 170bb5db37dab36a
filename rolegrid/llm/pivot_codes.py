"""Vector codes: each part of a vector as the number of its nearest codebook entry, found with LAESA pivots.

Vectors become integers (``vectors.integers``) and are cut into equal consecutive parts, each with a codebook of its
own. The codebooks start from the vectors with the smallest ids and are moved by exact integer means for a fixed number
of rounds.

The search is LAESA: some codebook entries are chosen once as fixed pivots, and every part's distances to the pivots of
its position are measured once and written. In each round the distances of the entries to the same pivots are measured;
``|d(part, pivot) - d(entry, pivot)|``, the largest over the pivots, bounds the part's distance to an entry from below.
Entries are tried in the order of their bounds with exact integer distances, until the next bound exceeds the
best distance. Bounds are lowered by more than their rounding, so nearest entries and ties are exact.

The codebooks, ``parts x entries`` cells, are the only data that pass the driver; cells are summed per task before the
shuffle, so a vector that fills a third of the rows costs what others cost.

Edge cases: rows whose vector is null or has null or non-finite components are dropped. The vectors' length is the
one most rows have (the longest of several); vectors of another length are returned without code and error. A length
that ``parts`` does not divide is an error. With fewer vectors than entries each vector seeds an entry; repeated ids
and vectors count as often as they come, equal ids in the order of their vectors, null ids last. Null labels
belong together. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.shared import stash
from rolegrid.llm.vectors import dimension, integer_vectors, lists, matrix

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
_ROWS = 2048


def choose_pivots(book: np.ndarray, pivots: int) -> np.ndarray:
    """Entries far from each other: each next one has the largest sum of distances to those before."""
    far = np.sqrt(((book[:, None] - book[None]) ** 2).sum(axis=2).astype(np.float64))
    chosen, total = [0], far[0].copy()
    while len(chosen) < min(pivots, len(book)):
        total[chosen] = -1
        chosen.append(int(total.argmax()))
        total = np.where(total < 0, total, total + far[chosen[-1]])
    return book[chosen]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances, points x others."""
    return np.sqrt(((points[:, None] - others[None]) ** 2).sum(axis=2).astype(np.float64))


def nearest(points: np.ndarray, near: np.ndarray, book: np.ndarray, book_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, squared distance, entries tried) per point. near, book_near: distances to the pivots."""
    bound = np.abs(near[:, None] - book_near[None]).max(axis=2)
    # Each distance is off by less than two units in its last place.
    bound -= 4 * np.finfo(np.float64).eps * (near.max(axis=1)[:, None] + book_near.max())
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) * (1 - 1e-12)
    best, who, tried = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(book)), np.zeros(len(points), np.int64)
    open_ = np.arange(len(points))
    for k in range(len(book)):
        entry = order[open_, k]
        exact = ((points[open_] - book[entry]) ** 2).sum(axis=1)
        tried[open_] += 1
        better = (exact < best[open_]) | ((exact == best[open_]) & (entry < who[open_]))
        best[open_[better]], who[open_[better]] = exact[better], entry[better]
        if k + 1 < len(book):
            open_ = open_[bound[open_, k + 1] <= np.sqrt(best[open_])]
            if not len(open_):
                break
    return who, best, tried


class Codebooks:
    """The codebooks (position, entry, component) with their fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.near = [distances(e, p) for e, p in zip(entries, pivots)]

    @staticmethod
    def from_seeds(seeds: np.ndarray, parts: int, pivots: int) -> Codebooks:
        entries = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)
        return Codebooks(entries, np.array([choose_pivots(e, pivots) for e in entries]))

    def moved(self, cells: list) -> Codebooks:
        """Entries replaced by the floor of their parts' means. cells: (cell, at, total, n)."""
        entries = self.entries.copy()
        flat = entries.reshape(-1, entries.shape[2])
        for cell, at, total, n in cells:
            flat[cell, at] = total // n
        return Codebooks(entries, self.pivots)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def measure(self, x: np.ndarray) -> np.ndarray:
        """Distances of each vector's parts to their pivots, positions side by side."""
        cut = x.reshape(len(x), len(self.entries), -1)
        return np.concatenate([distances(cut[:, p], self.pivots[p]) for p in range(len(self.entries))], axis=1)

    def assign(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, squared distances, entries tried), vectors x positions."""
        parts = len(self.entries)
        cut, close = x.reshape(len(x), parts, -1), near.reshape(len(x), parts, -1)
        found = [nearest(cut[:, p], close[:, p], self.entries[p], self.near[p]) for p in range(parts)]
        return tuple(np.array(f).T for f in zip(*found))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _measured(books: Codebooks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            near = books.measure(matrix(batch.column("x"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(near)], names=[*batch.schema.names, "near"])

    return run


def _cells(books: Codebooks, dim: int):
    """Sums and counts of the parts by the cell they fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in _slices(batches):
            x = matrix(batch.column("x"), dim)
            code = books.assign(x, matrix(batch.column("near"), books.pivots.shape[0] * books.pivots.shape[1]))[0]
            cell = (code + np.arange(parts) * entries).ravel()
            np.add.at(total, cell, x.reshape(-1, width))
            count += np.bincount(cell, minlength=len(count))
        used = np.flatnonzero(count)
        cell, at = (a.ravel() for a in np.meshgrid(used, np.arange(width), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(total[cell, at]), pa.array(count[cell])], names=["cell", "at", "total", "n"])

    return run


def _coded(books: Codebooks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            code, error, tried = books.assign(matrix(batch.column("x"), dim), matrix(batch.column("near"), books.pivots.shape[0] * books.pivots.shape[1]))
            text = pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["vec_id", "label"]).columns, text, pa.array(error.sum(axis=1)), pa.array(tried.sum(axis=1))], names=["vec_id", "label", "code", "error", "tried"])

    return run


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, label, code, error, tried, label_error, codebooks_sha256) of rows (vec_id, embedding, label).

    code: two hex digits per part. tried: exact distances counted for the row in the last assignment.
    At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    held = integer_vectors(rows, "vec_id", "label")
    dim = dimension(held)
    if dim % parts and dim > 0:
        raise ValueError(f"{parts} parts do not divide vectors of {dim}")
    fields = {f.name: f.dataType for f in held.schema.fields}
    schema = T.StructType([T.StructField("vec_id", fields["vec_id"]), T.StructField("label", fields["label"]), T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType()), T.StructField("tried", T.LongType())])
    if dim <= 0:
        blank = held.select("vec_id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("tried"))
        return blank.withColumns({"label_error": F.lit(0).cast("bigint"), "codebooks_sha256": F.lit(hashlib.sha256(b"").hexdigest())})
    fit = held.where(F.size("x") == dim)
    seeds = fit.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = Codebooks.from_seeds(np.array([r["x"] for r in seeds], np.int64), parts, pivots)
    measured = stash(fit.mapInArrow(_measured(books, dim), T.StructType([*fit.schema.fields, T.StructField("near", T.ArrayType(T.DoubleType()))])), "pivot-distances")
    for _ in range(rounds):
        cells = measured.mapInArrow(_cells(books, dim), "cell bigint, at bigint, total bigint, n bigint").groupBy("cell", "at").agg(F.sum("total"), F.sum("n"))
        books = books.moved(cells.collect())
    coded = measured.mapInArrow(_coded(books, dim), schema)
    other = held.where(F.size("x") != dim).select("vec_id", "label", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[2:]])
    coded = stash(coded.unionByName(other), "codes")
    # Written, so that its size is known: few labels are broadcast, many meet in a join that splits hot labels.
    errors = stash(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(books.digest()))
