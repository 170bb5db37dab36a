"""Lines of text files with their numbers, and lines of files that are still being written.

``read_lines`` numbers the lines of every file, whatever splits it is read in: the scan gives each line its split and its
place in the task, splits are counted, and a running sum over a file's splits carries the counts on.

``growing_lines`` is a streaming source over a folder of growing files. Its offset is the size of every file, so a
stream goes on inside a file. Ranges of new bytes are dealt to tasks; a line belongs to the range that has its line feed, which
looks back for where it began. A line without a line feed is not there yet. ``seq`` is the byte a line begins at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rolegrid.operators.scans import bucket, running_sum
from rolegrid.session import cut

SOURCE = "growing_lines"
RANGE_BYTES = 8 << 20
OPEN_COST = 1 << 16
_LOOK_BACK = 1 << 16


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of all files under a path; line_no counts a file's lines from 1, blank ones too."""
    scanned = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        # Rows of a split stand side by side in one task.
        F.monotonically_increasing_id().alias("at"), "value")
    # Written once: counts and lines are of the same reading, also of a file that grows meanwhile.
    lines = cut(scanned)
    splits = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    counted = running_sum(splits, ["path"], ["block"], bucket("block", 1 << 40), {"through": F.col("n")})
    # One row per split, written, so that its size is known where it is joined.
    before = cut(counted.select("path", "block", (F.col("through") - F.col("n") - F.col("first") + 1).alias("shift")))
    return lines.join(before, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line_no"), "value")


@dataclass
class ByteRanges(InputPartition):
    """(path, start, end) of the new bytes that one task reads: a part of a large file, or all of many small ones."""

    ranges: list[tuple[str, int, int]]


def pack(ranges: Iterator[tuple[str, int, int]], size: int, open_cost: int) -> list[ByteRanges]:
    """Ranges in order, as many together as ``size`` bytes hold when each costs ``open_cost`` more."""
    out: list[ByteRanges] = []
    filled = size
    for path, start, end in ranges:
        cost = end - start + open_cost
        if filled + cost > size:
            out.append(ByteRanges([]))
            filled = 0
        out[-1].ranges.append((path, start, end))
        filled += cost
    return out


def _store(path: str):
    """(file system, path in it) of a folder or file: local, or any that pyarrow reaches by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_lines(rows: DataFrame, path: str, suffix: str = "") -> int:
    """One file ``<name><suffix>`` in a folder for each name of rows (name, at, value): its values in the order of ``at``, a
    line each. A task holds one file open at a time. Returns the number of files."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder)
        name, out, files = None, None, 0
        for part in parts:
            names, values = part.column(0).to_pylist(), part.column(1).to_pylist()
            starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if out is None or names[a] != name:
                    if out is not None:
                        out.close()
                    name, out, files = names[a], store.open_output_stream(f"{folder}/{names[a]}{suffix}"), files + 1
                out.write("".join(f"{v or ''}\n" for v in values[a:b]).encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    spread = rows.select(F.col("name").cast("string"), "at", "value").repartition("name").sortWithinPartitions("name", "at")
    return spread.select("name", "value").mapInArrow(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def ended_lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines whose line feed is in [start, end)."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        begin = start
        while begin > 0:  # back to the byte after the line feed before start
            low = max(0, begin - _LOOK_BACK)
            f.seek(low)
            at = f.read(begin - low).rfind(b"\n")
            begin = low + at + 1 if at >= 0 else low
            if at >= 0:
                break
        f.seek(begin)
        held, at = b"", begin
        while at + len(held) < end:
            more = f.read(min(1 << 20, end - at - len(held)))
            if not more:
                break
            held += more
            *whole, rest = held.split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1
            held = rest


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return {scheme + f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        step = self.range_bytes
        fresh = ((path, a, min(a + step, size)) for path, size in sorted(end.items()) for a in range(start.get(path, 0), size, step))
        return pack(fresh, step, OPEN_COST)

    def read(self, partition: ByteRanges) -> Iterator[tuple]:
        for path, start, end in partition.ranges:
            for seq, line in ended_lines(path, start, end):
                yield path, seq, line.removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "path string, seq bigint, value string"

    def streamReader(self, schema) -> GrowingLinesReader:  # noqa: N802
        return GrowingLinesReader(self.options)


def tail_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Stream of (path, seq, value): the lines of a folder's files as they are finished, in order of seq per file."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(SOURCE).option("path", path).option("suffix", suffix).option("rangeBytes", str(range_bytes)).load()
