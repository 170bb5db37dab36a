"""State tables in slots: a write rewrites the slots it touches and nothing else.

A row's slot is a hash of its scope (what staleness closes by) and of its natural key, so the rows of one key are in
one slot, those of one scope in one group of slots, and a hot scope is still many slots. A version is a manifest that
names for every slot the version that wrote it; versions share the slots they did not write:

    root/data/v=<version>/slot=<slot>/   rows of a slot as that version wrote them; a merge adds what it did to each
    root/manifest/v=<version>/           (slot, written, rows, top) of every slot

The manifest is written last, so a version is there whole or not at all, and writing a version again replaces it. Only
slot numbers and manifests pass the driver: at most ``groups x parts`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.functions.base import ColumnOrName
from rolegrid.operators import merge

SLOT = "slot"
MANIFEST = "slot int, written bigint, rows bigint, top bigint"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return bool(fs.exists(where))


@dataclass(frozen=True)
class Layout:
    """How rows are dealt to slots. ``key``: the natural key; ``scope``: its part that staleness closes by;
    ``ids``: a numeric id column whose highest value the manifest keeps."""

    key: tuple[str, ...]
    scope: tuple[str, ...] = ()
    ids: str | None = None
    groups: int = 16
    parts: int = 16

    def group(self) -> Column:
        return F.pmod(F.xxhash64(*self.scope), F.lit(self.groups)).cast("int") if self.scope else F.lit(0)

    def slot(self) -> Column:
        return (self.group() * self.parts + F.pmod(F.xxhash64(*self.key), F.lit(self.parts))).cast("int")

    def of_groups(self, groups: Iterable[int]) -> set[int]:
        return {g * self.parts + p for g in groups for p in range(self.parts)}


class SlotTable:
    def __init__(self, spark: SparkSession, root: str, layout: Layout):
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout

    # --- reading ---

    def latest(self, below: int | None = None) -> int:
        """The newest complete version (below a given one), -1 where there is none."""
        found = [int(n[2:]) for n in children(self.spark, f"{self.root}/manifest") if n.startswith("v=")]
        done = [v for v in found if (below is None or v < below) and exists(self.spark, f"{self.root}/manifest/v={v}/_SUCCESS")]
        return max(done, default=-1)

    def manifest(self, version: int | None = None) -> list:
        """(slot, written, rows, top) per slot."""
        v = self._version(version)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={v}").collect()

    def top(self, version: int | None = None) -> Column:
        """The highest id of a version, 0 without rows."""
        return F.lit(max((m["top"] for m in self.manifest(version) if m["top"] is not None), default=0)).cast("bigint")

    def read(self, slots: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version with their ``slot``; only files of the given slots are listed and read."""
        wanted = None if slots is None else set(slots)
        held = [m for m in self.manifest(version) if wanted is None or m["slot"] in wanted]
        schema = T.StructType.fromJson(self._schema())
        if not held:
            return self.spark.createDataFrame([], schema.add(SLOT, T.IntegerType()))
        paths = [f"{self.root}/data/v={m['written']}/slot={m['slot']}" for m in held]
        whole = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField(SLOT, T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/data").parquet(*paths).drop("v")

    def rows(self, version: int | None = None) -> DataFrame:
        """The whole table of a version."""
        return self.read(version=version).drop(SLOT)

    # --- writing ---

    def create(self, rows: DataFrame) -> int:
        """Version 0 from all rows."""
        if "v" in rows.columns:
            raise ValueError("v is the name of a folder level")
        self.spark.createDataFrame([(rows.drop(SLOT).schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema")
        return self._commit(0, rows, [])

    def replace(self, rows: DataFrame, slots: Iterable[int], base: int, version: int) -> int:
        """A version in which ``rows`` are all rows of ``slots`` and the other slots are those of ``base``. Columns of ``rows``
        that the table does not have are kept for ``written`` only."""
        touched = set(slots)
        return self._commit(version, rows, [m for m in self.manifest(base) if m["slot"] not in touched])

    def written(self, version: int, like: DataFrame) -> DataFrame:
        """The rows that a version wrote, in the columns of ``like``, from which it was written."""
        schema = T.StructType([*like.schema.fields, T.StructField(SLOT, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/v={version}").select(*like.columns)

    def keep(self, base: int, version: int) -> int:
        """A version without a change: a manifest and no data."""
        self._write_manifest(version, self.manifest(base))
        return version

    def slots_of(self, rows: DataFrame) -> set[int]:
        """The slots that rows fall in."""
        return {r[0] for r in rows.select(self.layout.slot()).distinct().collect()}

    def slots_of_scopes(self, rows: DataFrame) -> set[int]:
        """All slots of the scopes of rows."""
        return self.layout.of_groups(r[0] for r in rows.select(self.layout.group()).distinct().collect())

    def vacuum(self, keep_from: int) -> int:
        """Delete slots that no version from ``keep_from`` on names, and older manifests. Returns how many."""
        versions = [int(n[2:]) for n in children(self.spark, f"{self.root}/manifest")]
        live = {(m["written"], m["slot"]) for v in versions if v >= keep_from for m in self.manifest(v)}
        gone = 0
        for folder in children(self.spark, f"{self.root}/data"):
            for name in children(self.spark, f"{self.root}/data/{folder}") if folder.startswith("v=") else []:
                if name.startswith("slot=") and int(folder[2:]) < keep_from and (int(folder[2:]), int(name[5:])) not in live:
                    self._delete(f"data/{folder}/{name}")
                    gone += 1
        for v in versions:
            if v < keep_from:
                self._delete(f"manifest/v={v}")
                self._delete(f"changes/v={v}")  # written beside the data before
        return gone

    # --- inside ---

    def _version(self, version: int | None) -> int:
        v = self.latest() if version is None else version
        if v < 0:
            raise ValueError(f"no version under {self.root}: create the table first")
        return v

    def _schema(self) -> dict:
        import json

        return json.loads(self.spark.read.schema("schema string").parquet(f"{self.root}/schema").first()[0])

    def _delete(self, path: str) -> None:
        fs, where = _files(self.spark, f"{self.root}/{path}")
        fs.delete(where, True)

    def _commit(self, version: int, rows: DataFrame, others: list) -> int:
        self._delete(f"manifest/v={version}")
        data = f"{self.root}/data/v={version}"
        # Rebalanced by slot: few files per slot, and a slot that outgrows a task is split.
        dealt = rows.drop(SLOT).withColumn(SLOT, self.layout.slot()).hint("rebalance", SLOT)
        dealt.write.mode("overwrite").partitionBy(SLOT).parquet(data)
        written = []
        if any(n.startswith("slot=") for n in children(self.spark, data)):
            top = F.max(self.layout.ids) if self.layout.ids else F.lit(None)
            schema = T.StructType([*rows.drop(SLOT).schema.fields, T.StructField(SLOT, T.IntegerType())])
            stats = self.spark.read.schema(schema).parquet(data).groupBy(SLOT)
            written = stats.agg(F.lit(version).cast("bigint").alias("written"), F.count(F.lit(1)).alias("rows"), top.cast("bigint").alias("top")).collect()
        self._write_manifest(version, [*others, *written])
        return version

    def _write_manifest(self, version: int, entries: list) -> None:
        self.spark.createDataFrame([tuple(e) for e in entries], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")


# --- posting state --------------------------------------------------------------------------------

#: Postings: staleness closes by platform or by platform and company.
POSTINGS = Layout(key=tuple(merge.JOB_KEY), scope=("discovery_platform_id",), ids="job_id")
COMPANIES = Layout(key=("slug",), ids="company_id")


def closing_slots(table: SlotTable, observed: DataFrame, scope: list[str], base: int, now: ColumnOrName, but: set[int]) -> set[int]:
    """Slots of the observed scopes in which a row closes, without those in ``but``. Reads keys and status only."""
    there = table.slots_of_scopes(observed) - but
    if not there:
        return set()
    narrow = table.read(there, base).select(*dict.fromkeys([*table.layout.key, *scope]), "status", F.lit(None).cast("timestamp").alias("updated_at"), SLOT)
    return {r[0] for r in merge.mark_stale(narrow, observed, scope, now).filter("newly_closed").select(SLOT).distinct().collect()}


def merge_postings(
    table: SlotTable, batch: DataFrame, now: ColumnOrName, observed: DataFrame | None = None, scope: list[str] | None = None,
    base: int | None = None, version: int | None = None, ordinal: str | None = "ordinal",
) -> DataFrame:
    """Upsert a batch and close what its scopes no longer show, as one new version. Returns the rewritten rows with
    ``merge_action`` and ``newly_closed``.

    Read and written are the slots of the batch's keys and, of the observed scopes, those where a row closes;
    ``observed`` (scope and external_id; the batch's own keys by default) is the seen set. The scope starts with the
    layout's scope columns.
    """
    scope = scope or ["discovery_platform_id"]
    if tuple(scope[: len(table.layout.scope)]) != table.layout.scope:
        raise ValueError(f"a scope has to start with {', '.join(table.layout.scope)}")
    base = table.latest() if base is None else base
    version = base + 1 if version is None else version
    last = merge.last_wins(batch, merge.JOB_KEY, ordinal) if ordinal else batch
    if observed is None:
        # The batch's own keys: its rows are seen, unless the key is blank, and no other row is.
        seen = merge.observed_keys(batch, scope)
        last = last.withColumn(merge.SEEN, F.when(F.col("external_id") != "", F.lit(True)))
        flag = lambda rows: rows.withColumn(merge.SEEN, F.lit(None).cast("boolean"))
    else:
        # Looked up before the merge: by key, as the merge joins, so that merged rows need not move once more.
        seen = observed
        last = merge.flag_seen(last, seen, scope)
        flag = lambda rows: merge.flag_seen(rows, seen, scope)
    touched = table.slots_of(batch)
    closing = closing_slots(table, seen, scope, base, now, touched)
    flagged = merge.upsert_jobs(flag(table.read(touched, base).drop(SLOT)), last, now, ordinal=None, top=table.top(base))
    if closing:
        flagged = flagged.unionByName(flag(table.read(closing, base).drop(SLOT)).withColumn("merge_action", F.lit("kept")))
    out = merge.mark_stale(flagged, seen, scope, now)
    if not touched | closing:
        table.keep(base, version)
        return out
    table.replace(out, touched | closing, base, version)
    return table.written(version, out)


def moved_slots(table: SlotTable, change: Callable[[DataFrame], DataFrame], columns: list[str], base: int) -> DataFrame:
    """Slots with a row that the change moves. The change is aggregated, not filtered: a filter is pushed below it and
    evaluates it once per mention."""
    was = {f"__was_{c}": F.col(c) for c in columns}
    moved = ~F.struct(*columns).eqNullSafe(F.struct(*[F.col(w).alias(c) for w, c in zip(was, columns)]))
    seen = change(table.read(version=base).withColumns(was))
    return seen.groupBy(SLOT).agg(F.bool_or(moved).alias("moved")).filter("moved").select(SLOT)


def maintain(table: SlotTable, change: Callable[[DataFrame], DataFrame], columns: list[str], base: int | None = None) -> tuple[int, set[int]]:
    """Apply a row-wise change, which alters only ``columns``, to the whole table: (version, slots rewritten).

    A first pass reads the columns the change looks at and finds the slots with a row that moves; only those
    are written. Where none moves, no file is written and the version stays.
    """
    base = table.latest() if base is None else base
    slots = {r[0] for r in moved_slots(table, change, columns, base).collect()}
    if not slots:
        return base, slots
    held = table.read(slots, base)
    return table.replace(change(held).select(*held.columns), slots, base, base + 1), slots
