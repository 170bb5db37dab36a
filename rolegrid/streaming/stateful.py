"""Keyed state over event streams: the run ledger and the per-sweep failure breaker.

Both answers depend on the events alone, not on the order or the micro-batches they arrive in: state keeps what a
late event could still change, and every merge of state is commutative. The batch twins give the same rows
from a table of the same events. Rows of one key in one micro-batch are folded chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolegrid.operators.merge import fold_runs
from rolegrid.operators.runs import stop_point

STALE_TEXT = "interrupted by restart"
CANCEL_TEXT = "cancelled by user"
# The columns of a run row and their types, as the ledger of finished runs has them.
COUNTS = ["items_found", "items_inserted", "items_updated", "items_wrong", "items_unverifiable"]
LEDGER_OUT = (
    "run_id bigint, platform_id bigint, company_id bigint, started_at timestamp, finished_at timestamp, status string, "
    + ", ".join(f"{n} bigint" for n in COUNTS) + ", error_text string, dry_run boolean"
)
BREAKER_OUT = "sweep_id bigint, stop_at bigint, reason string"

_START = ["platform_id", "company_id"]
_FINISH = ["status", *COUNTS, "error_text"]



def _keyed(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, times: str) -> DataFrame:
    """Several states per key need the RocksDB store. A stream that runs on from a checkpoint keeps the store it has."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "Update", times)


# --- run ledger ---------------------------------------------------------------------------------


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _plain(value: Any):
    """A cell of a pandas row: numbers are whole, though a column with nulls holds them as floats."""
    return None if value is None or pd.isna(value) else value if isinstance(value, str) else int(value)


class RunLedger(StatefulProcessor):
    """State of a run: its first start, last finish and first cancel by (at, seq), whether any start was a dry
    run, and whether the watermark has passed its deadline."""

    def __init__(self, stale_ms: int):
        self.stale_us = stale_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "at bigint, seq bigint, platform_id bigint, company_id bigint, dry_run boolean")
        self.finish = handle.getValueState("finish", "at bigint, seq bigint, status string, " + ", ".join(f"{n} bigint" for n in COUNTS) + ", error_text string")
        self.cancel = handle.getValueState("cancel", "at bigint")
        self.overdue = handle.getValueState("overdue", "since bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self._row(key[0])
        start, finish, cancel = self.start.get(), self.finish.get(), self.cancel.get()
        for chunk in rows:
            chunk = chunk.sort_values(["at", "seq"], kind="stable")
            starts, ends, cancels = (chunk[chunk["kind"] == k] for k in ("start", "finish", "cancel"))
            if len(starts):
                r, dry = starts.iloc[0], bool(starts["dry_run"].fillna(False).astype(bool).any())
                at = (_micros(r["at"]), int(r["seq"]))
                dry = dry or bool(start and start[4])
                start = (*at, *(_plain(r[n]) for n in _START), dry) if start is None or at < tuple(start[:2]) else (*start[:4], dry)
            if len(ends):
                r = ends.iloc[-1]
                at = (_micros(r["at"]), int(r["seq"]))
                if finish is None or at > tuple(finish[:2]):
                    finish = (*at, *(_plain(r[n]) for n in _FINISH))
            if len(cancels):
                at = _micros(cancels["at"].iloc[0])
                cancel = (at if cancel is None else min(at, cancel[0]),)
        for state, value in ((self.start, start), (self.finish, finish), (self.cancel, cancel)):
            if value is not None:
                state.update(tuple(value))
        if start is not None and finish is None:
            due = self._deadline(start) // 1000
            passed = timerValues.getCurrentWatermarkInMs()
            for timer in list(self.handle.listTimers()):
                if timer != due:
                    self.handle.deleteTimer(timer)
            if due <= passed:
                self.overdue.update((due,))
            else:
                self.handle.registerTimer(due)
        after = self._row(key[0])
        if after is not None and after != before:
            yield _frame(after)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self._row(key[0])
        self.overdue.update((expiredTimerInfo.getExpiryTimeInMs(),))
        after = self._row(key[0])
        if after != before:
            yield _frame(after)

    def close(self) -> None:
        pass

    def _deadline(self, start) -> int:
        return start[0] + self.stale_us

    def _row(self, run_id: int) -> tuple | None:
        """The run's row from its state, None before its first event."""
        start, finish, cancel = self.start.get(), self.finish.get(), self.cancel.get()
        if start is None and finish is None and cancel is None:
            return None
        head = (run_id, start and start[2], start and start[3], start and start[0])
        dry = bool(start and start[4])
        if finish is not None:
            return (*head, finish[0], finish[2], *(n or 0 for n in finish[3:8]), finish[8], dry)
        due = self._deadline(start) if start is not None else None
        late = due is not None and (self.overdue.get() is not None or (cancel is not None and cancel[0] >= due))
        if late and (cancel is None or cancel[0] >= due):
            return (*head, due, "error", *[0] * 5, STALE_TEXT, dry)
        if cancel is not None and start is not None:
            return (*head, cancel[0], "error", *[0] * 5, CANCEL_TEXT, dry)
        return (*head, None, "running", *[0] * 5, None, dry)


def _frame(row: tuple) -> pd.DataFrame:
    names = [x.split()[0] for x in LEDGER_OUT.split(", ")]
    out = pd.DataFrame([row], columns=names)
    for n in ("started_at", "finished_at"):
        out[n] = pd.to_datetime(out[n], unit="us")
    for n in ("platform_id", "company_id"):
        out[n] = out[n].astype("Int64")
    return out


def run_ledger(events: DataFrame, stale_after: str = "6 hours", lateness: str = "10 minutes") -> DataFrame:
    """One row per change of a run: running, then ok or error. The newest row of a run is its state.

    events(run_id, kind start|finish|cancel, at, seq, platform_id, company_id, status, items_found, items_inserted, items_updated,
    items_wrong, items_unverifiable, error_text, dry_run). By (at, seq) the first start and the last finish rule, as in
    ``fold_runs``; a cancel stops a started run that has no finish and is not overdue at that time; a run with neither by ``stale_after``
    after its start (event time) ends as an error then, which is what a restart would have done to it. A finish
    that arrives later mends the row. Events later than ``lateness`` behind the newest one are dropped by the watermark.
    """
    stale_ms = int(pd.Timedelta(stale_after).total_seconds() * 1000)
    return _keyed(events.withWatermark("at", lateness), "run_id", RunLedger(stale_ms), LEDGER_OUT, "EventTime")


def run_ledger_batch(events: DataFrame, until: Column, stale_after: str = "6 hours") -> DataFrame:
    """The ledger of a table of events, at the watermark ``until``: one row per run, equal to the newest row of
    ``run_ledger`` once it has seen the same events and that watermark."""
    stale = F.expr(f"INTERVAL {stale_after}")
    folded = fold_runs(events)
    cancels = events.filter("kind = 'cancel'").groupBy("run_id").agg(F.min("at").alias("__cancel"))
    joined = folded.join(cancels, "run_id", "left")
    due = F.col("started_at") + stale
    open_ = (F.col("status") == "running") & F.col("started_at").isNotNull()
    late = open_ & ((due <= until) | (F.col("__cancel") >= due)) & (F.col("__cancel").isNull() | (F.col("__cancel") >= due))
    stopped = open_ & ~late & F.col("__cancel").isNotNull()
    return joined.select(
        "run_id", "platform_id", "company_id", "started_at",
        F.when(late, due).when(stopped, F.col("__cancel")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(late | stopped, F.lit("error")).otherwise(F.col("status")).alias("status"), *COUNTS,
        F.when(late, F.lit(STALE_TEXT)).when(stopped, F.lit(CANCEL_TEXT)).otherwise(F.col("error_text")).alias("error_text"), "dry_run",
    )


# --- failure breaker ----------------------------------------------------------------------------

# A gap-free range of a sweep's sequence: (low, high, failures from low on, failures up to high, first stop or None,
# whether that stop was a dead host).
Range = tuple[int, int, int, int, int | None, bool]


def join_ranges(a: Range, b: Range, stop_after: int) -> Range:
    """The summary of two ranges side by side, a before b. Associative."""
    whole_a, whole_b = a[1] - a[0] + 1, b[1] - b[0] + 1
    need = stop_after - a[3]
    stops = [(x[4], not x[5]) for x in (a, b) if x[4] is not None]
    if stop_after > 0 and 0 < need <= b[2]:  # a streak that runs over the border
        stops.append((b[0] + need - 1, True))
    first = min(stops, default=(None, True))
    return (a[0], b[1], a[2] if a[2] < whole_a else whole_a + b[2], b[3] if b[3] < whole_b else whole_b + a[3], first[0], not first[1])


def join_all(ranges: Iterable[Range], stop_after: int) -> list[Range]:
    """Ranges with those that touch joined. Of two that overlap (a row delivered again) the wider one stays."""
    out: list[Range] = []
    for r in sorted(ranges, key=lambda r: (r[0], -r[1])):
        if out and r[1] <= out[-1][1]:
            continue
        if out and r[0] == out[-1][1] + 1:
            out[-1] = join_ranges(out[-1], r, stop_after)
        else:
            out.append(r)
    return out


def summarise(seq: np.ndarray, ok: np.ndarray, down: np.ndarray, stop_after: int) -> list[Range]:
    """Gap-free ranges of rows in ascending order of distinct sequence numbers."""
    out: list[Range] = []
    place = np.arange(len(seq))
    for part in np.split(place, np.flatnonzero(np.diff(seq) != 1) + 1):
        good, at = ok[part], np.arange(len(part))
        since = np.maximum.accumulate(np.where(good, at, -1))
        hit = np.flatnonzero(down[part] | ((stop_after > 0) & ~good & (at - since >= stop_after)))
        lead = int(np.argmax(good)) if good.any() else len(part)
        stop = (int(seq[part[hit[0]]]), bool(down[part[hit[0]]])) if len(hit) else (None, False)
        out.append((int(seq[part[0]]), int(seq[part[-1]]), lead, int(at[-1] - since[-1]), *stop))
    return out


class Breaker(StatefulProcessor):
    """State of a sweep: one summary per gap-free range of the sequence numbers seen. As gaps fill, ranges join, so
    state follows the gaps, not the rows."""

    def __init__(self, stop_after: int):
        self.stop_after = stop_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getMapState("ranges", "low bigint", "high bigint, lead bigint, trail bigint, stop bigint, down boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [(k[0], *v) for k, v in self.ranges.iterator()]
        now = held
        for chunk in rows:
            chunk = chunk.sort_values("seq", kind="stable").drop_duplicates("seq")
            seq = chunk["seq"].to_numpy(np.int64)
            # A row delivered again lies inside a range that has it.
            fresh = np.ones(len(seq), bool)
            for low, high, *_ in now:
                fresh &= (seq < low) | (seq > high)
            if fresh.any():
                ok, down = (chunk[c].fillna(False).to_numpy(bool)[fresh] for c in ("ok", "host_down"))
                now = join_all([*now, *summarise(seq[fresh], ok, down, self.stop_after)], self.stop_after)
        for r in set(held) - set(now):
            self.ranges.removeKey((r[0],))
        for r in set(now) - set(held):
            self.ranges.updateValue((r[0],), r[1:])
        was, stop = self._stop(held), self._stop(now)
        if stop is not None and stop != was:
            yield pd.DataFrame({"sweep_id": [key[0]], "stop_at": [stop[0]], "reason": ["host_down" if stop[1] else "failures"]})

    @staticmethod
    def _stop(ranges: list[Range]) -> tuple[int, bool] | None:
        return min(((r[4], r[5]) for r in ranges if r[4] is not None), default=None)

    def close(self) -> None:
        pass


def failure_breaker(outcomes: DataFrame, stop_after: int) -> DataFrame:
    """One row per sweep when it has to stop: ``stop_after`` failures in a row, or the host is down; another row with
    a smaller ``stop_at`` when late rows show that it had to stop before. The smallest is the answer.

    outcomes(sweep_id, seq, ok, host_down): seq counts a sweep's companies without gaps, whatever it starts from and in
    whatever order rows arrive. Only failures at neighbouring numbers make a streak, so a gap never hides a success.
    """
    return _keyed(outcomes, "sweep_id", Breaker(stop_after), BREAKER_OUT, "None")


def failure_breaker_batch(outcomes: DataFrame, stop_after: int, by: Column | None = None) -> DataFrame:
    """The sweeps of a table of outcomes that have to stop, with their reason: the last answer of ``failure_breaker``
    on the same rows."""
    stops = stop_point(outcomes, "sweep_id", "seq", stop_after, by).filter(F.col("stop_at").isNotNull())
    rows = outcomes.select("sweep_id", F.col("seq").alias("stop_at"), F.coalesce("host_down", F.lit(False)).alias("__down"))
    return stops.join(rows, ["sweep_id", "stop_at"]).select("sweep_id", "stop_at", F.when(F.col("__down"), "host_down").otherwise("failures").alias("reason"))
