"""Streams against their batch twins."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolegrid.operators import logs, merge, runs, slots
from rolegrid.sources import lines
from rolegrid.streaming import ingest, stateful
from rolegrid.streaming import logs as slogs

T0 = datetime(2026, 1, 1)
LOG = "seq bigint, ts timestamp, level string, app string, msg string, run_id string, method string, status bigint, duration_ms bigint, line string"


@pytest.fixture
def log_dir(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=i), ["info", "error"][i % 2], "a", ["agent step", "listing stored", "summary"][i % 3], str(i % 2), ["GET", "POST"][i % 5 == 0], 200 if i % 4 else 500, i * 30, "x") for i in range(60)]
    df = spark.createDataFrame(rows, LOG)
    path = str(tmp_path / "logs")
    for part in range(3):
        df.filter(f"seq BETWEEN {part * 20} AND {part * 20 + 19}").coalesce(1).write.mode("append").parquet(path)
    return df, path


def drain(query_df, name, mode, tmp_path):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        q.stop()
    return query_df.sparkSession.sql(f"SELECT * FROM {name}")


def test_windowed_counts_match_batch(spark, log_dir, tmp_path):
    df, path = log_dir
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = drain(slogs.windowed_counts(stream, "level", "10 minutes"), "wc", "complete", tmp_path)
    want = slogs.windowed_counts(df, "level", "10 minutes")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 12


def test_notable_requests_match_batch(spark, log_dir, tmp_path):
    df, path = log_dir
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = drain(slogs.notable_stream(stream).select("seq", "why"), "nr", "append", tmp_path)
    assert sorted(got.collect()) == sorted(logs.notable(df).select("seq", "why").collect())


def test_run_sessions(spark, log_dir, tmp_path):
    df, path = log_dir
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(slogs.run_sessions(stream, "5 minutes"), "rs", "append", tmp_path).collect()
    # The last session is open until the watermark passes it; nothing but it may be missing.
    assert all(r["lines"] <= 30 for r in got)
    complete = drain(slogs.run_sessions(stream, "5 minutes"), "rs2", "complete", tmp_path).collect()
    assert {(r["run_id"], r["lines"]) for r in complete} == {("0", 30), ("1", 30)} and all(r["finished"] for r in complete)


def test_collector_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    line = lambda i: json.dumps({"level": "error", "app": "a", "svc": "s", "run_id": i})
    schema = "project string, line string"
    spark.createDataFrame([("p1", line(1)), ("other", line(2)), ("p1", "plain")], schema).coalesce(1).write.mode("append").json(src)
    for extra in (None, [("p1", line(3))]):
        if extra:
            spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").json(src)
        q = slogs.start_collector(spark.readStream.schema(schema).json(src), ["p1"], out, ck)
        q.awaitTermination(180)
        assert q.exception() is None
    got = spark.read.parquet(out)
    assert sorted((r["run_id"] or "-", r["level"] or "-") for r in got.collect()) == [("-", "-"), ("1", "error"), ("3", "error")]


def test_trace_tail_goes_on_inside_a_growing_file(spark, tmp_path):
    d, ck = tmp_path / "tr", str(tmp_path / "ck")
    d.mkdir()
    seen = []

    def follow():
        q = ingest.tail_traces(spark, str(d), ".jsonl").select("run_id", "seq", "event", "step").writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["run_id"], r["seq"], r["event"], r["step"]) for r in seen)

    (d / "5.jsonl").write_text('{"event":"step","step":1}\nnot json\n\n{"event":"st')
    (d / "note.txt").write_text('{"event":"done"}\n')
    assert follow() == [(5, 0, "step", 1)]
    with (d / "5.jsonl").open("a") as f:
        f.write('ep","step":2}\n{"event":"done","success":true}\n')
    (d / "6.jsonl").write_text("".join('{"event":"step","step":%d}\n' % k for k in range(50)))
    got = follow()
    assert got[:3] == [(5, 0, "step", 1), (5, 36, "step", 2), (5, 62, "done", None)]
    assert [(r[0], r[3]) for r in got[3:]] == [(6, k) for k in range(50)]
    assert follow() == got


def test_small_files_share_a_task_and_large_ones_are_split():
    ranges = [("a", 0, 5), ("b", 0, 5), ("c", 0, 100), ("c", 100, 110), ("d", 3, 4)]
    assert [p.ranges for p in lines.pack(iter(ranges), 100, 10)] == [ranges[:2], ranges[2:3], ranges[3:]]
    assert lines.pack(iter([]), 100, 10) == []


def test_ranges_of_bytes_give_every_ended_line_once(tmp_path):
    rng = random.Random(2)
    text = b"".join(bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 200]))) + b"\n" for _ in range(60)) + b"no end"
    path = tmp_path / "x.log"
    path.write_bytes(text)
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for size in (1, 2, 7, 64, 150, len(text)):
        got = [x for a in range(0, len(text), size) for x in lines.ended_lines(str(path), a, min(a + size, len(text)))]
        assert got == want


JOBS = "job_id bigint, company_id bigint, discovery_platform_id bigint, external_id string, title string, status string, raw_data string, first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp"
BATCH = "company_id bigint, discovery_platform_id bigint, external_id string, title string, raw_data string, ordinal bigint"


def test_posting_merge_per_batch(spark, tmp_path):
    root, src, ck = str(tmp_path / "state"), str(tmp_path / "src"), str(tmp_path / "ck")
    table = slots.SlotTable(spark, root, slots.Layout(key=slots.POSTINGS.key, scope=slots.POSTINGS.scope, ids="job_id", groups=4, parts=6))
    rows = [(k, 1, p, f"{p}-{k}", "A", "open", "r", T0, T0, T0, T0) for k, p in enumerate([1] * 3 + [2] * 60, 1)] + [(90, 1, 1, None, "N", "open", "r", T0, T0, T0, T0)]
    table.create(spark.createDataFrame(rows, JOBS))

    def step(rows):
        spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").json(src)
        q = ingest.start_posting_merge(spark.readStream.schema(BATCH).json(src), table, ck, lambda _: F.lit("2026-01-02").cast("timestamp"))
        q.awaitTermination(240)
        assert q.exception() is None
        return table.latest(), {r["external_id"]: (r["job_id"], r["title"], r["status"]) for r in table.rows().filter("discovery_platform_id = 1").collect()}

    v, got = step([(1, 1, "1-1", "A2", None, 1), (1, 1, "c", "C", None, 2)])
    assert v == 1 and got == {"1-1": (1, "A2", "open"), "1-2": (2, "A", "closed"), "1-3": (3, "A", "closed"), "c": (91, "C", "open"), None: (90, "N", "open")}
    written = {m["slot"] for m in table.manifest() if m["written"] == 1}
    assert written and len(written) <= 4  # of the slots of 64 rows
    files = sorted(p.name for p in (tmp_path / "state/data/v=0").rglob("*.parquet"))
    v, got = step([(1, 1, "1-2", "B2", None, 1)])
    assert v == 2 and got["1-1"] == (1, "A2", "closed") and got["1-2"] == (2, "B2", "open") and got["c"] == (91, "C", "closed")
    assert sorted(p.name for p in (tmp_path / "state/data/v=0").rglob("*.parquet")) == files
    assert table.rows().filter("discovery_platform_id = 2 AND status = 'open'").count() == 60
    # A batch that runs again writes the same version.
    before = sorted(table.rows().collect(), key=repr)
    slots.merge_postings(table, spark.createDataFrame([(1, 1, "1-2", "B2", None, 1)], BATCH), F.lit("2026-01-02").cast("timestamp"), base=1, version=2)
    assert sorted(table.rows().collect(), key=repr) == before and table.latest() == 2


EVENTS = (
    "run_id bigint, kind string, at timestamp, seq bigint, platform_id bigint, company_id bigint, status string, items_found bigint, "
    "items_inserted bigint, items_updated bigint, items_wrong bigint, items_unverifiable bigint, error_text string, dry_run boolean"
)


def event(run, kind, minute, seq=0, status=None, found=None, error=None, platform=None, dry=False):
    return (run, kind, T0 + timedelta(minutes=minute), seq, platform, None, status, found, None, found and found - 1, None, 0, error, dry)


RUNS = [
    event(1, "start", 0, platform=4), event(1, "finish", 5, 2, "error", 0, "late to arrive"), event(1, "finish", 9, 1, "ok", 7), event(1, "cancel", 90),
    event(2, "start", 0, 5, platform=8), event(2, "start", 0, 4, platform=7, dry=True), event(2, "cancel", 6), event(2, "cancel", 3),
    event(3, "start", 0), event(3, "cancel", 400), event(4, "start", 300), event(4, "cancel", 310),
    event(5, "start", 2), event(6, "finish", 3, 1, "ok", 2), event(6, "start", 1), event(6, "finish", 3, 2, "error", 1, "same time"), event(7, "cancel", 1),
    event(8, "start", 105, 1, platform=2), event(8, "start", 100, 9, platform=3),
]


def waves(spark, path, rows, schema, cuts):
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_run_ledger_in_any_order_over_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = RUNS[:] if seed else RUNS[::-1]
    rng.shuffle(rows)
    rows.append(event(99, "start", 800))  # moves the watermark past run 5's deadline, not past run 8's
    src = str(tmp_path / "ev")
    waves(spark, src, [*rows, event(98, "start", 801)], EVENTS, sorted({*rng.sample(range(1, len(rows)), 3 if seed else 1), len(rows)}))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    # Every row reaches the state, as lateness covers all of them; the watermark ends at minute 400.
    got = {r["run_id"]: r for r in drain_in_order(stateful.run_ledger(stream, "6 hours", "401 minutes"), tmp_path)}
    table = spark.createDataFrame([*rows, event(98, "start", 801)], EVENTS)
    want = {r["run_id"]: r for r in stateful.run_ledger_batch(table, F.lit(T0 + timedelta(minutes=400)), "6 hours").collect()}
    assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in want.items()}
    assert (want[1]["status"], want[1]["items_found"], want[1]["platform_id"]) == ("ok", 7, 4)
    assert (want[2]["error_text"], want[2]["finished_at"].minute, want[2]["platform_id"], want[2]["dry_run"]) == ("cancelled by user", 3, 7, True)
    assert want[3]["error_text"] == want[5]["error_text"] == "interrupted by restart" and want[5]["finished_at"] == T0 + timedelta(minutes=362)
    assert (want[4]["error_text"], want[6]["error_text"], want[7]["status"], want[8]["status"]) == ("cancelled by user", "same time", "running", "running")
    finished = table.filter("kind <> 'cancel' AND run_id IN (1, 6)")
    assert sorted(merge.fold_runs(finished).collect()) == sorted(want[k] for k in (1, 6))


def test_a_finish_after_the_deadline_mends_the_run(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [event(1, "start", 0), event(2, "start", 500), event(3, "start", 501), event(1, "finish", 499, 3, "ok", 5), event(1, "finish", 498, 4, "error", 1)]
    waves(spark, src, rows, EVENTS, [1, 2, 3])
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    seen = [(r["status"], r["items_found"]) for r in drain_in_order(stateful.run_ledger(stream, "1 hour", "1 hour"), tmp_path) if r["run_id"] == 1]
    assert seen == [("running", 0), ("error", 0), ("ok", 5)]


def drain_in_order(df, tmp_path):
    """Rows of an update stream, micro-batch by micro-batch."""
    out = []
    q = df.writeStream.foreachBatch(lambda batch, _: out.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return out


OUTCOMES = "sweep_id bigint, seq bigint, ok boolean, host_down boolean"


@pytest.mark.parametrize("seed", [0, 1])
def test_failure_breaker_in_any_order_over_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(s, q, rng.random() < 0.55, False) for s in range(30) for q in range(s, s + rng.randrange(1, 25))]
    rows = [(s, q, ok, not ok and rng.random() < 0.03) for s, q, ok, _ in rows]
    again = rng.sample(rows, 40)
    want = sorted(tuple(r) for r in stateful.failure_breaker_batch(spark.createDataFrame(rows, OUTCOMES), 3).collect())
    stops = sorted((r["sweep_id"], r["stop_at"]) for r in runs.stop_point(spark.createDataFrame(rows, OUTCOMES), "sweep_id", "seq", 3).collect() if r["stop_at"] is not None)
    rows += again
    rng.shuffle(rows)
    src = str(tmp_path / "o")
    waves(spark, src, rows, OUTCOMES, sorted(rng.sample(range(1, len(rows)), 3)))
    stream = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).parquet(src)
    last = {}
    for r in drain_in_order(stateful.failure_breaker(stream, 3), tmp_path):
        assert r["sweep_id"] not in last or (r["stop_at"], r["reason"]) < last[r["sweep_id"]][1:]
        last[r["sweep_id"]] = tuple(r)
    assert sorted(last.values()) == want and [w[:2] for w in want] == stops and {w[2] for w in want} == {"failures", "host_down"}


@pytest.mark.parametrize("stop_after", [0, 1, 2, 3])
def test_ranges_join_alike_in_every_order(stop_after):
    rng = random.Random(stop_after)
    for _ in range(300):
        n = rng.randrange(1, 9)
        ok = [rng.random() < 0.5 for _ in range(n)]
        down = [not x and rng.random() < 0.2 for x in ok]
        streak, want = 0, None
        for k in range(n):
            streak = 0 if ok[k] else streak + 1
            if want is None and (down[k] or (stop_after and streak >= stop_after)):
                want = (k + 5, down[k])
        order, held = rng.sample(range(n), n), []
        while order:
            size = rng.randrange(1, 4)
            take, order = sorted(order[:size]), order[size:]
            held = stateful.join_all([*held, *stateful.summarise(np.array(take) + 5, np.array([ok[k] for k in take]), np.array([down[k] for k in take]), stop_after)], stop_after)
        whole = stateful.summarise(np.arange(n) + 5, np.array(ok), np.array(down), stop_after)
        assert held == whole and (held[0][4], held[0][5]) == (want or (None, False))


def test_a_gap_splits_a_run_into_sessions(spark):
    rows = [("r", "2026-01-01 00:00:00", "agent step"), ("r", "2026-01-01 00:19:59", "summary"), ("r", "2026-01-01 05:00:00", "agent step")]
    lines = spark.createDataFrame(rows, "run_id string, ts string, msg string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["session_start"].hour, r["lines"], r["finished"]) for r in slogs.run_sessions(lines).collect())
    assert got == [(0, 2, True), (5, 1, False)]
