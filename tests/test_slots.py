"""State tables in slots: the same rows as whole snapshots, fewer files written."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import merge, slots

T0 = datetime(2026, 1, 1)
JOBS = "job_id bigint, company_id bigint, discovery_platform_id bigint, external_id string, title string, employment_type string, posted_at timestamp, status string, raw_data string, first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp"
BATCH = "company_id bigint, discovery_platform_id bigint, external_id string, title string, raw_data string, ordinal bigint"


def now():
    return F.lit("2026-02-01").cast("timestamp")


def job(i, platform, key, status="open", raw=None, title="t"):
    return (i, i % 3, platform, key, title, None, None, status, raw, T0, T0, T0, T0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    def make(rows, layout=slots.Layout(key=slots.POSTINGS.key, scope=slots.POSTINGS.scope, ids="job_id", groups=4, parts=4)):
        t = slots.SlotTable(spark, str(tmp_path / "t"), layout)
        t.create(spark.createDataFrame(rows, JOBS))
        return t

    return make


def test_batches_equal_whole_snapshots(spark, table):
    rng = random.Random(4)
    rows = [job(k, rng.choice([1, 1, 1, 2, 3, None]), None if k % 17 == 0 else f"e{k}", rng.choice(["open", "closed", "filled"])) for k in range(1, 300)]
    t, whole = table(rows), spark.createDataFrame(rows, JOBS)
    for step, platforms in enumerate(([1], [2, 3], [9]), 1):
        picked = [(k % 3, rng.choice(platforms), rng.choice([f"e{k}", f"n{k}", ""]), f"title {step}", f"raw {step}", k) for k in rng.sample(range(1, 300), 40)]
        batch = spark.createDataFrame([*picked, (1, platforms[0], None, "no key", "raw", 999)], BATCH)
        scope = ["discovery_platform_id"] + (["company_id"] if step == 2 else [])
        merged = merge.upsert_jobs(whole, batch, now())
        whole = merge.mark_stale(merged.drop("merge_action"), merge.observed_keys(batch, scope), scope, now()).drop("newly_closed")
        whole = spark.createDataFrame(whole.collect(), whole.schema)
        before = {m["slot"]: m["written"] for m in t.manifest()}
        changed = slots.merge_postings(t, batch, now(), scope=scope)
        assert t.latest() == step and changed.filter("merge_action <> 'kept' OR newly_closed").count() >= 20
        # New ids are dense either way; which new row takes which is not fixed.
        plain = lambda df: rows_of(df.withColumn("job_id", F.when(F.col("job_id") < 300, F.col("job_id"))))
        assert plain(t.rows()) == plain(whole)
        ids = [r[0] for r in t.rows().select("job_id").collect()]
        assert len(set(ids)) == len(ids) and max(ids) == len(ids)
        after = {m["slot"]: m["written"] for m in t.manifest()}
        others = {s for s in before if after[s] == before[s]}
        assert t.read(others).filter("discovery_platform_id IN (2, 3)").count() == t.read(others, step - 1).filter("discovery_platform_id IN (2, 3)").count()
        if platforms == [9]:
            assert len(others) > len(before) // 2


def test_a_merge_writes_its_rows_once(spark, table, tmp_path):
    """Rows were staged in a folder of changes, read back, dealt to slots and written again."""
    t = table([job(k, k % 4, f"e{k}") for k in range(40)])
    batch = spark.createDataFrame([(1, 1, "e1", "again", None, 1), (1, 1, "n1", "new", None, 2), (1, 1, "", "blank", None, 3)], BATCH)
    changed = slots.merge_postings(t, batch, now())
    assert not (tmp_path / "t/changes").exists() and all("/data/v=1/" in f for f in changed.inputFiles())
    got = {r["external_id"]: (r["merge_action"], r["newly_closed"], r["status"]) for r in changed.collect()}
    assert (got["e1"], got["n1"], got["e5"]) == (("updated", False, "open"), ("inserted", False, "open"), ("kept", True, "closed"))
    assert got[""] == ("inserted", True, "closed")  # a blank key is no sighting
    assert t.rows().columns == t.rows(0).columns and t.rows().count() == 42


@pytest.mark.parametrize("scope", [["discovery_platform_id"], ["discovery_platform_id", "company_id"]])
def test_a_given_seen_set_equals_whole_snapshots(spark, table, scope):
    """Sightings of dropped rows keep postings open; a batch row out of the seen set closes again."""
    rows = [job(k, k % 3 or None, None if k % 7 == 0 else f"e{k}", ["open", "closed", "filled"][k % 3 if k % 5 else 0]) for k in range(1, 120)]
    t, whole = table(rows), spark.createDataFrame(rows, JOBS)
    batch = spark.createDataFrame([(k % 2, 1, f"e{k}", f"t{k}", None, k) for k in range(1, 60, 2)] + [(2, 2, "n", "new", None, 99), (None, 2, "m", "new", None, 100)], BATCH)
    seen = spark.createDataFrame([(1, k % 3, f"e{k}") for k in range(1, 90, 4)] + [(2, 2, "n"), (2, None, "e2"), (None, 1, "e3"), (1, 1, None)], "discovery_platform_id bigint, company_id bigint, external_id string")
    want = merge.mark_stale(merge.upsert_jobs(whole, batch, now()), seen, scope, now())
    got = slots.merge_postings(t, batch, now(), observed=seen, scope=scope)
    plain = lambda df: rows_of(df.withColumn("job_id", F.when(F.col("job_id") < 120, F.col("job_id"))).select(*want.columns))
    assert [r for r in plain(got) if r[want.columns.index("merge_action")] != "kept" or r[-1]] == [r for r in plain(want) if r[want.columns.index("merge_action")] != "kept" or r[-1]]
    assert plain(t.rows().withColumns({"merge_action": F.lit(""), "newly_closed": F.lit(True)})) == plain(want.withColumns({"merge_action": F.lit(""), "newly_closed": F.lit(True)}))
    assert want.filter("newly_closed").count() > 3


def test_nothing_observed_writes_no_data(spark, table, tmp_path):
    t = table([job(1, 1, "a")])
    slots.merge_postings(t, spark.createDataFrame([], BATCH), now())
    assert t.latest() == 1 and not (tmp_path / "t/data/v=1").exists() and rows_of(t.rows()) == rows_of(t.rows(0))
    with pytest.raises(ValueError):
        slots.merge_postings(t, spark.createDataFrame([], BATCH), now(), scope=["company_id"])


def test_maintenance_rewrites_moved_slots_once(spark, table, tmp_path):
    raw = '{"@type":"JobPosting","title":"x","description":"d","employmentType":"FULL_TIME","datePosted":"2026-01-05"}'
    t = table([job(k, k % 5, f"e{k}", raw=raw if k in (3, 8) else None) for k in range(1, 80)])
    whole = rows_of(merge.posting_backfill(t.rows(), now()).drop("backfilled"))
    backfill = lambda df: merge.posting_backfill(df, now())
    version, moved = slots.maintain(t, backfill, ["employment_type", "posted_at"])
    assert (version, len(moved)) == (1, 2) and rows_of(t.rows()) == whole
    assert {m["slot"] for m in t.manifest() if m["written"] == 1} == moved
    assert slots.maintain(t, backfill, ["employment_type", "posted_at"]) == (1, set()) and t.latest() == 1
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir() if p.is_dir()) == ["v=0", "v=1"]


def test_maintenance_reads_each_posting_json_once_a_pass(spark, table):
    """The search for moved slots filtered on the change, which put the JSON parse into the filter ten times."""
    t = table([job(k, k % 5, f"e{k}") for k in range(20)])
    found = slots.moved_slots(t, lambda df: merge.posting_backfill(df, now()), ["employment_type", "posted_at"], 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_an_unfinished_version_is_not_read_and_is_replaced(spark, table, tmp_path):
    t = table([job(k, 1, f"e{k}") for k in range(20)])
    spark.createDataFrame([job(1, 1, "half")], JOBS).withColumn("slot", F.lit(3)).write.partitionBy("slot").parquet(str(tmp_path / "t/data/v=1"))
    assert t.latest() == 0 and t.rows().count() == 20
    slots.merge_postings(t, spark.createDataFrame([(1, 1, "e1", "new", None, 1)], BATCH), now())
    assert t.latest() == 1 and t.rows().filter("external_id = 'half'").count() == 0 and t.rows().filter("status = 'open'").count() == 1


def test_vacuum_keeps_what_versions_name(spark, table):
    t = table([job(k, k % 4, f"e{k}") for k in range(40)])
    for step in (1, 2):
        slots.merge_postings(t, spark.createDataFrame([(1, 1, "e1", f"v{step}", None, 1)], BATCH), now())
    want = rows_of(t.rows())
    assert t.vacuum(2) > 0 and rows_of(t.rows()) == want and t.latest(below=2) == -1
    assert t.vacuum(2) == 0


def test_feed_captures_are_stored_once_in_many_files(spark):
    """Bodies were made in the few tasks that read the events, anew in every step of the ingest."""
    from rolegrid.catalog.jobs import feed_captures
    from rolegrid.catalog.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    captures = feed_captures(t)
    assert captures.count() == t.events.count()
    assert len(captures.inputFiles()) > max(t.events.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
