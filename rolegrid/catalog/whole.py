"""Registered queries: whole-text twins of the capped queries, files that are written and read, seeds and session functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.catalog import texts
from rolegrid.catalog.registry import ORACLES, Tables, query
from rolegrid.functions import jsonld
from rolegrid.functions.sql import register
from rolegrid.operators import discover, logs
from rolegrid.session import checkpoint_dir
from rolegrid.sources import registry, traces
from rolegrid.sources.lines import write_lines


@query("f20_p25_block_classifier_whole", ORACLES["f20_p25_block_classifier"].replace(f"substring({texts._BLOCK_TEXT}, 1, {vocab.BLOCK_SCAN_CHARS})", texts._BLOCK_TEXT))
def _f20(t: Tables):
    d = t.documents.select("doc_id", F.expr(texts._BLOCK_STATUS).alias("status"), F.col("lang").alias("title"), F.expr(texts._BLOCK_TEXT).alias("text"))
    return discover.annotate_blocks(d).select("doc_id", "blocked", "block_reason", "block_evidence")


@query("s7_log_stream_flatten_whole", "SELECT CAST(1700000000000000000 + event_id AS BIGINT) AS ts_ns, event_type AS app, 'line ' || props AS line FROM events")
def _s7(t: Tables):
    line = F.to_json(F.struct(F.concat(F.lit("line "), "props").alias("l")))
    body = F.concat(F.lit('{"data":{"result":[{"stream":{"app":"'), "event_type", F.lit('"},"values":[["'), (F.lit(1700000000000000000) + F.col("event_id")).cast("string"),
                    F.lit('",'), F.substring(line, F.lit(6), F.length(line) - 6), F.lit('],["bad","x"],["5"],7]}]}}'))
    return logs.flatten_streams(t.events.select(body.alias("body"))).select("ts_ns", F.try_element_at("labels", F.lit("app")).alias("app"), "line")


@query("s8_log_line_parse_whole", "SELECT doc_id, text AS raw FROM documents")
def _s8(t: Tables):
    """Lines that are no JSON stay raw, whole, whatever their length."""
    return logs.parse_lines(t.documents.select("doc_id", F.col("text").alias("line"))).select("doc_id", "raw")


@query("f29_posting_record_whole", "SELECT doc_id, 'T' || doc_id AS title, 'A b' || doc_id AS description FROM documents")
def _f29(t: Tables):
    """The posting stands behind all of a document's text."""
    n = F.col("doc_id").cast("string")
    page = F.concat(F.lit("<p>"), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit(" ")), F.lit('</p><script type="application/ld+json">{"@type":"JobPosting","title":"T'), n,
                    F.lit('","description":"<p>A</p>&nbsp;<b>b'), n, F.lit('</b>"}</script>'))
    return t.documents.withColumn("r", jsonld.posting_record(page, F.lit("link text"))).select("doc_id", "r.title", "r.description")


def _run_files(t: Tables) -> str:
    """A folder with one file per user, its events as trace lines in their order."""
    good = F.concat(F.lit('{"event":"'), "event_type", F.lit('","step":'), F.regexp_extract("props", "[0-9]+", 0), F.lit(',"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))
    value = F.when(F.col("event_type") == "error", F.lit("{broken")).when(F.col("event_type") == "view", F.lit("  ")).otherwise(good)
    path = f"{checkpoint_dir(t.spark)}/files/{uuid.uuid4().hex}"
    write_lines(t.events.select(F.col("user_id").alias("name"), F.col("event_id").alias("at"), value.alias("value")), path, ".jsonl")
    return path


_LINES = """l AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events)"""


@query("s4_trace_files", f"WITH {_LINES} SELECT run_id, n AS seq, event_type AS event, k AS step, ts AS ts_text FROM l WHERE event_type NOT IN ('error', 'view')")
def _s4(t: Tables):
    return traces.read_traces(t.spark, _run_files(t)).select("run_id", "seq", "event", "step", "ts_text")


@query("s5_log_files", f"""WITH {_LINES}
SELECT run_id, n AS line_no, CASE event_type WHEN 'error' THEN '{{broken' WHEN 'view' THEN '  ' ELSE '{{"event":"' || event_type || '","step":' || k || ',"ts":"' || ts || '"}}' END AS line FROM l""")
def _s5(t: Tables):
    return traces.read_log_lines(t.spark, _run_files(t))


@query("t2_trace_tail", f"""WITH {_LINES},
t AS (SELECT run_id, n, event_type, k, CASE event_type WHEN 'error' THEN 7 WHEN 'view' THEN 2 ELSE length('{{"event":"' || event_type || '","step":' || k || ',"ts":"' || ts || '"}}') END AS size FROM l),
o AS (SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY run_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM t)
SELECT run_id, CAST(seq AS BIGINT) AS seq, event_type AS event, k AS step FROM o WHERE event_type NOT IN ('error', 'view')""")
def _t2(t: Tables):
    """The stream over the files until it has caught up, and what its sink then holds."""
    from rolegrid.streaming.ingest import tail_traces

    files, out = _run_files(t), f"{checkpoint_dir(t.spark)}/tail/{uuid.uuid4().hex}"
    stream = tail_traces(t.spark, files, ".jsonl").select("run_id", "seq", "event", "step")
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows")


_SEEDS = ", ".join(f"({i}, '{name}', '{kind}')" for i, name, kind, _ in vocab.PLATFORM_SEED)


@query("s13_platform_registry", f"""
SELECT platform_id, name, platform_type FROM platforms WHERE platform_id NOT IN (1, 13) UNION ALL
SELECT * FROM (VALUES {_SEEDS}) AS s(platform_id, name, platform_type) WHERE platform_id NOT IN (SELECT platform_id FROM platforms WHERE platform_id NOT IN (1, 13)) AND name NOT IN (SELECT name FROM platforms WHERE platform_id NOT IN (1, 13))""")
def _s13(t: Tables):
    return registry.seed_platforms(t.platforms.filter("platform_id NOT IN (1, 13)"))


@query("x3_session_functions", """
SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_extract(c_name, '#(.*)', 1) AS token,
  epoch_us(make_timestamp(2020, 1, 1 + c_nationkey, 6, 30, 0)) AS instant, 'https://Example.com/p/' || c_custkey || '?b=' || c_custkey AS url FROM customer""")
def _x3(t: Tables):
    register(t.spark)
    n = F.col("c_custkey").cast("string")
    rows = t.customer.select(
        "c_custkey", "c_name", F.concat(F.lit("2020-01-"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("T06:30:00Z")).alias("stamp"),
        F.concat(F.lit("https://Example.com/p/"), n, F.lit("?utm_source=x&b="), n, F.lit("#top")).alias("link"))
    return rows.selectExpr("c_custkey", "rg_slugify(c_name) AS slug", "rg_distinctive_token(c_name) AS token", "unix_micros(rg_parse_instant(stamp)) AS instant", "rg_normalise_url(link) AS url")
