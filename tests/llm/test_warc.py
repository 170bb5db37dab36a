import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from rolegrid.llm.catalog import ORACLES, QUERIES
from rolegrid.llm.warc import parse_header, read_archive, record_bytes, write_archive


def brute(rows, least=0):
    last = {}
    for page, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        again = page is not None and len(body) >= least and page < last[html or ""]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", last[html or ""] if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(p, f"http://h/{k}\r\nX: y" if k % 3 else None, h, "c", 4) for k, (p, h) in enumerate(rows)],
                                     "page_id bigint, url string, html string, sha256 string, part int")

    return make


ROWS = [(1, "a"), (2, "a"), (9, "a"), (3, None), (4, ""), (5, "é" * 100_000), (6, "<p>\r\n\r\nWARC/1.1\r\n"), (7, "a"), (None, "a"), (None, "lone"), (8, "b"), (8, "b")]


@pytest.mark.parametrize(("least", "refs"), [(0, 500), (0, 2), (5, 500)])
def test_records_against_brute_force(spark, pages, monkeypatch, least, refs):
    monkeypatch.setattr("rolegrid.llm.warc.REFERENCES", refs)
    path = write_archive(pages(ROWS), least)
    assert got(read_archive(spark, path)) == brute(ROWS, least)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, h in ROWS})


def test_record_bytes_parse_as_warc(spark, pages):
    rows = ROWS[:8]
    path, html = write_archive(pages(rows)), dict(rows)
    for r in record_bytes(spark, path).collect():
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        first, fields = parse_header(head)
        n = int(fields["Content-Length"])
        assert first == "WARC/1.1" and block[n:] == b"\r\n\r\n"
        body = block[:n].split(b"\r\n\r\n", 1)[1]
        assert body == (b"" if fields["WARC-Type"] == "revisit" else (html[r.page_id] or "").encode())


def test_a_changed_payload_is_found(spark, pages):
    path = write_archive(pages(ROWS))
    spark.read.parquet(f"{path}/payloads").withColumn("packed", F.lit(zstandard.compress(b"z"))).write.parquet(f"{path}/bad")
    spark.read.parquet(f"{path}/bad").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, path).collect()


def test_empty_table_and_query(spark, pages):
    assert read_archive(spark, write_archive(pages([]))).count() == 0
    rows = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert got(QUERIES["op8_warc"](spark, "/root/testdata/sf0.001")) == brute(rows)


def test_the_sql_gives_the_same_rows(pages, sql):
    rows = [r for r in ROWS if r[0] is not None]
    cols, want = sql(ORACLES["op8_warc"], pages=pages(rows).select("page_id", "url", "html"))
    assert cols == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(want, key=repr) == brute(rows)


def test_copies_without_a_page_id_are_dealt_to_several_parts(spark):
    pages = spark.createDataFrame([(None, "http://a/", "same payload " * 20)] * 3000, "page_id bigint, url string, html string")
    path = write_archive(pages)
    assert spark.read.parquet(f"{path}/headers").select("part").distinct().count() > 1
    assert read_archive(spark, path).count() == 3000
