import base64
import gzip
import hashlib
import os

import pytest

from assay.llm.warc import index_archives, mark_revisits, op1_warc, parse_record, read_records, write_archives
from assay.session import scratch_path

PAGES = "page_id long, url string, html string, digest string, path string"
ROWS = [
    (3, "http://a.example/ü?q=1", "<p>gleich</p>", "x", "y"),
    (1, "http://b.example/", "<p>gleich</p>", "x", "y"),
    (2, None, None, None, None),
    (4, "http://c.example/a b\r\nX: y", "", "x", "y"),
    (5, "", "line\r\n\r\nline " * 50_000, "x", "y"),
    (None, "http://d.example/", "<p>gleich</p>", "x", "y"),
    (6, "http://e.example/", "allein", "x", "y"),
    (6, "http://e.example/", "allein", "x", "y"),
]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    path = scratch_path(spark, "warc-test")
    return write_archives(mark_revisits(pages), path, file_bytes=100).cache(), path


def test_round_trip(archive):
    got = {}
    for r in read_records(archive[0]).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    assert {k: (v[0].record_type, v[0].refers_to) for k, v in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), 5: ("response", None),
        6: ("response", None), None: ("revisit", 1),
    }
    assert bytes(got[5][0].payload).decode() == ROWS[4][2] and bytes(got[2][0].payload) == b""
    assert len(got[6]) == 2 and got[3][0].payload is None and got[2][0].url is None
    assert got[3][0].url == ROWS[0][1] and got[4][0].url == "http://c.example/a%20b%0D%0AX:%20y"
    sha = base64.b32encode(hashlib.sha1(ROWS[0][2].encode()).digest()).decode()
    assert got[1][0].payload_digest == got[3][0].payload_digest == sha


def test_index_of_given_archives_is_the_writers(spark, archive):
    index, _ = archive
    paths = [r.path for r in index.select("path").distinct().collect()]
    order = ["path", "offset"]
    assert index_archives(spark, paths).orderBy(order).collect() == index.orderBy(order).collect()
    assert index_archives(spark, []).count() == 0


def test_members_are_records_and_ranges_select(archive):
    index, _ = archive
    row = index.filter("page_id = 5").first()
    with open(row.path.removeprefix("file:"), "rb") as f:
        f.seek(row.offset)
        record = gzip.decompress(f.read(row.length))
    assert parse_record(record)["payload"].decode() == ROWS[4][2]
    assert [r.page_id for r in read_records(index.filter("page_id = 5"), gap=0, most=1).collect()] == [5]


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    assert mark_revisits(pages, min_bytes=20).filter("refers_to IS NOT NULL").count() == 0


def test_a_changed_byte_is_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    index = write_archives(mark_revisits(pages), path)
    row = index.first()
    name = row.path.removeprefix("file:")
    record = gzip.decompress(open(name, "rb").read()).replace(b"text\r\n\r\n", b"TEXT\r\n\r\n")
    member = gzip.compress(record)
    open(name, "wb").write(member)
    with pytest.raises(Exception, match="differs from its digest"):
        read_records(index.selectExpr("path", "offset", f"{len(member)}L AS length")).collect()


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(os.fspath(tmp_path / "pages.parquet"))
    assert op1_warc(spark, os.fspath(tmp_path)).count() == 0
