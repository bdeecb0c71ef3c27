import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from lorekeep.llm import warc
from lorekeep.llm.warc import read_warc, warc_digest, write_warc
from lorekeep.session import work_dir

PAGES = [(1, "http://a/x", "<p>one</p>"), (2, "http://a/y", "<p>one</p>"), (3, None, None), (4, "http://b/é z", ""),
         (5, "http://c", "é" * 70_000), (6, "http://c", "WARC/1.1\r\n\r\nnested"), (7, "http://c", "<p>one</p>"),
         (None, "http://d", "<p>one</p>")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark, pages):
    got = {r.page_id: r for r in warc_digest(pages).collect()}
    last = {}
    for key, _, body in PAGES:
        last[body or ""] = max(last.get(body or "", -1), -1 if key is None else key)
    for key, _, body in PAGES:
        raw, r = (body or "").encode(), got[key]
        keep = last[body or ""]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if key == keep else ("revisit", keep))


def test_filters_reach_the_headers(spark, pages):
    path = work_dir(spark, "warc-test")
    write_warc(pages, path, "page_id", "url", "html", least=1)
    one = read_warc(spark, path).where("record_type = 'revisit'")
    assert "record_type" in one._jdf.queryExecution().executedPlan().toString()
    rows = one.collect()
    assert len(rows) == 3 and all(r.payload == b"" for r in rows)
    assert read_warc(spark, path).where("record_type = 'response'").count() == 5  # two empty ones, under the least size
    heads = read_warc(spark, path, payload=False).collect()
    assert len(heads) == 8 and all(r.payload is None for r in heads)
    assert {r.headers["x-payload-length"] for r in heads} == {"10", "0", "140000", "18"}


def test_members_are_plain_gzip_and_foreign_files_read():
    data = [warc.record_bytes("response", i, f"http://x/{i}", b"body%d" % i, "D", None) for i in range(5)]
    joined = b"".join(map(warc.member, data))
    assert gzip.decompress(joined) == b"".join(data)
    foreign = b"".join(map(gzip.compress, data))
    for raw, walk in ((joined, warc.gzip_records), (foreign, warc.gzip_records), (b"".join(data), warc.plain_records)):
        for wants in (lambda h: True, lambda h: h["x-record-key"] == "3"):
            got = list(walk(pa.BufferReader(raw), 0, None, wants, True))
            assert [x[2] for x in got] == [b"body%d" % i for i in range(5) if wants({"x-record-key": str(i)})]


def test_broken_archive_is_an_error():
    raw = warc.member(warc.record_bytes("response", 1, None, b"x" * 5000, "D", None))
    with pytest.raises(Exception):
        list(warc.gzip_records(pa.BufferReader(raw[:40]), 0, None, lambda h: True, True))


def test_no_pages(spark, pages):
    assert warc_digest(pages.limit(0)).count() == 0
