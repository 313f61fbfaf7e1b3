import gzip
import os
import random

import pytest

from onomast.llm import warc
from pyspark.sql import functions as F

ROWS = [
    (1, "http://a.example/x?y=1", "<p>one</p>", "extra"),
    (2, None, "é" * 3000, None),
    (3, "http://b.example/\r\ninjected: 1", None, "z"),
    (4, "http://c.example/", "", None),
    (4, "http://c.example/", "", None),
    (None, "http://d.example/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", None),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string, path string")


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, pages, tmp_path, packed):
    warc.write_warc(pages, str(tmp_path / "w"), packed=packed)
    got = warc.read_warc(spark, str(tmp_path / "w")).where("warc_type = 'response'").collect()
    found = sorted((r.record_id, r.target_uri or "", r.payload.decode(), r.http_status) for r in got)
    want = sorted((f"<urn:page:{'null' if i is None else i}>", (u or "").replace("\r\n", "%0D%0A"), t or "", 200) for i, u, t, _ in ROWS)
    assert found == want


def test_filters_reach_the_reader(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "w"))
    df = warc.read_warc(spark, str(tmp_path / "w")).where("warc_type = 'request' AND target_uri LIKE 'http://c%' AND http_status IS NULL")
    assert df.count() == 2
    pushed = warc.read_warc(spark, str(tmp_path / "w")).where("warc_type = 'request'")
    assert "Filter (" not in pushed._jdf.queryExecution().executedPlan().toString()
    assert warc.read_warc(spark, str(tmp_path / "w")).where("warc_type <> 'response'").count() == len(ROWS) + len(os.listdir(tmp_path / "w")) - sum(x.startswith(".") for x in os.listdir(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).where("target_uri IS NULL AND warc_type = 'response'").count() == 1
    assert warc.read_warc(spark, str(tmp_path / "w")).where("content_length > 6000 AND warc_type = 'response'").count() == 1


def test_splits_lose_and_repeat_nothing(spark, tmp_path):
    random.seed(3)
    rows = [(i, f"http://x.example/{i}", "".join(random.choices("abcdef ", k=random.choice([0, 10, 5000])))) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    for split in (1000, 7777, 10**9):
        splits = warc.plan_splits(spark, str(tmp_path / "w"), split)
        assert (len(splits) > 3) == (split < 10**9)
        got = warc.read_warc(spark, str(tmp_path / "w"), splits=splits).where("warc_type = 'response'")
        assert sorted((r.target_uri, r.payload.decode()) for r in got.collect()) == sorted((u, t) for _, u, t in rows)


@pytest.mark.parametrize("packed", [True, False])
def test_a_warc_file_as_payload_is_no_record(spark, tmp_path, packed):
    """Whatever the splits, only the outer file's records are found."""
    inner = warc._record("resource", "urn:inner", "http://i.example/", "text/plain", b"abc", warc.DATE)
    inner = gzip.compress(inner) if packed else b"x" * 50 + b"\r\n\r\n" + inner
    body = os.urandom(4000) + inner + os.urandom(6000)
    os.makedirs(tmp_path / "w")
    outer = [warc._record("resource", f"urn:{i}", "http://o.example/", "application/x", body, warc.DATE) for i in range(3)]
    (tmp_path / f"w/a.warc{'.gz' if packed else ''}").write_bytes(b"".join(gzip.compress(x, 0) if packed else x for x in outer))
    for split in (100, 4000, 12_000):
        splits = warc.plan_splits(spark, str(tmp_path / "w"), split)
        got = warc.read_warc(spark, str(tmp_path / "w"), splits=splits).collect()
        assert sorted(r.record_id for r in got) == [f"<urn:{i}>" for i in range(3)] and all(r.payload == body for r in got)
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 3


def test_payloads_of_other_records_are_not_decoded(monkeypatch, spark, pages, tmp_path):
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    seen = []
    monkeypatch.setattr(warc, "split_http", lambda block: seen.append(block) or (None, {}, block))
    (name,) = [x for x in os.listdir(tmp_path / "w") if x.endswith(".gz")]
    path = str(tmp_path / "w" / name)
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.ds.EqualTo(("warc_type",), "request"), warc.ds.EqualTo(("http_status",), 200)]))
    assert [f.attribute for f in left] == [("http_status",)]
    (split,) = reader.partitions()
    rows = [r for b in reader.read(split) for r in b.to_pylist()]
    assert len(rows) == len(seen) == len(ROWS) and {r["warc_type"] for r in rows} == {"request"}


def test_damage_and_other_layouts(spark, tmp_path):
    rec = lambda i, body=b"abc": warc._record("resource", f"urn:{i}", f"http://e.example/{i}", "text/plain", body, warc.DATE)
    os.makedirs(tmp_path / "w")
    pack = lambda data: gzip.compress(data, 1)
    bad = bytearray(pack(rec(1, b"x" * 500)))
    bad[60:70] = b"\xff" * 10
    (tmp_path / "w/a.warc.gz").write_bytes(pack(rec(0)) + bytes(bad) + pack(rec(2)) + pack(rec(3, os.urandom(4000)))[:-50])
    (tmp_path / "w/b.warc.gz").write_bytes(pack(rec(4) + rec(5)))  # two records in one member
    (tmp_path / "w/c.warc").write_bytes(b"junk\r\n" + rec(6) + b"more junk\r\n" + rec(7) + rec(8)[:-20])
    (tmp_path / "w/d.warc").write_bytes(b"")
    got = sorted(r.record_id for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [f"<urn:{i}>" for i in (0, 2, 4, 5, 6, 7)]


def test_bodies():
    head = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX: 1\r\nX: 2\r\n\r\n"
    z = gzip.compress(b"hello")
    status, fields, body = warc.split_http(head + b"%x\r\n" % len(z) + z + b"\r\n0\r\n\r\n")
    assert (status, fields["x"], body) == (404, "1, 2", b"hello")
    assert warc.split_http(b"no http") == (None, {}, b"no http")


def test_no_files(spark, tmp_path):
    os.makedirs(tmp_path / "w")
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_warc(empty, str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).where("warc_type = 'response'").count() == 0


def test_headers_only(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), payload=False).where(F.col("warc_type") == "response").collect()
    assert len(got) == len(ROWS) and all(r.payload is None and r.content_length > 50 for r in got)
