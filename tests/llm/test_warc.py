import base64
import gzip
import hashlib

from tabloom.llm import shared
from tabloom.llm.warc import parse, ranges, record, round_trip, write_archives, mark_revisits


def check(pages, rows):
    keep = {}
    for r in pages.collect():
        if r.page_id is not None:
            keep[r.html or ""] = max(keep.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        html = (r.html or "").encode()
        keeper = keep.get(r.html or "")
        revisit = keeper is not None and keeper != r.page_id
        want.append((str(r.page_id), len(html), base64.b32encode(hashlib.sha1(html).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = round_trip(pages).collect()
    check(pages, rows)
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(bytes(r.html).decode() == html[r.page_id] for r in rows if r.record_type == "response")


def test_awkward(spark):
    rows = [(1, "http://a/é\r\nX: y", "same"), (2, None, "same"), (2, "u", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"), (5, "u", "WARC/1.1\r\n\r\n" * 3), (6, "u", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    got = round_trip(pages).collect()
    check(pages, got)
    assert {r.url for r in got} == {r[1] for r in rows}
    assert round_trip(pages.where("false")).collect() == []


def test_payloads_move_only_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 3 == 0 else f"own {i}") for i in range(60)], "page_id long, url string, html string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = mark_revisits(pages)
    assert "strategy=broadcast" in plan(small)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    large = mark_revisits(pages)
    assert "strategy=broadcast" not in plan(large)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_threshold(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r.page_id for r in round_trip(pages, least=3).collect() if r.record_type == "revisit"} == {3}


def test_index_gives_byte_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * i) for i in range(20)], "page_id long, url string, html string")
    index = write_archives(mark_revisits(pages), str(tmp_path / "arc"), archive_bytes=600).collect()
    assert len({r.file for r in index}) > 1
    for r in index:
        data = (tmp_path / "arc" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert parse(gzip.decompress(data))["payload"] == b"p" * r.page_id and r.digest == base64.b32encode(hashlib.sha1(b"p" * r.page_id).digest()).decode()


def test_records_and_ranges():
    r = parse(record(7, "u", b"body", 9, True))
    assert r["payload"] is None and r["payload_bytes"] == 4 and r["fields"]["WARC-Refers-To"].endswith(":9>")
    assert ranges([(0, 10), (10, 10), (500, 10)], gap=100) == [(0, 20, 2), (500, 510, 1)]
    assert ranges([(0, 10), (10, 10)], most=15) == [(0, 10, 1), (10, 20, 1)] and ranges([]) == []
