"""WARC archives: exact round trips, ranges, and the query against its SQL."""

import gzip
import hashlib
import os

import duckdb
import pytest

from reckonry.llm import op11_warc as warc
from reckonry.plans.check import rows_of, sql_connection

LONG = "<p>" + "lang é\U0001f600 " * 200_000 + "</p>"
SAME, OTHER = "<p>" + "s" * 120, "<p>" + "o" * 120
ROWS = [
    (7, "http://a.example/1", SAME), (3, "http://b.example/2", SAME), (9, None, SAME), (None, "http://c.example/", SAME), (4, "http://a.example/x\r\nWARC-Type: forged", "short"),
    (5, "http://a.example/y z", "short"), (6, "u", None), (8, "u", ""), (10, "u", LONG), (11, "u", LONG), (12, "u", "x\r\n\r\ny" * 30), (13, "u", "WARC/1.1\r\n\r\n" * 20),
    (None, "n1", OTHER), (None, "n2", OTHER), (20, "r", "repeated" * 20), (20, "r", "repeated" * 20), (20, "q", "repeated" * 20), (21, "r", "repeated" * 20),
    (22, None, "again" * 30), (22, None, "again" * 30), (30, "r", "other page" * 20), (30, "r", "not the same" * 20),
]
SCHEMA = "page_id long, url string, html string, lead string, n map<string,int>, offset int, payload_digest int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", {"a": 1}, 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def index(spark):
    return warc.write_archives(_table(spark, ROWS)).cache()


def test_every_row_has_its_record(spark, index):
    lines = index.collect()
    assert sorted(map(str, ((r["page_id"], r["url"], r["payload_bytes"]) for r in lines))) == sorted(
        map(str, ((i, u, len((h or "").encode())) for i, u, h in ROWS)))
    assert len({r["record_id"] for r in lines}) == len(lines)
    responses = {r["record_id"]: r for r in lines if r["record_type"] == "response"}
    for r in lines:
        if r["record_type"] == "revisit":
            assert r["payload_bytes"] >= 100 and responses[r["refers_to"]]["payload_digest"] == r["payload_digest"]
    big = [r["payload_digest"] for r in responses.values() if r["payload_bytes"] >= 100]
    assert len(big) == len(set(big))


def test_payloads_come_back(spark, index):
    got = warc.payloads(index, index).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), bytes(r["payload"])) for r in got) == sorted((str(i), str(u), (h or "").encode()) for i, u, h in ROWS)
    some = index.where("page_id in (9, 11, 5)")
    assert sorted((r["page_id"], bytes(r["payload"])) for r in warc.payloads(index, some).collect()) == [(5, b"short"), (9, SAME.encode()), (11, LONG.encode())]


def test_archives_are_plain_warc(index):
    """Each archive is a valid gzip file of records that a reader without the index can walk through."""
    seen = 0
    for file in {r["file"] for r in index.collect()}:
        data = gzip.open(file.removeprefix("file:")).read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            if fields["WARC-Type"] == "response":
                payload = rest[:size].partition(b"\r\n\r\n")[2]
                assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            seen += fields["WARC-Type"] != "warcinfo"
            data = rest[size + 4:]
    assert seen == len(ROWS)


def test_neighbours_share_a_read():
    lines = [("a", 0, 10), ("a", 10, 10), ("a", 10, 10), ("a", 25, 10), ("a", 100, 10), ("a", 110, 200), ("b", 0, 10)]
    found = list(warc.runs(iter(lines), gap=5, most=50))
    assert found == [("a", 0, 35, [(0, 10), (10, 10), (10, 10), (25, 10)]), ("a", 100, 110, [(100, 10)]), ("a", 110, 310, [(110, 200)]), ("b", 0, 10, [(0, 10)])]
    assert list(warc.runs(iter([]))) == []


def test_a_cut_record_raises():
    whole = warc.record("response", "urn:page:1:d", "u", "2020-01-01T00:00:00Z", "d", 3, b"abc", None)
    assert warc.parsed(whole)[2] == b"abc"
    for bad in (whole[:-5], whole + b"x", whole.replace(b"abc", b"ab")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_archives_of_lost_tasks_are_not_read(spark, tmp_path):
    index = warc.write_archives(_table(spark, ROWS[:6]), str(tmp_path))
    (tmp_path / "000000-lost.warc.gz").write_bytes(b"half a record")
    assert warc.read_records(index).count() == 6


def test_shuffled_when_many_payloads_are_shared(spark, monkeypatch):
    monkeypatch.setattr(warc, "written_keys", lambda keys, name: keys)
    assert sorted((str(r["page_id"]), r["record_type"]) for r in warc.planned(_table(spark, ROWS)).collect()) == sorted(
        (str(r[0]), r[1]) for r in warc.planned(_table(spark, ROWS)).select("page_id", "record_type").collect())


def test_query_against_its_sql(spark, tmp_path):
    _table(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, url, html from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = warc.QUERY(spark, str(tmp_path)), con.sql(warc.SQL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_no_rows(spark):
    index = warc.write_archives(_table(spark, []))
    assert index.collect() == [] and warc.read_records(index).collect() == []


def test_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    got, want = warc.QUERY(spark, folder), sql_connection(folder).sql(warc.SQL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
    assert os.path.isdir(folder)
