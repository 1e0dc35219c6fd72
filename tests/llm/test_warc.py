"""WARC: round trips of difficult payloads, segments, ties and empty tables."""

import hashlib

import pytest

from tivlens.llm import warc
from tivlens.llm.common import new_folder

SCHEMA = "page_id long, url string, html string, record_id string"
LONG = "x\r\n\r\n" * 400
BODIES = ["", "a\r\n", "\r\n", "\r\n\r\n", "end\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "é\U0001f600\x00\r",
          LONG, LONG]


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_round_trip(spark, chunk):
    data = [(k, f"http://x/{k} \n", b, "own") for k, b in enumerate(BODIES)] + [(90, None, None, None), (None, None, LONG, "y")]
    folder = new_folder(spark, "t")
    warc.write_archive(rows(spark, data), folder, chunk_chars=chunk)
    got = {r.page_id: r for r in warc.read_records(spark, folder).collect()}
    assert len(got) == len(data) and all(r.intact for r in got.values())
    for page, _, body, _ in data:
        payload = (body or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert (got[7].record_type, got[7].refers_to) == ("revisit", 8)
    assert {r.record_type for p, r in got.items() if p != 7} == {"response"}
    chunks = warc.read_chunks(spark, folder).where("record_type = 'response'").collect()
    parts = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        parts.setdefault(c.page_id, bytearray()).extend(c.payload)
    assert {p: bytes(b).decode() for p, b in parts.items()} == {
        None if p is None else str(p): b or "" for p, _, b, _ in data if p != 7}
    if chunk == 7:
        assert max(c.chunk_no for c in chunks) == -(-len(LONG) // 7)


def test_changed_payload_is_noticed(spark):
    reader = warc._Reader(False)
    digest = hashlib.sha1(b"abcdef").hexdigest()
    texts = [t.replace("def", "dex") for t in warc.records("1", None, "abcdef", digest, None, 3)]
    found = [row for t in texts for row in reader.take(t)]
    assert [row[9] for row in found] == [True, False]


def test_repeated_rows_and_empty_table(spark):
    folder = new_folder(spark, "t")
    warc.write_archive(rows(spark, [(1, "u", LONG, "")] * 3 + [(2, "v", LONG, "")]), folder)
    got = sorted(tuple(r) for r in warc.read_records(spark, folder).select("page_id", "record_type", "refers_to").collect())
    assert got == [(1, "revisit", 2), (2, "response", None)]
    folder = new_folder(spark, "t")
    warc.write_archive(rows(spark, []), folder)
    assert warc.read_records(spark, folder).count() == 0


def test_one_record_for_each_row(spark):
    data = [(None, "a", None, ""), (None, "b", None, ""), (None, "a", None, ""), (None, "a", LONG, ""), (None, "c", LONG, ""),
            (3, "a", "short", ""), (3, "b", "short", ""), (3, None, "short", ""),
            (4, "a", LONG, ""), (4, "b", LONG, ""), (5, "a", LONG, ""), (5, "b", LONG, "")]
    want = sorted([(0, 0, "response", 0)] * 3 + [(0, len(LONG), "response", 0)] * 2 + [(3, 5, "response", 0)] * 3
                  + [(4, len(LONG), "revisit", 5)] * 2 + [(5, len(LONG), "response", 0)] * 2)
    for again, every_row in ((1, False), (2, True)):
        folder = new_folder(spark, "t")
        warc.write_archive(rows(spark, data * again), folder, every_row=every_row)
        got = [(r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_records(spark, folder).collect() if r.intact]
        assert sorted(got) == sorted(want * again)
        chunks = warc.read_chunks(spark, folder).where("last")
        assert chunks.select("record_id").distinct().count() == len(data) * again


def test_query_equals_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    from tivlens.llm.oracle import ORACLE
    from tivlens.llm.queries import QUERIES

    data = [(None, "a", LONG, ""), (None, "b", LONG, ""), (None, "b", None, ""), (None, "b", None, ""), (1, "u", LONG, ""),
            (1, "u", LONG, ""), (1, "v", LONG, ""), (2, "v", LONG, ""), (2, "v", LONG, ""), (3, None, "", ""), (3, None, "", "")]
    rows(spark, data).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to, intact"
    want = con.execute(f"SELECT {columns} FROM ({ORACLE['op7_warc']})").fetchall()
    got = [tuple(r) for r in QUERIES["op7_warc"](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
