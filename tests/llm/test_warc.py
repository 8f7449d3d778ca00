import gzip
import hashlib
from pathlib import Path

from leafmill.llm import warc
from leafmill.llm.queries import CHECKS, op9_warc
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, bytes long, offset long, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


ROWS = [
    (1, "http://a/é?x=%41&y z", "p" * 1000), (2, "http://b", "p" * 1000), (3, "http://c\r\nX: y", "é" * 500), (4, "http://d", "é" * 500),
    (5, None, None), (6, "", ""), (7, "u", "short"), (8, "u", "short"), (9, "big", "q" * 9_000_000), (10, "http://e", "p" * 1000), (10, "http://e", "p" * 1000),
]


def test_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages(spark, ROWS).repartition(3), folder)
    records = warc.read(index, folder, read_bytes=5_000).collect()
    assert len(records) == len(ROWS)
    urls = {i: u or "" for i, u, _ in ROWS}
    bodies = {i: (h or "").encode() for i, _, h in ROWS}
    for r in records:
        assert r.url == urls[r.page_id]
        assert r.payload_digest == hashlib.sha1(bodies[r.page_id]).hexdigest()
        refers_to = {1: 10, 2: 10, 3: 4}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", refers_to) if refers_to else ("response", None))
        assert r.payload is None if refers_to else bytes(r.payload) == bodies[r.page_id]


def test_pages_without_an_id(spark, tmp_path):
    """They revisit a copy that has one; copies without any id are all responses."""
    folder = f"file://{tmp_path}/warc"
    long, other = "n" * 1500, "m" * 1500
    rows = [(None, "http://a", long), (None, "http://b", long), (7, "http://c", long), (3, "http://d", long), (None, "x", other), (None, "y", other), (None, None, None)]
    found = warc.read(warc.write(pages(spark, rows), folder), folder).collect()
    assert sorted((r.page_id or 0, r.url, r.record_type, r.refers_to or 0, len(r.payload or b"")) for r in found) == [
        (0, "", "response", 0, 0), (0, "http://a", "revisit", 7, 0), (0, "http://b", "revisit", 7, 0),
        (0, "x", "response", 0, 1500), (0, "y", "response", 0, 1500), (3, "http://d", "revisit", 7, 0), (7, "http://c", "response", 0, 1500),
    ]


def test_index_finds_single_records(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages(spark, ROWS), folder)
    chosen = index.where("page_id in (4, 7)")
    assert {r.page_id: bytes(r.payload) for r in warc.read(chosen, folder).collect()} == {4: ("é" * 500).encode(), 7: b"short"}
    row = index.where("page_id = 7").first()
    data = Path(tmp_path, "warc", row.file).read_bytes()[row.offset : row.offset + row.length]
    assert gzip.decompress(data).startswith(b"WARC/1.0\r\nWARC-Type: response\r\n")


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    assert warc.read(warc.write(pages(spark, ROWS).limit(0), folder), folder).count() == 0


def test_ranges_are_joined():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 5), ("b", 105, 5), ("b", 110, 90), ("b", 200, 1)]
    assert [[r[1] for r in run] for run in warc._coalesced(ranges, 60, 8)] == [[0, 10, 25], [100], [105], [110], [200]]


def test_whole_table(spark):
    assert difference(op9_warc(spark, FOLDER).toPandas(), duck(FOLDER).execute(CHECKS["op9_warc"]).df()) is None
