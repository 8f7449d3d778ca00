"""WARC archives: an index of records is made first, then sorted byte ranges are read by it.

Writing: payload digests decide which records are responses and which revisit one; then every task writes its
rows into one archive file in a shared folder and returns index rows (file, offset, length, URL, digest). A record
is a gzip member of its own, so a byte range can be read alone. A retried task writes a new file; the index names
only files of tasks that succeeded. Reading: the selected index rows are sorted by file and offset, neighbours are
joined into one read up to a bound, and records are parsed from the bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import fresh_path, keep

MIN_BYTES = 1000
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 16 << 20  # bytes of records that one task reads
# Fixed values of the WARC 1.0 format.
VERSION = "WARC/1.0"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAME = "urn:page:"
NAMELESS = "urn:page"  # of a page without an id

INDEX = "page_id {id}, file string, offset long, length long, url string, payload_digest string, record_type string"
RECORDS = "page_id {id}, url string, record_type string, payload_digest string, refers_to {id}, payload binary"


def shared(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def with_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds to (id, url, html) the payload digest, ``record_type`` and, for a revisit, ``refers_to``.

    Of equal payloads of at least ``min_bytes`` the largest id is the response. Copies are counted by digest and
    length before they meet (map-side aggregate), so one group of copies never gathers in a task.
    """
    payload = F.col("html").cast("binary")
    rows = pages.withColumn("digest", F.sha1(payload)).withColumn("bytes", F.octet_length("html").cast("long"))
    winners = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # Two steps keep the payload out of the join on the digest, where a group of copies is a hot key.
    revisits = (
        rows.select("id", "digest", "bytes")
        .join(winners, ["digest", "bytes"])
        .where(~F.col("id").eqNullSafe(F.col("winner")))
        .select("id", "digest", "winner")
        .distinct()
    )
    named = revisits.select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), "winner")
    own = (F.col("digest") == F.col("of_digest")) & F.col("id").eqNullSafe(F.col("of"))
    return rows.join(named, own, "left").select(
        "id", "url", "html", "digest",
        F.when(F.col("winner").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("winner").alias("refers_to"),
    )


def _record(page, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    head = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{NAMELESS if page is None else f'{NAME}{page}'}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    body = payload
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def _parse(record: bytes, as_id) -> tuple:
    data = gzip.decompress(record)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a record")

    def named(key: str):
        uri = fields.get(key, f"<{NAMELESS}>")[1:-1]
        return None if uri == NAMELESS else as_id(uri.removeprefix(NAME))

    kind = fields["WARC-Type"]
    return (
        named("WARC-Record-ID"), unquote(fields["WARC-Target-URI"]), kind,
        fields["WARC-Payload-Digest"].removeprefix("sha1:"), named("WARC-Refers-To"),
        None if kind == "revisit" else rest[:size],
    )


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages as records below ``folder`` and returns the index, which is kept.

    Null html is an empty payload, a null URL an empty one. Rows that repeat an id and payload are each written,
    with the same type. A page without an id is written under a name without one, revisits the largest id of its copies
    if they have any, and is never revisited. An empty table writes nothing. Ids are integers or strings without line breaks.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = shared(folder)
        store.create_dir(path, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                places = []
                for page, url, html, digest, kind, refers_to in zip(*(batch.column(i) for i in range(6))):
                    record = _record(page.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), kind.as_py(), refers_to.as_py())
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(record)
                    places.append((at, len(record)))
                    at += len(record)
                offsets, lengths = zip(*places) if places else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), pa.array([name] * len(places), pa.string()),
                        pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                        batch.column("url"), batch.column("digest"), batch.column("record_type"),
                    ],
                    ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"],
                )
        finally:
            if out:
                out.close()

    return keep(with_types(rows, min_bytes).mapInArrow(run, INDEX.format(id=id_type)))


def read(index: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the index rows name, read in coalesced byte ranges in the order of file and offset.

    A single read joins ranges up to ``read_bytes`` that lie at most ``gap_bytes`` apart; a longer record is one
    read. The result has one row per index row; a revisit has no payload, a page without an id none, and an empty index
    gives no rows.
    """
    id_type = index.schema["page_id"].dataType.simpleString()
    as_id = str if id_type == "string" else int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = shared(folder)
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            ranges = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            types = [batch.schema.field(3).type, pa.string(), pa.string(), pa.string(), batch.schema.field(3).type, pa.binary()]
            for joined in _coalesced(ranges, read_bytes, gap_bytes):
                name, start = joined[0][:2]
                with store.open_input_file(f"{path}/{name}") as file:
                    file.seek(start)
                    data = file.read(joined[-1][1] + joined[-1][2] - start)
                found = [_parse(data[at - start : at - start + n], as_id) for _, at, n in joined]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    ordered = index.select("file", "offset", "length", "page_id")
    # Index rows are small beside their records, so the records' bytes say how many tasks read them.
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1
    ordered = ordered.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORDS.format(id=id_type))


def _coalesced(ranges: list[tuple], read_bytes: int, gap_bytes: int) -> Iterator[list[tuple]]:
    run: list[tuple] = []
    for name, at, n in ranges:
        if run and (name != run[-1][0] or at - run[-1][1] - run[-1][2] > gap_bytes or at + n - run[0][1] > read_bytes):
            yield run
            run = []
        run.append((name, at, n))
    if run:
        yield run


def archive_folder(spark) -> str:
    return fresh_path(spark, "warc")
