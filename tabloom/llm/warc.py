"""WARC archives: written with an index of their records, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import counted, partitions, qualified, scratch, small_batches, tidied, written

#: Bytes after which a task begins another archive; the largest gap that one read runs over, and the largest read.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 1 << 30, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|") if url else "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields and payload of one record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload_bytes": length, "payload": None if fields["WARC-Type"] == "revisit" else payload}


def _open(base: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a qualified folder."""
    return fs.FileSystem.from_uri("file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base)


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, keeper: of equal payloads of `least` bytes or more, the largest page_id.

    Only digests are shuffled to find the payloads that occur again; one of a third of all rows is a few partial counts
    by then. Their table is broadcast while it is small, so that no payload moves. Beyond that payloads meet it in a
    join whose large partitions Spark may split."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    sized = sized.withColumn("sha1", F.unhex(F.sha1("payload")))
    again = sized.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    keepers = counted(written(again.where("n > 1").drop("n"), "keepers"))
    return sized.join(keepers, "sha1", "left").drop("sha1")


def write_archives(marked: DataFrame, base: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes an archive per task (and `archive_bytes`) under base, a gzip member per record, and returns the index:
    file, offset, length, url, digest and type of each record. The index is written before it is used. A task that
    runs again writes files of new names; only the files in the index of a finished task are ever read."""
    schema = T._parse_datatype_string(INDEX)
    base = qualified(marked.sparkSession, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(base)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page_id, url, payload, keeper = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "keeper"))
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                revisit = keeper is not None and keeper != page_id
                refers = keeper if revisit else None
                member = gzip.compress(record(page_id, url, payload, refers, revisit), 6, mtime=0)
                out.write(member)
                rows.append((page_id, url, name, at, len(member), digest(payload), "revisit" if revisit else "response", refers, len(payload)))
                at += len(member)
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            types = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)
        if out is not None:
            out.close()

    return written(marked.mapInArrow(tidied(run), schema), "warc-index")


def ranges(offsets: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """(start, stop, records) of the reads that cover sorted (offset, length) pairs: neighbours share a read."""
    out: list[list[int]] = []
    for offset, length in offsets:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2] += 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(r) for r in out]


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html binary"


def read_records(index: DataFrame, base: str) -> DataFrame:
    """The records of the index rows given. Rows are sorted by file and offset over the tasks, so that each task reads
    long ranges of few files. html is null for a revisit; its digest is the one in its header."""
    schema = T._parse_datatype_string(READ)
    base = qualified(index.sparkSession, base)
    order = ["file", "offset"]
    sorted_ = index.select("file", "offset", "length", "url").repartitionByRange(partitions(index.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(base)
        for batch in batches:
            files, offsets, lengths, urls = (batch.column(c).to_pylist() for c in ("file", "offset", "length", "url"))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                with store.open_input_file(f"{root}/{files[i]}") as f:
                    k = i
                    for start, stop, n in ranges(list(zip(offsets[i:j], lengths[i:j], strict=True))):
                        held, rows = f.read_at(stop - start, start), []
                        for m in range(k, k + n):
                            r = parse(gzip.decompress(held[offsets[m] - start : offsets[m] - start + lengths[m]]))
                            h = r["fields"]
                            sha = h["WARC-Payload-Digest"].removeprefix("sha1:") if r["payload"] is None else digest(r["payload"])
                            refers = _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                            rows.append((_page(h["WARC-Record-ID"]), urls[m], h["WARC-Type"], refers, r["payload_bytes"], sha, r["payload"]))
                        k += n
                        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema.names)
                i = j

    return sorted_.mapInArrow(tidied(run), schema)


def round_trip(pages: DataFrame, base: str | None = None, least: int = 0) -> DataFrame:
    """Archives all pages, then reads every record back: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and html.

    A null html is an empty payload; empty payloads are equal to each other. Rows that repeat the largest page_id of
    their payload are responses both; a null page_id is never the largest, and a payload with only null ids has
    responses only. A null url is archived as about:blank and comes back as null; other columns are ignored; an empty
    table gives no row.
    """
    small_batches(pages.sparkSession)
    base = base or f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(mark_revisits(pages, least), base), base)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_KEEPERS = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'response' ELSE 'revisit' END AS record_type
FROM pages
"""
