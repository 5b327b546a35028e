"""WARC archives: write one gzip member per record, read them back in sequence.

Writing: the payload digest of every page is a column, the smallest page_id
per digest is an aggregation, and each task streams its rows into archives of
about ``ARCHIVE_BYTES`` under a folder that all executors share.  A page whose
digest has an earlier page becomes a revisit record without payload.  A task
writes under names of its own attempt and reports them; only reported
archives are read, so a lost or repeated attempt leaves files that nobody
reads.

Reading: one archive after the other is read in chunks of ``CHUNK`` bytes;
``zlib`` inflates member by member, each member is framed by its
Content-Length, and block and payload digests are verified.  Memory follows
the longest record, not the archive.

Defined cases: a null html counts as empty and a null url is left out of the
record; all rows that carry the smallest page_id of their payload are
responses; a row without page_id is a response only if no row of its payload
has one; an empty table writes nothing and gives an empty result; other
columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.session import materialize, scratch_folder

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, payload_digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, whose
    Content-Length is the full payload's, and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def members(stream):
    """The inflated bytes of each gzip member, in order, reading CHUNK bytes at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data if inflate.eof else stream.read(CHUNK)
            if not rest and not inflate.eof:
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; Content-Length frames the block, and both digests are verified."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("record is longer or shorter than its Content-Length")
    if headers["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["WARC-Payload-Digest"] != "sha1:" + digest(payload):
            raise ValueError("payload digest differs")
    return headers, block


def _filesystem(folder: str):
    """(file system, path) of a folder URI; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else "file://" + folder)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Write the archives under ``folder`` (shared by all executors) and return their names and record counts."""
    rows = pages.select(F.col(key).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("__html"))
    # decisions are made on (id, digest) alone; payloads move once, and unsorted: the decisions of a partition are the
    # side that is hashed, the pages stream past them
    keys = rows.filter(F.octet_length("__html") >= min_bytes).select("__id", F.unhex(F.sha1("__html")).alias("__digest"))
    first = (keys.groupBy("__digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
             .filter("__n > 1 AND __first IS NOT NULL").drop("__n"))
    again = keys.join(first, "__digest").filter(~F.col("__id").eqNullSafe(F.col("__first")))
    again = again.select(F.col("__id").alias("__rid"), F.col("__digest").alias("__rdigest"), "__first").distinct()
    rows = rows.join(again.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__rid"))
                     & (F.unhex(F.sha1("__html")) == F.col("__rdigest")), "left").select("__id", "__url", "__html", "__first")

    def run(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        for b in batches:
            ids, urls, texts, firsts = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}")
                payload, ref = texts[i].as_py().encode(), firsts[i].as_py()
                member = record(ids[i].as_py(), urls[i].as_py(), payload, digest(payload), ref, ref is not None)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})

    return materialize(W.map_batches(rows, run, "archive string, n_records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the named archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    n = archives.count()
    spread = archives.select("archive").repartition(max(1, min(n, 100_000)), "archive")

    def run(batches):
        fs, base = _filesystem(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        number = lambda uri: int(uri[len("<urn:page:"):-1]) if uri and uri != "<urn:page:>" else None
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}") as stream:
                    for raw in members(stream):
                        h, block = parse(raw)
                        http = dict(x.split(": ", 1) for x in block.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                        rows.append((number(h["WARC-Record-ID"]), int(http["Content-Length"]),
                                     h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"],
                                     number(h.get("WARC-Refers-To")), h.get("WARC-Target-URI")))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return W.map_batches(spread, run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                      "refers_to long, url string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the cluster's shared folder and read them back."""
    folder = scratch_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes=min_bytes), folder)
