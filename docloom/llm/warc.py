"""WARC archives: one gzip member per record, written and read back.

The reader is sequential: it inflates a file step by step, takes one gzip
member as one record, frames its block by Content-Length, and verifies block
and payload digests.  It holds one record at a time.

Defined cases: a null payload is empty; payloads under ``least`` bytes are
never deduplicated; of equal payloads the smallest id (nulls last) is the
response, in each row that has that id; rows that repeat an id are a record
each; a page is held whole, once, so memory follows the longest page; an empty
table gives no archive and no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, scratch_path, ship

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_SALTS = 32


class WarcError(ValueError):
    """A record that breaks the format, or whose digest doesn't match."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes | None = field(default=None)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` without the payload."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if url:
        headers.append(("WARC-Target-URI", "".join(c for c in url if c >= " ")))
    block = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    return member(headers, block)


def read_records(stream, step: int = 1 << 16) -> Iterator[Record]:
    """Records of an open archive, one after the other."""
    rest = b""
    while True:
        rest = rest or stream.read(step)
        if not rest:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            try:
                parts.append(inflate.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"no gzip member: {e}") from e
            rest = inflate.unused_data if inflate.eof else stream.read(step)
            if not inflate.eof and not rest:
                raise WarcError("the file ends within a member")
        yield parse_record(b"".join(parts))


def parse_record(data: bytes) -> Record:
    """Frame one record by its Content-Length and verify its digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the block")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise WarcError("block digest doesn't match")
    record = Record(headers, block)
    if headers["WARC-Type"] == "response":
        record.payload = block.partition(b"\r\n\r\n")[2]
        if f"sha256:{hashlib.sha256(record.payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
            raise WarcError("payload digest doesn't match")
    return record


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Add payload_digest and refers_to (null: a response) to (page_id, url, html).

    Only ids and digests are grouped.  A digest that a third of all pages
    share is summed up before the shuffle, and met again salted.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumn("payload_digest", F.sha2(html, 256))
    narrow = keyed.where(F.octet_length(html) >= least).select("page_id", "payload_digest")
    repeated = (
        narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    met = salted.join(repeated, ["payload_digest", "salt"], "left").drop("salt")
    return met.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, most: int = 64 << 20) -> DataFrame:
    """Write (page_id, url, html, payload_digest, refers_to) as archives; the manifest.

    Each task writes its own files, of about ``most`` bytes, under names that
    no other attempt uses.  The manifest, stored when this returns, lists the
    files of the attempts that succeeded; others are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count, files = None, "", 0, 0, []

        def close() -> None:
            out.close()
            files.append((name, count, size))

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                data = page_record(page_id, url, (html or "").encode(), digest, refers_to)
                if out is not None and size + len(data) > most:
                    close()
                    out = None
                if out is None:
                    name, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            close()
        kinds = (pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([f[k] for f in files], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "records", "bytes"])

    rows = pages.select("page_id", "url", "html", "payload_digest", "refers_to")
    return materialize(rows.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the manifest's archives: one row per record, digests verified.

    Columns: page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda urn: int(x) if urn and (x := urn[len("<urn:page:") : -1]) else None
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        length = len(r.payload) if r.payload is not None else int(h["WARC-Payload-Length"])
                        rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), r.payload, length, h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                        held, seen = held + len(r.block), seen + 1
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != records:
                    raise WarcError(f"{name} has {seen} records, the manifest {records}")
                yield batch_of(rows)

    files = max(1, manifest.count())
    dealt = manifest.select("file", "records").repartition(min(files, 10_000), "file")
    return dealt.mapInArrow(
        read,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    ship(pages.sparkSession)
    folder = scratch_path(pages.sparkSession, "warc")
    rows = with_revisits(pages.select(F.col("page_id").cast("long"), "url", "html"), least)
    return read_archives(write_archives(rows, folder), folder)
