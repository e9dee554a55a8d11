"""WARC archives: write with an index, read back by coalesced byte ranges.

Writing, each task makes archives of gzip members, one record each, in the shared folder, and
returns an index row per record: archive, offset, length, url, digest. The index is written as
a table; only what it lists is ever read, so archives of attempts that were lost do no harm.
Archive names are unique to an attempt.

Reading, index rows are dealt by range of (archive, offset) and sorted, and a task reads runs
of neighbouring records with one request each.

Of records with equal payloads of at least SMALLEST bytes, the one with the least page_id is a
response and the others are revisits of it; a repeated row of that page_id is a response too.
Rows without a page_id are responses. A null payload is empty; a null url has no target line.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import join_hot, only, shared_folder, written

#: Payloads under so many bytes are never revisits.
SMALLEST = 100
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 1 << 30
#: Records with so small a gap between them are read with one request, of this size at most if of several records.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
#: So many revisits, some 30 MB, may go to every task; more are dealt to the pages' payloads by a shuffle.
BROADCAST_REVISITS = 250_000
#: Date and profile of the records.
DATE, PROFILE = "2000-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, page_id long, url string, digest string"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the head of its response, with the full length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#!~*()-_.%[]')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Type, ids, digest, payload and its full length of one record; a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if (x := fields[name][len("<urn:x-page:") : -1]) == "none" else int(x)
    out = {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": None}
    out |= {"payload_digest": fields["WARC-Payload-Digest"].partition(":")[2], "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": payload}
    if out["record_type"] == "revisit":
        out |= {"refers_to": number("WARC-Refers-To"), "payload": None}
    elif len(payload) != out["payload_bytes"] or hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def _zipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, offset = "", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = _zipped(record(page_id, url, payload, digest, refers_to))
                    out.write(data)
                    rows.append((f"{folder}/{name}", offset, len(data), page_id, url, digest))
                    offset += len(data)
                # the rows of an archive count once its bytes are in place
                if out is not None:
                    out.flush()
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "offset", "length", "page_id", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row; the index of what was written, as a table in the shared folder."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    own = only(pages, page_id=page_id, url=url, html=html).select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # whose payload a smaller page_id has too; ids and digests only, so that no payload moves for it
    light = own.where((F.octet_length("payload") >= SMALLEST) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n")).where("refers_to < last").drop("last")
    revisits = join_hot(light, written(first, "payloads"), ["digest"], "n").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = written(revisits, "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    typed = own.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    return written(typed.mapInArrow(_write(folder), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, file = None, None
    try:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                archive, begin, length = rows[at]
                end, stop = begin + length, at + 1
                while stop < len(rows) and rows[stop][0] == archive and rows[stop][1] - end <= GAP_BYTES and rows[stop][1] + rows[stop][2] - begin <= READ_BYTES:
                    end = rows[stop][1] + rows[stop][2]
                    stop += 1
                if archive != opened:
                    if file is not None:
                        file.close()
                    system, path = fs.FileSystem.from_uri(archive)
                    opened, file = archive, system.open_input_file(path)
                data = file.read_at(end - begin, begin)
                found = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n in rows[at:stop]]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)
                at = stop
    finally:
        if file is not None:
            file.close()


def read_warc(index: DataFrame) -> DataFrame:
    """The records of the index rows given: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    parts = max(spark.sparkContext.defaultParallelism, int(total >> 26))
    dealt = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
