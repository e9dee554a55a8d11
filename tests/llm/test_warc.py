import gzip
import hashlib

from pyarrow import fs

from sparkrank.llm import warc
from sparkrank.llm.warc import read_warc, write_warc


def pages():
    big, other = "<p>é" + "x" * 200, "y" * 99
    rows = [(3, "http://a/ä b", big), (1, None, big), (2, "http://b\r\nX: y", "<p>WARC/1.1\r\n\r\nContent-Length: 5"), (4, "u", None), (5, "u", ""), (6, "v", other), (7, "v", other), (8, "w", big), (1, "again", big)]
    return [*rows, (None, "n", big), (9, "z", "\r\n\r\n" * 100)]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "").encode() == data]
        first = min(same, default=None)
        revisit = i is not None and len(data) >= 100 and i > first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    rows = pages()
    index = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is None or r.payload else b"") for r in read_warc(index).collect()), key=repr)
    assert got == brute(rows)
    # a selection reads what it lists only
    assert sorted(r.page_id for r in read_warc(index.where("page_id in (3, 6)")).collect()) == [3, 6]
    # archives are sequences of gzip members that any reader can unpack
    listed = index.collect()
    system, path = fs.FileSystem.from_uri(listed[0].archive)
    data = gzip.decompress(system.open_input_file(path).read())
    assert data.count(b"WARC/1.1\r\nWARC-Type") == sum(r.archive == listed[0].archive for r in listed)


def test_small_archives_and_requests(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    rows = pages()
    index = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert index.select("archive").distinct().count() > 3
    assert read_warc(index).count() == len(rows)


def test_long_payload_clashing_names_and_shuffled_revisits(spark, monkeypatch):
    """Revisits too many to send to every task give the same records; extra columns may have any name."""
    rows = [(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, "u", "z" * 150), (4, None, "z" * 150), (4, None, "z" * 150)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "7 AS payload", "1 AS refers_to", "2 AS n")
    for most in (250_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in read_warc(write_warc(frame)).collect()), key=repr)
        assert got == brute(rows)


def test_empty(spark):
    index = write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and read_warc(index).count() == 0
