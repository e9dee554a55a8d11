"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes counted in Spark.

1. Each task hashes every window of `width` words of its documents. Within a block of
   documents only the smallest doc_id of a window goes on to be compared; the others are
   settled there, so a passage that a third of all documents hold adds one entry per block to
   its bucket and not one per document.
2. Windows are dealt to buckets by a second hash, of words hashed independently of the first,
   packed as arrays (8 bytes of the first hash, a further byte of the second and about one of
   document id each). A bucket compares its windows, which are equal in all of it: 72 bits and
   log2(buckets) more. Over n windows two different ones are taken for equal with a probability
   of n**2 / 2**(73 + log2(buckets)): 1e-9 at 1 GB, 0.01 in all of 100 TB.
3. What repeats returns to its document as (doc_id, hash); the document, whose text crosses the
   network compressed, merges those windows into maximal removal intervals.

A null text has no words. Documents of fewer words than a window lose nothing. Rows that share
a doc_id are one owner: none of them is smaller than the other. Rows without a doc_id are
left alone and come back with their words kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import only, power_of_two, text_bytes
from sparkrank.llm.tokens import BASES, ZIPPED, Block, blocks, covered, mix, slices, sorted_runs, unzipped, window_hashes, zipped

#: Windows that a task collects before it settles and sends them.
FLUSH_WINDOWS = 600_000
#: Windows in a bucket, about.
BUCKET_WINDOWS = 1 << 16

_PACKED = "bucket int, settled boolean, hashes binary, more binary, docs binary, step int"


def _pack(bucket: int, settled: bool, hashes: np.ndarray, more: np.ndarray, docs: np.ndarray) -> tuple:
    """Documents in ascending order as the first and the steps, in the narrowest type that holds them."""
    steps = np.diff(docs)
    kind = np.min_scalar_type(int(steps.max())) if len(steps) else np.dtype(np.uint8)
    return bucket, settled, hashes.tobytes(), b"" if settled else more.tobytes(), docs[:1].tobytes() + steps.astype(kind).tobytes(), kind.itemsize


def _unpack(docs: bytes, step: int) -> np.ndarray:
    first = np.frombuffer(docs, dtype=np.int64, count=1)
    return np.cumsum(np.concatenate((first, np.frombuffer(docs, dtype=f"u{step}", offset=8).astype(np.int64))))


def _ordered(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by both hashes, and where each run of equal ones begins."""
    order = np.argsort(hashes, kind="stable")
    h, m = hashes[order], more[order]
    if ((h[1:] == h[:-1]) & (m[1:] != m[:-1])).any():
        order = np.lexsort((more, hashes))
        h, m = hashes[order], more[order]
    return order, np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (m[1:] != m[:-1]))))


def _settle(hashes: np.ndarray, seconds: np.ndarray, docs: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """seconds: the upper half of each window's second hash; its low byte goes along, the rest deals the window to its bucket."""
    order, starts = _ordered(hashes, seconds)
    h, s, d = hashes[order], seconds[order], docs[order]
    least = np.minimum.reduceat(d, starts)
    late = d != np.repeat(least, np.diff(np.append(starts, len(d))))
    # what is settled needs no comparison: it is dealt by its document
    salt = (mix(d[late].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    bucket = ((s[starts] >> np.uint32(8)) % np.uint32(n_buckets)).astype(np.int64)
    for settled, hs, ss, bs, ds in ((False, h[starts], s[starts], bucket, least), (True, h[late], s[late], salt, d[late])):
        if not len(hs):
            continue
        order = np.lexsort((ds, bs))
        hs, ms, bs, ds = hs[order], ss[order].astype(np.uint8), bs[order], ds[order]
        runs = sorted_runs(bs)
        for i, j in zip(runs, np.append(runs[1:], len(bs)), strict=True):
            yield _pack(int(bs[i]), settled, hs[i:j], ms[i:j], ds[i:j])


def _to_batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType], limit: int = 4096) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), limit):
        columns = zip(*rows[i : i + limit], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _windows(width: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bucket", "settled", "hashes", "more", "docs", "step"], [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        kept, size = [], 0

        def flush():
            hashes, seconds, docs = (np.concatenate(x) for x in zip(*kept, strict=True))
            yield from _to_batches(list(_settle(hashes, seconds, docs, n_buckets)), names, kinds)

        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = Block(texts)
                block.split()
                at = block.windows(width)
                if not len(at):
                    continue
                hashes = window_hashes(block.word_hashes(), at, width)
                seconds = window_hashes(block.word_hashes(1), at, width, BASES[0]) >> np.uint64(32)
                kept.append((hashes, seconds.astype(np.uint32), np.array(ids, dtype=np.int64)[block.doc[at]]))
                size += len(at)
                if size >= FLUSH_WINDOWS:
                    yield from flush()
                    kept, size = [], 0
        if kept:
            yield from flush()

    return run


def _repeats(group: pa.Table) -> pa.Table:
    """Of one bucket: (doc_id, hash) of each window that a smaller doc_id has too."""
    out_h, out_d, hashes, more, docs = [], [], [], [], []
    for settled, h, m, d, step in zip(*(group.column(c).to_pylist() for c in ("settled", "hashes", "more", "docs", "step")), strict=True):
        (out_h if settled else hashes).append(np.frombuffer(h, dtype=np.uint64))
        (out_d if settled else docs).append(_unpack(d, step))
        if not settled:
            more.append(np.frombuffer(m, dtype=np.uint8))
    if hashes:
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order, starts = _ordered(h, np.concatenate(more))
        h, d = h[order], d[order]
        late = d != np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(h))))
        out_h.append(h[late])
        out_d.append(d[late])
    return pa.table({"doc_id": pa.array(np.concatenate(out_d)), "hash": pa.array(np.concatenate(out_h).view(np.int64))})


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, packed, found = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            for own, part in blocks(ids, unzipped(sizes, packed)):
                yield _cut_block(own, part, found[at : at + len(own)], width, with_text)
                at += len(own)

    return run


def _cut_block(ids: list, texts: list[bytes], found: list, width: int, with_text: bool) -> pa.RecordBatch:
    gone: dict[int, np.ndarray] = {}
    some = [i for i, x in enumerate(found) if x]
    if some:
        block = Block([texts[i] for i in some])
        block.split()
        at = block.windows(width)
        hashes = window_hashes(block.word_hashes(), at, width)
        # a hash counts in its own document only
        salt = mix(np.arange(1, len(some) + 1, dtype=np.uint64))
        listed = np.concatenate([np.array(found[i], dtype=np.int64).view(np.uint64) ^ salt[k] for k, i in enumerate(some)])
        at = at[np.isin(hashes ^ salt[block.doc[at]], listed)]
        removed = covered(at, at + width, len(block.start))
        gone = {i: removed[f : f + n] for i, f, n in zip(some, block.first, block.n_words, strict=True)}
    n_words, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        n_words.append(len(words))
        if i in gone:
            mask = gone[i]
            n_spans.append(int(np.count_nonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)) == 1)))
            words = list(compress(words, (~mask).tolist()))
        else:
            n_spans.append(0)
        n_removed.append(n_words[-1] - len(words))
        kept = b" ".join(words)
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept)
    columns = {
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
    }
    if with_text:
        columns["kept_text"] = pa.array(kept_texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_pydict(columns)


def remove_repeated_windows(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, n_buckets: int | None = None) -> DataFrame:
    """Remove each word covered by a window of `width` words that a smaller doc_id has too.

    Returns one row per row of docs: doc_id, n_words, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with with_text, kept_text: the kept words joined by one space. n_buckets:
    by default as many as hold about BUCKET_WINDOWS windows each.
    """
    everything = only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    if n_buckets is None:
        n_buckets = power_of_two(text_bytes(everything) / 6 / BUCKET_WINDOWS, 64, 1 << 22)
    named = everything.where("doc_id is not null")
    packed = named.mapInArrow(_windows(width, n_buckets), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_repeats, "doc_id long, hash long")
    found = found.groupBy("doc_id").agg(F.collect_list("hash").alias("found"))
    own = named.mapInArrow(zipped, ZIPPED).join(found, "doc_id", "left").select("doc_id", "size", "zipped", "found")
    # rows without a doc_id would all meet in one task of the join
    nameless = everything.where("doc_id is null").select("doc_id", F.octet_length("text").alias("size"), F.col("text").alias("zipped"), F.lit(None).cast("array<bigint>").alias("found"))
    out = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return own.union(nameless).mapInArrow(_cut(width, with_text), out)
