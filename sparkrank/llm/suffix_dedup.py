"""Substring dedup over bytes with suffix arrays of shards.

A suffix array of one shard only sees what repeats inside it, so equal strings have to meet in
one shard first:

1. Anchors. Of the 40-byte strings in every 100-byte window the one with the least hash is an
   anchor (and all that tie with it): equal windows have the same anchor at the same place, and
   a text has one anchor in about 31 bytes. Around it lies its context, the up to 160 bytes of
   all windows that hold it. Only hashes of anchors and contexts, 12 bytes an anchor, are dealt
   to buckets by Spark.
2. Buckets. Of equal contexts the earliest stays and the others are removed whole - within a
   task already, so a passage in a third of all documents adds one entry per task. Anchors
   whose contexts are all equal need no more; those with several different contexts, as at the
   edges of what is repeated, go on, one context of each kind.
3. Shards. These contexts' bytes go to a shard by their anchor. A shard sorts their suffixes by
   induced sorting and computes the permuted common prefixes; neighbours that share 100 bytes
   are one class of windows, and all but the earliest of a class are removed.
4. An anchor with very many different contexts (a common line of under 100 bytes) is dealt by
   window instead: of windows equal in a task's batch all but the earliest leave as intervals,
   and Spark groups the earliest by a 128-bit digest. A bucket reads its entries as
   a stream and passes those of such an anchor on, so no task holds a group of unbounded size.
5. Each document merges its removed windows.

A null text is empty. Texts under 100 bytes lose nothing. Matches never cross documents. Rows
that share a doc_id are read as one document's repeated row and share one removal list. Rows
without a doc_id are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import only, power_of_two, text_bytes, written
from sparkrank.llm.suffix_array import permuted_common_prefixes, sort_suffixes
from sparkrank.llm.tokens import BASES, ZIPPED, Block, blocks, byte_sums, mix, powers, slices, sorted_runs, span_hash, spread, unzipped, zipped

#: Bytes of an anchor.
ANCHOR = 40
#: Anchors in a bucket and bytes of contexts in a shard, about.
BUCKET_ANCHORS, SHARD_BYTES = 1 << 15, 1 << 21
#: Anchors that a task collects before it sends them, and that a bucket holds before it looks for crowded ones.
FLUSH_ANCHORS, HELD_ANCHORS = 400_000, 4_000_000
#: An anchor with more different contexts than these is dealt by window.
MOST_CONTEXTS = 10_000


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i:i+width]."""
    step, out = 1, values
    while 2 * step <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def anchors(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor of a block: document index, hash, and its context's hash, start in the document and size."""
    n = len(block.buf)
    long = block.ends - block.begins >= length
    if n < length or not long.any():
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    sums = byte_sums(block.buf)
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(pow(BASES[0], -1, 1 << 64), n - ANCHOR + 1))
    rank = (hashes >> np.uint64(32)).astype(np.uint32)
    width = length - ANCHOR + 1
    least = _sliding(rank, width, np.minimum)  # least[i]: of the window that begins at byte i
    whole = np.zeros(len(least), dtype=bool)
    whole[spread(block.begins[long], block.ends[long] - block.begins[long] - length + 1)] = True
    least[~whole] = 0
    padded = np.concatenate((np.zeros(width - 1, dtype=np.uint32), least, np.zeros(width - 1, dtype=np.uint32)))
    most = _sliding(padded, width, np.maximum)  # most[i]: of the windows that hold the string at byte i
    at = np.flatnonzero((most[: len(rank)] == rank) & (rank > 0))
    doc = np.searchsorted(block.ends, at)
    begin, end = np.maximum(at + ANCHOR - length, block.begins[doc]), np.minimum(at + length, block.ends[doc])
    contexts = mix(span_hash(byte_sums(block.buf, BASES[1]), begin, end, BASES[1]) + (end - begin).astype(np.uint64))
    return doc, hashes[at], contexts, begin - block.begins[doc], end - begin


def _shuffled(x: np.ndarray) -> bytes:
    """Bytes of an array of integers, those of equal weight together, which compresses better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unshuffled(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T).view(kind).ravel()


_PACKED = "bucket int, settled boolean, n int, base long, hashes binary, contexts binary, docs binary, starts binary, sizes binary"


def _pack(bucket: int, settled: bool, own: np.ndarray, columns: tuple[np.ndarray, ...]) -> tuple:
    docs, hashes, contexts, starts, sizes = (c[own] for c in columns)
    base = int(docs.min())
    named = (b"", b"") if settled else (hashes.astype(np.uint32).tobytes(), contexts.tobytes())
    return bucket, settled, len(own), base, *named, _shuffled(docs - base), _shuffled(starts.astype(np.uint32)), sizes.astype(np.uint16).tobytes()


def _first_of_each(hashes: np.ndarray, contexts: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ordered by anchor, context and place, a place once; which of them open a new (anchor, context)."""
    order = np.lexsort((starts, docs, contexts, hashes))
    h, c, d, s = hashes[order], contexts[order], docs[order], starts[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))[: len(h)]
    again = np.concatenate(([False], ~fresh[1:] & (d[1:] == d[:-1]) & (s[1:] == s[:-1])))[: len(h)]
    return order[~again], fresh[~again]


def _packed_anchors(length: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush():
            columns = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
            docs, hashes, contexts, starts, _ = columns
            order, fresh = _first_of_each(hashes, contexts, docs, starts)
            bucket = np.where(fresh, hashes[order] >> np.uint64(32), mix(docs[order].astype(np.uint64))) % np.uint64(n_buckets)
            bucket = bucket.astype(np.int64) * 2 + ~fresh
            by = np.argsort(bucket, kind="stable")
            order, bucket = order[by], bucket[by]
            runs = sorted_runs(bucket)
            rows = [_pack(int(bucket[i]) // 2, bool(bucket[i] % 2), order[i:j], columns) for i, j in zip(runs.tolist(), np.append(runs[1:], len(order)).tolist(), strict=True)]
            kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            names = ["bucket", "settled", "n", "base", "hashes", "contexts", "docs", "starts", "sizes"]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, *rest = anchors(Block(texts), length)
                if not len(doc):
                    continue
                kept.append((np.array(ids, dtype=np.int64)[doc], *rest))
                size += len(doc)
                if size >= FLUSH_ANCHORS:
                    yield from flush()
                    kept, size = [], 0
        if size:
            yield from flush()

    return run


_FOUND = "doc_id long, start int, end int, hash long, crowded boolean"


def _found(docs, starts, sizes, hashes=None, crowded=None) -> pa.RecordBatch:
    """Intervals to remove, if hashes is None; else contexts to compare."""
    n = len(docs)
    starts = starts.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs, pa.int64()), pa.array(starts.astype(np.int32)), pa.array((starts + sizes).astype(np.int32)),
            pa.nulls(n, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)), pa.nulls(n, pa.bool_()) if crowded is None else pa.array(crowded, pa.bool_()),
        ],
        names=["doc_id", "start", "end", "hash", "crowded"],
    )


def _compare_bucket(columns: tuple[np.ndarray, ...], crowded: set[int], last: bool) -> tuple[list[pa.RecordBatch], tuple[np.ndarray, ...]]:
    """Settle what a bucket holds: equal contexts, crowded anchors and, at its end, which contexts to compare."""
    docs, hashes, contexts, starts, sizes = columns
    out = []
    if crowded:
        known = np.isin(hashes, np.fromiter(crowded, dtype=np.uint64))
        if known.any():
            out.append(_found(docs[known], starts[known], sizes[known], hashes[known], np.ones(int(known.sum()), dtype=bool)))
            docs, hashes, contexts, starts, sizes = (c[~known] for c in (docs, hashes, contexts, starts, sizes))
    order, fresh = _first_of_each(hashes, contexts, docs, starts)
    late, kinds = order[~fresh], order[fresh]
    out.append(_found(docs[late], starts[late], sizes[late]))
    docs, hashes, contexts, starts, sizes = (c[kinds] for c in (docs, hashes, contexts, starts, sizes))
    runs = sorted_runs(hashes)
    counts = np.diff(np.append(runs, len(hashes)))
    many = np.repeat(counts, counts)
    over = many > MOST_CONTEXTS
    crowded.update(hashes[over].tolist())
    take = over | (last & (many > 1))
    out.append(_found(docs[take], starts[take], sizes[take], hashes[take], over[take]))
    return out, tuple(c[~take] for c in (docs, hashes, contexts, starts, sizes))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets that come one after the other, in a stream."""
    current, held, size, crowded = None, [], 0, set()

    def settle(last: bool):
        nonlocal held, size
        if held:
            out, rest = _compare_bucket(tuple(np.concatenate(x) for x in zip(*held, strict=True)), crowded, last)
            held, size = [rest], len(rest[0])
            yield from out

    for batch in batches:
        for bucket, settled, n, base, hashes, contexts, docs, starts, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != current:
                yield from settle(True)
                current, held, size, crowded = bucket, [], 0, set()
            docs, starts, sizes = _unshuffled(docs, n, "i8") + base, _unshuffled(starts, n, "u4"), np.frombuffer(sizes, dtype=np.uint16)
            if settled:
                yield _found(docs, starts, sizes)
                continue
            # the bucket's number and 32 bits name an anchor
            named = np.frombuffer(hashes, dtype=np.uint32).astype(np.uint64) + (np.uint64(bucket) << np.uint64(32))
            held.append((docs, named, np.frombuffer(contexts, dtype=np.uint64), starts.astype(np.int64), sizes.astype(np.int64)))
            size += n
            if size >= HELD_ANCHORS:
                yield from settle(False)
    yield from settle(True)


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs: the row of each struct, and the structs' fields. A null list is empty."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), counts), *(c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())


_SHARDED = pa.schema([("shard", pa.int32()), ("hash", pa.int64()), ("context", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("window", pa.binary())])


def _window_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    sums = byte_sums(buf)
    return ((sums[length:] - sums[:-length]) * powers(pow(BASES[0], -1, 1 << 64), len(buf) - length + 1))[at]


def _crowded_windows(docs: np.ndarray, starts: np.ndarray, contexts: list[bytes], length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], list[bytes]]:
    """Of crowded anchors' contexts: the intervals of windows that begin earlier among them, and the earliest windows' places and bytes."""
    buf = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    at = spread(offsets, counts)
    if not len(at):
        return (at, at, at), (at, at), []
    doc, place = np.repeat(docs, counts), at + np.repeat(starts - offsets, counts)
    hashes = _window_hashes(buf, at, length)
    order = np.lexsort((place, doc, hashes))
    at, doc, place = at[order], doc[order], place[order]
    runs = sorted_runs(hashes[order])
    first = np.repeat(runs, np.diff(np.append(runs, len(at))))
    windows = np.lib.stride_tricks.sliding_window_view(buf, length)
    # of one hash, windows with other bytes than the first's are left to their digests
    same = np.concatenate([(windows[at[i : i + 65536]] == windows[at[first[i : i + 65536]]]).all(axis=1) for i in range(0, len(at), 65536)])
    early = ~same
    early[runs] = True
    late = same & ((doc != doc[first]) | (place != place[first]))  # two contexts may hold the first's place
    known, row = np.unique(doc[late], return_inverse=True)
    row, start, end = _merged(row, place[late], place[late] + length)
    return (known[row], start, end), (doc[early], place[early]), [w.tobytes() for w in windows[at[early]]]


def _contexts(length: int, n_shards: int):
    """Cut the contexts to compare, and the windows of crowded anchors; of windows that are equal in a batch, all but the earliest are settled."""

    def sharded(n: int, shard: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, anchor=None, context=None, window=None) -> Iterator[pa.RecordBatch]:
        columns = (shard.astype(np.int32), anchor, context, doc, start.astype(np.int32), size.astype(np.int32), window)
        for i in range(0, n, 8192):
            yield pa.RecordBatch.from_arrays([pa.nulls(min(8192, n - i), f.type) if c is None else pa.array(c[i : i + 8192], f.type) for c, f in zip(columns, _SHARDED, strict=True)], schema=_SHARDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settle():
            nonlocal held, size
            docs, starts, contexts = zip(*held, strict=True)
            held, size = [], 0
            (doc, start, end), (at, place), windows = _crowded_windows(np.array(docs, dtype=np.int64), np.array(starts, dtype=np.int64), contexts, length)
            yield from sharded(len(doc), doc % n_shards, doc, start, end - start)
            digests = [hashlib.blake2b(w, digest_size=16).digest() for w in windows]
            yield from sharded(len(at), at % n_shards, at, place, np.full(len(at), length), window=digests)

        for batch in slices(batches):
            ids, sizes, packed = (batch.column(i).to_pylist() for i in range(3))
            texts = unzipped(sizes, packed)
            owner, start, end, anchor, crowded = _listed(batch.column(3))
            cut = [texts[x][a:b] for x, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]
            docs = np.array(ids, dtype=np.int64)[owner]
            for i in np.flatnonzero(crowded).tolist():
                held.append((int(docs[i]), int(start[i]), cut[i]))
                size += len(cut[i])
                if size >= SHARD_BYTES:
                    yield from settle()
            rest = np.flatnonzero(~crowded.astype(bool))
            shard = mix(anchor[rest].view(np.uint64)) % np.uint64(n_shards)
            yield from sharded(len(rest), shard, docs[rest], start[rest], (end - start)[rest], anchor[rest], [cut[i] for i in rest.tolist()])
        if held:
            yield from settle()

    return run


_CONTEXT = "shard int, hash long, context binary, doc_id long, start int, size int, window binary"
_CUTS = "doc_id long, start int, end int, window binary"


def _sort_shard(length: int):
    def run(group: pa.Table) -> pa.Table:
        """Removed intervals of one shard; what is settled already, and the windows of crowded anchors, pass through."""
        settled = group.filter(pc.is_null(group["context"]))
        out = [pa.table([settled["doc_id"], settled["start"], pc.add(settled["start"], settled["size"]), settled["window"]], names=["doc_id", "start", "end", "window"])]
        group = group.filter(pc.is_valid(group["context"])).sort_by("hash")
        hashes, docs, starts = (group[c].to_numpy() for c in ("hash", "doc_id", "start"))
        sizes = pc.binary_length(group["context"]).to_numpy().astype(np.int64)
        runs = sorted_runs(hashes)
        begin, size = 0, 0
        for i, own in zip([*runs.tolist(), len(hashes)], [*(np.add.reduceat(sizes, runs).tolist() if len(runs) else []), 0], strict=True):
            if i == len(hashes) or (size and size + own > 2 * SHARD_BYTES):
                if i > begin:
                    buf = np.frombuffer(b"".join(group["context"][begin:i].to_pylist()), dtype=np.uint8)
                    found = later_windows(buf, docs[begin:i], starts[begin:i].astype(np.int64), sizes[begin:i], length)
                    out.append(pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int32()), strict=True)] + [pa.nulls(len(found[0]), pa.binary())], names=["doc_id", "start", "end", "window"]))
                begin, size = i, 0
            size += own
        return pa.concat_tables(out)

    return run


def _sieved(buf: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without what surely does not repeat: contexts, one after the other in buf, are cut to the windows whose hash occurs twice among them. The contexts that have any, and what is left of each in buf: its start and size."""
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    at = spread(offsets, counts)
    if not len(at):
        return at, at, at
    hashes = _window_hashes(buf, at, length)
    order = np.argsort(hashes)
    ordered = hashes[order]
    twice = np.zeros(len(at), dtype=bool)
    same = ordered[1:] == ordered[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice)
    owner = np.repeat(np.arange(len(sizes)), counts)[hit]
    first = sorted_runs(owner)
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    return owner[first], at[hit[first]], at[hit[last]] + length - at[hit[first]]


def later_windows(buf: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts, one after the other in buf: the document, start and end of the intervals of windows that also begin earlier, by a suffix array."""
    nothing = (np.zeros(0, dtype=np.int64),) * 3
    kept, begins, lengths = _sieved(buf, sizes, length)
    if not len(kept):
        return nothing
    docs, starts, sizes = docs[kept], starts[kept] + begins - (np.cumsum(sizes) - sizes)[kept], lengths
    # bytes are 2 and up, 1 separates contexts, 0 ends the shard
    offsets = np.cumsum(sizes + 1) - sizes - 1
    s = np.ones(int(sizes.sum()) + len(sizes) + 1, dtype=np.int16)
    s[-1] = 0
    s[spread(offsets, sizes)] = buf[spread(begins, sizes)].astype(np.int16) + 2
    sa = sort_suffixes(s, 258, apart=1)
    shared = permuted_common_prefixes(s, sa, apart=1)
    # runs of neighbours that share `length` symbols inside their context are one class of windows
    whole = np.zeros(len(s), dtype=bool)
    whole[spread(offsets, sizes - length + 1)] = True
    listed = sa[whole[sa]]
    fresh = shared[listed] < length
    # a suffix left out between two windows of a class would share the prefix too, so none is
    classes = np.cumsum(fresh) - 1
    owner = np.searchsorted(offsets, listed, side="right") - 1
    place = starts[owner] + listed - offsets[owner]
    rank = np.searchsorted(np.unique(docs), docs)
    key = (rank[owner] << np.int64(34)) + place
    first = np.minimum.reduceat(key, np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1]))))
    late = key > first[classes]
    at = np.sort(listed[late])
    if not len(at):
        return nothing
    begins = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    ends = np.append(begins[1:], len(at)) - 1
    owner = np.searchsorted(offsets, at[begins], side="right") - 1
    shift = starts[owner] - offsets[owner]
    return docs[owner], at[begins] + shift, at[ends] + shift + length


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of rows as maximal runs, in order; those that touch are one."""
    order = np.lexsort((start, owner))
    row = owner[order].astype(np.int64) << np.int64(32)
    start, end = row + start[order], np.maximum.accumulate(row + end[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1]))[: len(start)])
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return owner[order][first], start[first] - row[first], end[last] - row[first]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, packed = (batch.column(i).to_pylist() for i in (1, 2))
            texts = unzipped(sizes, packed)
            owner, start, end = _merged(*_listed(batch.column(3)))
            n_spans = np.bincount(owner, minlength=len(texts))
            gone = np.concatenate(([0], np.cumsum(end - start)))[np.concatenate(([0], np.cumsum(n_spans)))]
            kept = [[] for _ in texts]
            last = [0] * len(texts)
            for x, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True):
                kept[x].append(texts[x][last[x] : a])
                last[x] = b
            rest = [b"".join([*k, t[b:]]) if k else t for k, t, b in zip(kept, texts, last, strict=True)]
            columns = {
                "doc_id": batch.column(0), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "n_removed": pa.array(np.diff(gone), pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string()),
            }
            if with_text:
                columns["kept"] = pa.array(rest, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document. Returns one row per
    row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    with with_text, kept (binary: a cut may fall inside a character).
    """
    own = only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = text_bytes(own)
    n_buckets = power_of_two(total / 40 / BUCKET_ANCHORS, 64, 1 << 22)
    n_shards = power_of_two(total / SHARD_BYTES, 64, 1 << 22)
    named = own.where("doc_id is not null")
    packed = named.mapInArrow(_packed_anchors(length, n_buckets), _PACKED)
    # a bucket's entries come to one task one after the other, as a stream
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare, _FOUND)
    found = written(found, "anchors")
    compare = found.where("hash is not null").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "hash", "crowded")).alias("found"))
    # texts cross the network compressed
    packed_texts = named.mapInArrow(zipped, ZIPPED)
    contexts = packed_texts.join(compare, "doc_id").select("doc_id", "size", "zipped", "found").mapInArrow(_contexts(length, n_shards), _CONTEXT)
    cuts = written(contexts.groupBy("shard").applyInArrow(_sort_shard(length), _CUTS), "suffixes")
    # the windows of crowded anchors, one class per hash: the earliest stays
    crowded = cuts.where("window is not null")
    place = F.struct("doc_id", "start")
    earliest = crowded.groupBy("window").agg(F.min(place).alias("earliest"))
    late = crowded.join(earliest, "window").where(place > F.col("earliest")).select("doc_id", "start", "end")
    gone = cuts.where("window is null").select("doc_id", "start", "end").union(late).union(found.where("hash is null").select("doc_id", "start", "end"))
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    cut = packed_texts.join(gone, "doc_id", "left").select("doc_id", "size", "zipped", "gone")
    # rows without a doc_id would all meet in one task of the join
    nameless = own.where("doc_id is null").select("doc_id", F.octet_length("text").alias("size"), F.col("text").alias("zipped"), F.lit(None).cast(cut.schema["gone"].dataType).alias("gone"))
    return cut.union(nameless).mapInArrow(_cut(with_text), out)
