"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. A text becomes its lower-case words (letters and digits), joined by one space; texts equal in
   that, by a 128-bit digest of it, are one text from here on.
2. A text's five-word shingles are labelled with their occurrence number. Each of SKETCHES hash
   functions picks the PICKS least labelled shingles; a sketch is their hash in text order, so
   it agrees for texts that are similar as sequences, not just as sets. Short texts, whose picks
   are a good part of all they hold, get twice as many sketches.
3. Texts with a sketch in common form a bucket. Buckets with the same members count once.
4. In a bucket, two texts that no link connects yet are aligned: M shingles in common order, of
   n and m, give the similarity M / (n + m - M), the Jaccard index of sequences. Only matches
   inside the band that the threshold allows are counted. The links found span each component.
5. A hot bucket, of more than BUCKET texts or BUCKET_SHINGLES shingles, is cut into blocks, and
   the bucket's first text joins each of them. What a block connects to the first text is
   settled among itself, in all blocks; only a text that is not connected to it has to meet the
   other blocks. So a group of copies costs what it holds, once, and nothing is left out.
6. Star contraction turns links into classes; a class is named after its least doc_id.

A null text has no words, and texts without words are equal. A text of one to four words is a
single shingle. Rows without a doc_id are a class of their own each (class_id null).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.components import connected_components
from sparkrank.llm.shared import join_hot, only, small_batches, written
from sparkrank.llm.tokens import Block, blocks, mix, slices, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Sketches per text and labelled shingles in each: two texts of similarity 0.8 share none with probability 0.001.
SKETCHES, PICKS = 10, 3
#: Texts with so many shingles at most are short. Beyond, the picks are nearly independent; a short text and one that is similar share the longer list.
SHORT = 25
#: Texts, and shingles of theirs, in a bucket that is compared as a whole, and in each block of a hot one.
BUCKET, BUCKET_SHINGLES = 512, 1 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of every shingle of a block, and where each document's begin."""
    words = block.word_hashes()
    at = block.windows(width)
    hashes, doc = window_hashes(words, at, width), block.doc[at]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < width))
    if len(short):  # the whole text is one shingle
        extra = np.array([window_hashes(words, np.array([block.first[i]]), int(block.n_words[i]))[0] for i in short], dtype=np.uint64)
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], np.concatenate((hashes, extra))[order]
    return hashes, doc, np.searchsorted(doc, np.arange(len(block.texts) + 1))


def labelled(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that tell apart the occurrences of a shingle in its document."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    out = np.empty_like(hashes)
    out[order] = mix(h + (np.arange(len(h)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def order_min_hashes(keyed: np.ndarray, bounds: np.ndarray, sketches: int, picks: int, skipped: int = 0) -> np.ndarray:
    """One row per document with its sketches, after the first `skipped` ones; documents without shingles have rows of zeros."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, sketches), dtype=np.uint64)
    if not len(some):
        return out
    starts, counts = bounds[some], np.diff(bounds)[some]
    owner = np.repeat(np.arange(len(some)), counts)
    for k in range(skipped, skipped + sketches):
        keys = mix(keyed ^ mix(np.array([k + 1], dtype=np.uint64))[0])
        places, values = [], []
        for _ in range(picks):
            least = np.minimum.reduceat(keys, starts)
            hit = np.flatnonzero(keys == least[owner])
            first = hit[np.searchsorted(owner[hit], np.arange(len(some)))]
            places.append(np.where(least == _NONE, len(keys), first))
            values.append(np.where(least == _NONE, np.uint64(0), keyed[first]))
            keys[first] = _NONE
        order = np.argsort(np.array(places), axis=0, kind="stable")
        picked = np.take_along_axis(np.array(values), order, axis=0)
        sketch = np.full(len(some), k + 1, dtype=np.uint64)
        for row in picked:
            sketch = mix(sketch * np.uint64(31) + row)
        out[some, k - skipped] = sketch
    return out


def _word_bytes() -> bytes:
    """Every byte outside words as a space."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its words joined by one space, packed for the way, and a digest of that."""
    table, codec = _word_bytes(), pa.Codec("zstd", 1)
    for batch in slices(batches):
        words = [b" ".join(t.lower().encode().translate(table).split()) for t in batch.column(1).to_pylist()]
        digests = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
        packed = [len(w).to_bytes(4, "little") + codec.compress(w, asbytes=True) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "digest", "words"])


def _unpacked(packed: list[bytes]) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(p[4:], int.from_bytes(p[:4], "little"), asbytes=True) for p in packed]


def _sequences(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shingle hashes of texts, in blocks: the first text's place, hashes, and owner and bounds in the block."""
    for places, part in blocks(list(range(len(words))), words):
        block = Block(part)
        block.split()
        yield places[0], *shingles(block, SHINGLE)


def _sketches(sketches: int, picks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for at, hashes, doc, bounds in _sequences(_unpacked(batch.column(1).to_pylist())):
                keyed, size = labelled(hashes, doc), np.diff(bounds)
                own = ids[at : at + len(size)]
                short = size <= SHORT
                few = keyed[np.repeat(short, size)]
                parts = [(own, size, order_min_hashes(keyed, bounds, sketches, picks)), (own[short], size[short], order_min_hashes(few, np.concatenate(([0], np.cumsum(size[short]))), sketches, picks, sketches))]
                for who, n, found in parts:
                    some = n > 0
                    columns = [np.repeat(who[some], sketches), found[some].view(np.int64).ravel(), np.repeat(n[some], sketches).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "sketch", "size"])

    return run


def aligned(a: list[int], b: list[int], threshold: float) -> bool:
    """Whether M / (n + m - M) reaches the threshold, M being the most shingles of a and b that align in order.

    Each row of the alignment is one integer whose bits are the columns; matches outside the
    band that the threshold allows are masked out.
    """
    n, m = len(a), len(b)
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    low = 0
    while low < n and low < m and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and high < m - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    a, b, common = a[low : n - high], b[low : m - high], low + high
    if common >= need:
        return True
    if common + min(len(a), len(b)) < need:
        return False
    matches: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        matches[x] |= 1 << i
    band = int(n + m - 2 * need) + 1  # more insertions and deletions than these miss the threshold
    full = (1 << len(a)) - 1
    width = (1 << (2 * band + 1)) - 1
    v = full
    for j, x in enumerate(b):
        row = matches.get(x, 0)
        if row:
            row &= width << (j - band) if j >= band else width >> (band - j)
            u = v & row
            v = ((v + u) | (v - u)) & full
    return common + len(a) - v.bit_count() >= need


def link_bucket(words: list[bytes], threshold: float, sides: list[int] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Links, as pairs of places, that span the components of a bucket's (packed) texts, and each text's component.

    sides: two texts of one side are not compared, for another task does that.
    """
    held: list[np.ndarray] = []
    for _, hashes, _, bounds in _sequences(_unpacked(words)):
        held += [hashes[i:j].copy() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    sets = [set(labelled(s, np.zeros(len(s), dtype=np.int64)).tolist()) for s in held]
    root = list(range(len(words)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(len(words)):
        for j in range(i):
            if (sides and sides[i] == sides[j]) or find(i) == find(j):
                continue
            n, m = len(sets[i]), len(sets[j])
            if min(n, m) < threshold * max(n, m):
                continue
            common = len(sets[i] & sets[j])  # no alignment matches more
            if common < threshold * (n + m - common) - 1e-9:
                continue
            if aligned(held[i].tolist(), held[j].tolist(), threshold):
                root[find(i)] = find(j)
                links.append((i, j))
    return links, [find(i) for i in range(len(words))]


_LINKS, _OPEN = "a long, b long", "a long, b long, open long, sketch long"


def _pairs(ids: list[int], links: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([ids[x[k]] for x in links], pa.int64()) for k in (0, 1)]


def _link_block(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """Of a bucket or a block of a hot one: links, and as open the texts not connected to a hot bucket's first, which is there as a guest."""
        group = group.sort_by([("guest", "descending")])
        ids = group.column("rep").to_pylist()
        links, component = link_bucket(group.column("words").to_pylist(), threshold)
        left = [i for i, c in zip(ids, component, strict=True) if c != component[0]] if group.column("guest")[0].as_py() else []
        none, empty = pa.nulls(len(left), pa.int64()), pa.nulls(len(links), pa.int64())
        a, b = _pairs(ids, links)
        sketch = pa.array([group.column("sketch")[0].as_py()] * (len(left) + len(links)), pa.int64())
        return pa.table([pa.concat_arrays([a, none]), pa.concat_arrays([b, none]), pa.concat_arrays([empty, pa.array(left, pa.int64())]), sketch], names=["a", "b", "open", "sketch"])

    return run


def _link_open(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """A block of open texts against a block of their bucket."""
        ids = group.column("rep").to_pylist()
        links, _ = link_bucket(group.column("words").to_pylist(), threshold, group.column("side").to_pylist())
        return pa.table(_pairs(ids, [(i, j) for i, j in links if ids[i] != ids[j]]), names=["a", "b"])

    return run


def near_links(texts: DataFrame, threshold: float = THRESHOLD, sketches: int = SKETCHES, picks: int = PICKS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between texts (rep long, words binary, as _normalised packs them), enough to connect all that are similar."""
    with small_batches(texts.sparkSession):
        members = written(texts.mapInArrow(_sketches(sketches, picks), "rep long, sketch long, size int"), "sketches")
    # a bucket's members are told by count and two sums of hashes; the same members are compared once
    told = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.sum("size").alias("sizes"), F.min("rep").alias("first")]
    buckets = members.groupBy("sketch").agg(*told).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("sketch").alias("sketch"), F.first("sizes").alias("sizes"), F.first("first").alias("first"))
    n_blocks = F.ceil(F.greatest(F.col("n") / bucket, F.col("sizes") / BUCKET_SHINGLES)).cast("int")
    buckets = written(buckets.select("sketch", "n", "first", n_blocks.alias("blocks")), "buckets")
    own = written(join_hot(members.select("rep", "sketch"), buckets, ["sketch"], "n").where("n is not null").select("rep", "sketch", "first", "blocks"), "members")
    hot = buckets.where("blocks > 1")
    block = F.pmod(F.xxhash64("rep", "sketch"), F.col("blocks")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    placed = own.where("blocks = 1 or rep != first").select("rep", "sketch", block, F.lit(False).alias("guest"))
    guests = hot.select(F.col("first").alias("rep"), "sketch", every, F.lit(True).alias("guest"))
    # texts move by rep at every size of data, not only where the other side is too large to send whole
    texts = texts.hint("merge")
    met = written(placed.union(guests).join(texts, "rep").groupBy("sketch", "block").applyInArrow(_link_block(threshold), _OPEN), "met")
    links, left = met.where("a is not null").select("a", "b"), met.where("open is not null").select(F.col("open").alias("rep"), "sketch")
    counted = written(left.groupBy("sketch").agg(F.count("*").alias("n_open")), "open")
    if counted.isEmpty():
        return links
    # blocks of open texts, as large as the bucket's blocks, against each block of the bucket
    rows = F.ceil(F.col("n_open") * F.col("blocks") / F.col("n")).cast("int").alias("rows")
    counted = hot.join(counted, "sketch").select("sketch", "blocks", rows)
    row = F.pmod(F.xxhash64("sketch", "rep"), F.col("rows")).cast("int").alias("row")
    asked = left.join(counted, "sketch").select("rep", "sketch", row, every, F.lit(0).alias("side"))
    among = own.select("rep", "sketch", block).join(counted.select("sketch", "rows"), "sketch")
    among = among.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "block", F.lit(1).alias("side"))
    return links.union(asked.union(among).join(texts, "rep").groupBy("sketch", "row", "block").applyInArrow(_link_open(threshold), _LINKS))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its near-duplicates) and kept."""
    own = only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sequences = own.where("doc_id is not null").mapInArrow(_normalised, "doc_id long, digest binary, words binary")
    # equal sequences are one text: a third of all rows may be copies
    with small_batches(docs.sparkSession):
        texts = written(sequences.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words")), "texts")
    # one doc_id may stand for several texts when rows repeat an id: each text keeps its own digest
    classes = written(connected_components(near_links(texts.select("rep", "words"), threshold)), "classes")
    named = texts.select("digest", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    named = written(named, "named")
    with small_batches(docs.sparkSession):  # the caller's run would have batches of its own size
        digests = written(sequences.select("doc_id", "digest"), "digests")
    out = digests.join(named, "digest").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.union(nameless)
