"""Benchmark decontamination: MinHash containment search for short items inside long documents.

Containment in a long document is hopeless to estimate from one signature of all of it, so
items are partitioned by size, and for each size class a document is taken as overlapping
windows of about twice the class's size. An item that a document holds then fills a good part
of some window, and the number of hash functions of each class is tuned so that such a window
shares a minimum with the item but for MISS of the cases.

A window's minimum can only equal an item's if the window holds a shingle of some item, so
signatures are computed for those windows alone; a bitmap over the items' shingles tells. All
candidates are verified by exact containment: the share of the item's distinct shingles, as
words, that the whole document holds.

An item of few different shingles for its length, at most an eighth of its class's size (a word
repeated a thousand times, a single shingle), would need very many hash functions. Such items are
searched by the least hashes of their shingles, so many that a document that holds the item
enough has one of them: no miss.

One pass over the documents, no shuffle. The items travel to the tasks in blocks of at most
BLOCK_ITEMS items and BLOCK_CHARS characters, and tasks prepare them for the search; a benchmark
of several blocks is a pass for each, whose result is written down before the next block is read.
So the driver and what is broadcast have a bound whatever the benchmark's size.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. An item of one
to four words is a single shingle and is searched as such; items without words (null, empty)
match nothing, and neither do documents without words. Repeated items or documents each give
their own rows; a null id is reported as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import only, written
from sparkrank.llm.tokens import Block, blocks, mix, spread, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Chance that a window that holds THRESHOLD of an item shares no minimum with it.
MISS = 1e-4
#: What goes to the tasks at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: An item with at most 1/SPARSE of its class's size in different shingles is searched by listed shingles.
SPARSE = 8
#: Slots of the bitmap over the items' shingles: 2 MB packed in bytes.
BITMAP = 1 << 21


def _words(block: Block, i: int) -> list[bytes]:
    text = bytes(block.buf)
    first, n = int(block.first[i]), int(block.n_words[i])
    return [text[a:b] for a, b in zip(block.start[first : first + n].tolist(), block.end[first : first + n].tolist(), strict=True)]


def _shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class Items:
    """One block of items, ready to be searched for: everything the tasks need."""

    def __init__(self, ids: list, texts: list[str], threshold: float):
        self.threshold = threshold
        block = Block([(t or "").lower().encode() for t in texts], separators=None)
        block.split()
        hashes = block.word_hashes()
        self.ids, self.sets, self.widths = [], [], []
        by_class: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for i, item in enumerate(ids):
            n = int(block.n_words[i])
            if not n:
                continue
            width = min(SHINGLE, n)
            own = np.unique(window_hashes(hashes, np.arange(block.first[i], block.first[i] + n - width + 1), width))
            size = 8
            while n > 0.75 * size:
                size *= 2
            by_class.setdefault((width, size), []).append((len(self.ids), own))
            self.ids.append(item)
            self.widths.append(width)
            self.sets.append(_shingle_set(_words(block, i), width))
        self.bitmaps: dict[int, np.ndarray] = {}
        self.classes, self.listed = [], {}
        for (width, size), members in sorted(by_class.items()):
            bitmap = self.bitmaps.setdefault(width, np.zeros(BITMAP, dtype=bool))
            for _, own in members:
                bitmap[own % np.uint64(BITMAP)] = True
            for i, own in members:
                if SPARSE * len(own) <= size:
                    enough = math.ceil(threshold * len(own) - 1e-9)
                    keys = self.listed.setdefault(width, [])
                    keys += [(h, i) for h in own[: len(own) - enough + 1].tolist()]
            members = [(i, own) for i, own in members if SPARSE * len(own) > size]
            if not members:
                continue
            least = min(len(own) for _, own in members)
            # at least so similar are an item's shingles and those of a window that holds enough of them
            similarity = threshold * least / (2 * size + (1 - threshold) * least)
            n_hashes = math.ceil(math.log(MISS) / math.log(1 - similarity))
            seeds = mix(np.arange(1, n_hashes + 1, dtype=np.uint64) + np.uint64(size << 20))
            all_own, counts = np.concatenate([own for _, own in members]), np.array([len(own) for _, own in members])
            places, tables = np.array([i for i, _ in members], dtype=np.int64), []
            for seed in seeds:
                mins = np.minimum.reduceat(mix(all_own ^ seed), np.cumsum(counts) - counts)
                order = np.argsort(mins, kind="stable")
                tables.append((mins[order], places[order]))
            self.classes.append((width, size, seeds, tables))
        for width, keys in self.listed.items():
            keys.sort()
            self.listed[width] = np.array([h for h, _ in keys], dtype=np.uint64), np.array([i for _, i in keys], dtype=np.int64)

    def candidates(self, block: Block) -> set[tuple[int, int]]:
        """(document of the block, item) of each window and item with a minimum in common."""
        found: set[tuple[int, int]] = set()
        words = block.word_hashes()
        for width, bitmap in self.bitmaps.items():
            at = block.windows(width)
            hashes = window_hashes(words, at, width)
            doc = block.doc[at]
            hit = np.flatnonzero(bitmap[hashes % np.uint64(BITMAP)])
            if not len(hit):
                continue
            if width in self.listed:
                self._listed(doc[hit], hashes[hit], *self.listed[width], found)
            place = at - block.first[doc]
            first = np.searchsorted(doc, np.arange(len(block.texts)))
            last = np.append(first[1:], len(doc))
            for own_width, size, seeds, tables in self.classes:
                if own_width != width:
                    continue
                # windows of 2*size shingles at every multiple of size; each shingle is in two of them
                window = place[hit] // size
                pairs = np.unique(np.concatenate((doc[hit] << 32 | window, doc[hit] << 32 | np.maximum(window - 1, 0))))
                owner = pairs >> 32
                begin = first[owner] + (pairs & 0xFFFFFFFF) * size
                count = np.minimum(begin + 2 * size, last[owner]) - begin
                for k in range(0, len(pairs), 4096):
                    self._match(hashes, owner[k : k + 4096], begin[k : k + 4096], count[k : k + 4096], seeds, tables, found)
        return found

    @staticmethod
    def _listed(doc, hashes, values, items, found) -> None:
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
        doc, hashes = doc[fresh], hashes[fresh]
        low, high = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        which = spread(low, high - low)
        found.update(zip(np.repeat(doc, high - low).tolist(), items[which].tolist(), strict=True))

    @staticmethod
    def _match(hashes, owner, begin, count, seeds, tables, found) -> None:
        own = hashes[spread(begin, count)]
        starts = np.cumsum(count) - count
        for seed, (values, items) in zip(seeds, tables, strict=True):
            least = np.minimum.reduceat(mix(own ^ seed), starts)
            low, high = np.searchsorted(values, least, "left"), np.searchsorted(values, least, "right")
            some = np.flatnonzero(high > low)
            if len(some):
                which = spread(low[some], high[some] - low[some])
                docs = np.repeat(owner[some], high[some] - low[some])
                found.update(zip(docs.tolist(), items[which].tolist(), strict=True))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(document, item, shingles in common) of the verified pairs."""
        block = Block([t.lower().encode() for t in texts], separators=None)
        block.split()
        cached: dict[tuple[int, int], set] = {}
        for doc, item in sorted(self.candidates(block)):
            key = doc, self.widths[item]
            if key not in cached:
                cached.clear()
                cached[key] = _shingle_set(_words(block, doc), key[1])
            common = len(self.sets[item] & cached[key])
            if common >= self.threshold * len(self.sets[item]) - 1e-9:
                yield doc, item, common


def _search(item_ids: list, item_texts: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(item_ids, item_texts, threshold)
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(ids[d], items.ids[i], c, len(items.sets[i])) for d, i, c in items.search(texts)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "n_common", "n_shingles"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_common, n_shingles (of the item), containment."""
    own = only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = only(benchmark, item_id=item_id, text=item_text).where("text is not null")
    out = None
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("most")).first()
    n_blocks = max(1, math.ceil(2 * size["n"] / BLOCK_ITEMS), math.ceil(2 * size["chars"] / BLOCK_CHARS))
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        found = own.mapInArrow(_search([r["item_id"] for r in part], [r["text"] for r in part], threshold), "doc_id long, item_id long, n_common long, n_shingles long")
        if n_blocks > 1:
            found = written(found, "contamination")
        out = found if out is None else out.union(found)
    return out.select("*", (F.col("n_common") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item; rows without a doc_id stay."""
    found = find_contamination(docs, benchmark, threshold, doc_id, text).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, doc_id, "left_anti")
