"""Words and fingerprints of a batch of texts as NumPy arrays, without a Python loop per word.

Every task works on blocks of whole documents of a few MB, so memory is bounded by the block
size or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task handles at a time; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

#: Odd multipliers of the rolling hashes and of the finaliser.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Bytes that separate words where a contract says [\x20\x09-\x0D].
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, BLOCK_BYTES + (1 << 16)), base % (1 << 64), dtype=np.uint64)
        steps[0] = 1
        got = np.multiply.accumulate(steps)
        if len(got) <= 4 * BLOCK_BYTES:
            _powers[base] = got
    return got[:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j over j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Rolling hash of values[start:end], the same wherever the span stands."""
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    return (sums[end] - sums[start]) * inverse[start]


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


def byte_sums(buf: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return prefix_sums(_BYTE_VALUE[buf], base)


#: Places in a word whose values are looked up; those further on are computed.
TABLED = 64
_place_values: dict[int, np.ndarray] = {}


def _place_value(place_and_byte: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for a byte at a place of a word, as good as random: place * 256 + byte."""
    return mix(mix(place_and_byte.astype(np.uint64) * np.uint64(BASES[0]) + np.uint64(seed + 1)) ^ np.uint64(MIX[seed % 2]))


def _place_table(seed: int) -> np.ndarray:
    if seed not in _place_values:
        _place_values[seed] = _place_value(np.arange(TABLED * 256), seed)
    return _place_values[seed]


def _word_table(separators: bytes | None) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    if separators is not None:
        table[list(separators)] = False
        return table
    table[:128] = False
    for low, high in ((48, 58), (65, 91), (97, 123)):
        table[low:high] = True
    return table


class Block:
    """Some documents' texts, joined by a space, and where each begins.

    separators: the bytes between words; None takes everything in ASCII but letters and digits.
    """

    def __init__(self, texts: list[bytes], separators: bytes | None = WHITESPACE):
        self.texts = texts
        self.buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.begins = self.ends - lengths
        self._separators = separators

    def split(self) -> None:
        """Find the words: starts, ends, the document of each, and each document's first word."""
        self._in_word = is_word = _word_table(self._separators)[self.buf]
        edges = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.begins)
        self.n_words = np.searchsorted(self.start, self.ends) - self.first
        self.doc = np.repeat(np.arange(len(self.texts)), self.n_words)

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """Tabulation hash of each word: every place of a word has a value of its own for every byte.

        A polynomial modulo 2**64 would not do, for it is the same for a Thue-Morse string of
        1024 bytes and its complement, whatever its base. Seeds 0 and 1 are independent.
        """
        n = len(self.buf)
        place = np.arange(n, dtype=np.int32)
        gaps = np.full(n, -1, dtype=np.int32)
        outside = np.flatnonzero(~self._in_word)
        gaps[outside] = outside
        place -= np.maximum.accumulate(gaps) + np.int32(1)
        at = (place << np.int32(8)) | self.buf
        at[outside] = 0
        far = np.flatnonzero(place >= TABLED)
        at[far] = 0
        values = _place_table(seed)[at]
        values[far] = _place_value((place[far].astype(np.int64) << 8) | self.buf[far], seed)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        return mix(sums[self.end] - sums[self.start])

    def windows(self, width: int) -> np.ndarray:
        """Index of the first word of every window of so many words of one document."""
        n = len(self.start)
        if n < width:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, base: int = BASES[1]) -> np.ndarray:
    """Rabin-Karp hash of each window of word hashes that begins at one of `at`."""
    return mix(span_hash(prefix_sums(words, base), at, at + width, base))


def blocks(ids: list, texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cut a batch into runs of documents of about `limit` bytes together."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield ids[at:i], texts[at:i]
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield ids[at:], texts[at:]


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Smaller batches of the same rows, so that a task holds fewer of them as Python values."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def zipped(batches: Iterable) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as (doc_id, size, zipped), for texts that have to cross the network; a text that does not shrink stays as it is."""
    codec = pa.Codec("zstd", 1)
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        packed = [codec.compress(t, asbytes=True) for t in texts]
        kept = [p if len(p) < len(t) else t for p, t in zip(packed, texts, strict=True)]
        columns = [batch.column(0), pa.array(list(map(len, texts)), pa.int32()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "zipped"])


ZIPPED = "doc_id long, size int, zipped binary"


def unzipped(sizes: list[int], packed: list[bytes]) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [p if len(p) == n else codec.decompress(p, n, asbytes=True) for n, p in zip(sizes, packed, strict=True)]


def sorted_runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, .. start+count-1 of each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offsets = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + offsets


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions below `size` that lie in one of the half-open intervals."""
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:size]) > 0
