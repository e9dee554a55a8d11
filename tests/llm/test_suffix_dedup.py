import hashlib
import random
import sys

import numpy as np
import pytest

from sparkrank.llm import suffix_array, suffix_dedup
from sparkrank.llm.suffix_array import permuted_common_prefixes, sort_suffixes
from sparkrank.llm.suffix_dedup import remove_repeated_bytes


def brute(docs, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "zeta", "of", "the", "and", "ing"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "s", str(r.randint(0, 99))]) for _ in range(n))
    passages = [say(30) for _ in range(4)]
    line = say(12)[:80]
    docs = []
    for i in range(60):
        parts = [say(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts.append(r.choice([*passages, line, say(20)]))
        docs.append((i, "\n".join(parts)))
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, "a" * 450), (104, "ab" * 300), (105, "x" * 99), (106, "a" * 120), (107, docs[5][1] + "!" + docs[5][1])]
    return docs


def rows(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


@pytest.mark.parametrize(("most", "flush", "held"), [(2_000, 400_000, 4_000_000), (3, 40, 50), (1, 400_000, 100), (2_000, 10, 10)])
def test_matches_brute_force(spark, monkeypatch, most, flush, held):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ANCHORS", flush)
    monkeypatch.setattr(suffix_dedup, "HELD_ANCHORS", held)
    docs = corpus(most)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(remove_repeated_bytes(frame)) == brute(docs)


def test_empty_and_extra_columns(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    frame = spark.createDataFrame([(1, "z" * 150, "x", 7)], "doc_id long, text string, hash string, place int")
    assert rows(remove_repeated_bytes(frame)) == brute([(1, "z" * 150)])


def test_kept_bytes(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    got = {r.doc_id: bytes(r.kept) for r in remove_repeated_bytes(spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")).collect()}
    assert got == {1: text.encode(), 2: b"head  tail"}


def test_suffix_array_against_sorting():
    r = random.Random(1)
    for _ in range(200):
        k = r.randint(1, 4)
        s = np.array([r.randint(1, k) for _ in range(r.randint(0, 50))] + [0], dtype=np.int16)
        listed = s.tolist()
        want = sorted(range(len(listed)), key=lambda i: listed[i:])
        got = sort_suffixes(s, k + 1)
        assert got.tolist() == want
        shared = permuted_common_prefixes(s, got)
        for a, b in zip(want, want[1:]):
            n = 0
            while listed[a + n] == listed[b + n]:
                n += 1
            assert shared[b] == n


def test_text_longer_than_a_block(spark):
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(1_200_000))
    docs = [(1, text), (2, "lead " + text[900_000:])]
    assert rows(remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_suffixes_of_separated_strings():
    """With a symbol apart, equal strings are ordered by where they end, and no comparison runs on."""
    r = random.Random(1)
    for _ in range(150):
        parts = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8))]
        parts += [r.choice(parts) for _ in range(r.randint(0, 6))]
        s, ends = [], []
        for part in parts:
            s += [ord(x) + 2 for x in part] + [1]
            ends.append(len(s) - 1)
        s.append(0)
        place = {p: i for i, p in enumerate(ends)} | {ends[-1]: -1}
        symbols = [(x, place.get(i, 0)) for i, x in enumerate(s)]
        assert sort_suffixes(np.array(s, dtype=np.int16), 258, apart=1).tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])


def test_sorting_a_shard_runs_no_python_line_per_byte():
    """A shard is sorted by whole arrays: the lines of Python that run do not grow with its bytes."""
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        if frame.f_code.co_filename != suffix_array.__file__:
            return None
        lines += event == "line"
        return count

    def sorting(n):
        nonlocal lines
        r = random.Random(4)
        words = ["".join(r.choice("abcdefghij ") for _ in range(r.randint(20, 60))) for _ in range(60)]
        contexts = ["".join(r.choice(words) for _ in range(5))[:160].encode() for _ in range(n)]
        s = np.frombuffer(b"\0".join([*contexts, b""]), dtype=np.uint8).astype(np.int16) + 2
        s[s == 2] = 1
        s = np.append(s, np.int16(0))
        lines, before = 0, sys.gettrace()
        sys.settrace(count)
        try:
            sort_suffixes(s, 258, apart=1)
        finally:
            sys.settrace(before)
        return lines, len(s)

    (few, _), (many, n) = sorting(500), sorting(2000)
    assert many < n / 10
    assert many < 2 * few


def test_rows_that_share_a_doc_id_and_differ(spark, monkeypatch):
    """Their removal list is the same whether an anchor's windows are compared by suffix array or dealt one by one."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 99)) for _ in range(n))
    passages = [say(40) for _ in range(6)]
    docs = [(i % 20, " ".join(r.choice([*passages, say(r.randint(1, 20))]) for _ in range(r.randint(1, 5)))[: r.randint(50, 1200)]) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = []
    for most in (10_000, 1):
        monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
        got.append(sorted(map(tuple, remove_repeated_bytes(frame, with_text=False).collect())))
    assert got[0] == got[1]


def test_windows_of_crowded_anchors_that_are_equal_in_a_batch_leave_as_intervals():
    """Texts with one long line in common: one interval each, not a row a window; and a clash of hashes takes nothing for equal."""
    line = b"".join(bytes([97 + i % 26, 48 + i % 10]) for i in range(80))
    docs = np.repeat(np.arange(50), 2)
    late, early, windows = suffix_dedup._crowded_windows(docs, np.tile([7, 9], 50), [line, line[2:]] * 50, 100)
    assert [c.tolist() for c in late] == [list(range(1, 50)), [7] * 49, [167] * 49]
    assert (early[0].tolist(), sorted(early[1].tolist())) == ([0] * 61, list(range(7, 68)))
    assert sorted(windows) == sorted(line[i : i + 100] for i in range(61))


def test_clashing_window_hashes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_window_hashes", lambda buf, at, length: np.zeros(len(at), dtype=np.uint64))
    late, early, windows = suffix_dedup._crowded_windows(np.arange(3), np.zeros(3, dtype=np.int64), [b"abcd", b"abcx", b"bcd"], 3)
    assert [c.tolist() for c in late] == [[1], [0], [3]]
    assert sorted(zip(*(c.tolist() for c in early), windows)) == [(0, 0, b"abc"), (0, 1, b"bcd"), (1, 1, b"bcx"), (2, 0, b"bcd")]
