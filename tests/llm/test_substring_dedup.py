import hashlib
import random
import re

import pytest

from sparkrank.llm import substring_dedup
from sparkrank.llm.substring_dedup import remove_repeated_windows


def brute(docs, width=13):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, t in docs:
        w = split(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        w = split(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out[i] = (len(w), len(gone), spans, hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def corpus():
    r = random.Random(4)
    say = lambda n: [r.choice(["the", "of", "é", "x y", "Word,", *[f"w{i}" for i in range(40)]]) for _ in range(n)]
    passages = [say(20), say(14), say(13), say(12)]
    docs = []
    for i in range(80):
        words = say(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            words += r.choice(passages) + say(r.randint(0, 5))
        docs.append((i, r.choice([" ", "\n", "\t \x0b"]).join(words)))
    return docs + [(200, docs[5][1]), (201, ""), (202, None), (203, "a " * 40), (204, "a " * 13), (205, " \n lead " + docs[7][1])]


@pytest.mark.parametrize("flush", [600_000, 50])
def test_matches_brute_force(spark, flush, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_WINDOWS", flush)
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in remove_repeated_windows(frame).collect()}
    assert got == brute(docs)


def test_repeated_null_ids_and_names(spark):
    text = " ".join(f"t{i}" for i in range(20))
    frame = spark.createDataFrame([(1, text, 0, "h"), (1, text, 0, "h"), (None, text, 1, "h"), (2, text, 1, None)], "doc_id long, text string, bucket int, hash string")
    got = sorted(((r.doc_id, r.n_removed) for r in remove_repeated_windows(frame).collect()), key=repr)
    assert got == [(1, 0), (1, 0), (2, 20), (None, 0)]
    assert remove_repeated_windows(frame.where("false")).count() == 0


def test_text_longer_than_a_block(spark):
    r = random.Random(8)
    text = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(180_000))
    assert len(text) > 1 << 20
    docs = [(1, text), (2, "lead " + text[len(text) // 2 :])]
    got = {x.doc_id: (x.n_words, x.n_removed, x.n_spans, x.kept_sha256, x.kept_text) for x in remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_break_polynomial_hashes(spark):
    """A Thue-Morse string of 1024 letters and its complement have one polynomial hash modulo 2**64, whatever its base."""
    one, other = thue_morse(1024)
    lead = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{lead} {one}"), (2, f"{lead} {other}"), (3, f"{lead} {one}")]
    got = {x.doc_id: (x.n_words, x.n_removed, x.n_spans, x.kept_sha256, x.kept_text) for x in remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert [got[i][1] for i in (1, 2, 3)] == [0, 0, 13]


def test_windows_that_differ_in_the_second_hash_alone(spark):
    """Windows equal in the first hash and unlike in the second are unlike, in a task and in a bucket."""
    import numpy as np

    h, docs = np.array([7, 7, 7, 9], dtype=np.uint64), np.array([4, 5, 6, 4])
    rows = list(substring_dedup._settle(h, np.array([1, 2, 1, 1], dtype=np.uint32), docs, 1))
    late = [(r[2], r[4]) for r in rows if r[1]]
    assert [np.frombuffer(x, dtype=np.uint64).tolist() for x, _ in late] == [[7]] and [np.frombuffer(d, dtype=np.int64).tolist() for _, d in late] == [[6]]
    order, starts = substring_dedup._ordered(h, np.array([1, 2, 1, 1]))
    assert [sorted(docs[order][i:j].tolist()) for i, j in zip(starts, [*starts[1:], 4])] == [[4, 6], [5], [4]]
