import hashlib
import random
import re

from sparkrank.llm import shared
from sparkrank.llm.exact_dedup import MOST_BYTES, cut_points, dedup_exact


def brute(docs):
    groups = {}
    for row in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append(row)
    out = []
    for text, rows in groups.items():
        rows.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for i, r in enumerate(rows):
            out.append((r[0], rows[0][0], len(rows), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup_exact(frame).collect()), key=repr)


def test_matches_brute_force(spark):
    r = random.Random(5)
    long = "".join(chr(r.randint(33, 900)) for _ in range(60_000))
    docs = [(1, "a b c"), (2, "abc"), (3, "a  b c"), (4, None), (5, " \n\t"), (6, ""), (7, long), (8, long[:30_000] + " " + long[30_000:]), (9, long[:-1]), (10, "z" * 50_000), (11, "z" * 50_001), (12, "z" * 50_000)]
    docs += [(20 + i, "one two") for i in range(30)] + [(50, "x y"), (51, "xy"), (52, "abc"), (52, "abc"), (None, "abc"), (None, "lonely")]
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_hot_chunks_and_lists_go_to_every_task(spark, monkeypatch):
    """The same rows come out when every repeated chunk and list counts as hot."""
    monkeypatch.setattr(shared, "HOT_PARTS", 10**9)
    monkeypatch.setattr(shared.join_hot, "__defaults__", (0, None))
    r = random.Random(6)
    long = "".join(chr(r.randint(33, 900)) for _ in range(9_000))
    docs = [(i, "one two") for i in range(30)] + [(40, None), (41, ""), (42, long), (43, long + " "), (44, long[1:]), (44, long[1:]), (None, "onetwo"), (45, "alone")]
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_empty_table_and_clashing_names(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    frame = spark.createDataFrame([(1, "x", "r", 3)], "doc_id long, text string, recipe string, size int")
    assert got(frame) == brute([(1, "x")])


def test_cut_points_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(200_000))
    cuts = cut_points(data)
    assert cuts[-1] == len(data) and max(b - a for a, b in zip([0, *cuts], cuts)) <= MOST_BYTES
    moved = {c - 77 for c in cut_points(b"\0" * 77 + data)}
    assert len(moved & set(cuts)) > 0.9 * len(cuts)
    assert cut_points(b"") == []
