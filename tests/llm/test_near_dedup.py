import random

import pyarrow as pa
import pytest

from sparkrank.llm import near_dedup, shared
from sparkrank.llm.components import connected_components
from sparkrank.llm.near_dedup import aligned, near_classes


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def similarity(a, b):
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) if a or b else 1.0


def shingles(text):
    import re

    w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(docs):
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    s = {i: shingles(t) for i, t in docs}
    for i, _ in docs:
        for j, _ in docs:
            if j < i and similarity(s[i], s[j]) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, n = [], 0
    for _ in range(12):
        base = say(r.randint(60, 200))
        for _ in range(r.randint(1, 8)):
            words = base[:]
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append((n, " ".join(words)))
            n += 1
    docs += [(500, ""), (501, None), (502, "one two"), (503, "One, two!"), (504, "one two three"), (505, docs[0][1].upper()), (506, "\n".join(docs[1][1].split()))]
    return docs


def test_aligned_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(400):
        a = [r.randint(0, 30) for _ in range(r.randint(1, 30))]
        b = a[:]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randint(0, 30)) if r.random() < 0.5 else b and b.pop(r.randrange(len(b)))
        if b:
            assert aligned(a, b, 0.8) == (similarity(a, b) >= 0.8 - 1e-9)


@pytest.mark.parametrize("bucket", [512, 3])
def test_classes_match_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_dedup.near_links, "__defaults__", (*near_dedup.near_links.__defaults__[:3], bucket))
    docs = corpus(bucket)
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(docs)


def test_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b c"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_classes(frame).collect() if r.doc_id) == [(1, 1, True), (1, 1, True)]
    assert near_classes(frame).count() == 3
    assert near_classes(frame.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_long_texts(spark):
    r = random.Random(6)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(20_000)]
    close, far = words[:], words[:]
    for i in range(0, 20_000, 100):
        close[i] = "x"
    for i in range(0, 20_000, 20):
        far[i] = "y"
    docs = [(1, " ".join(words)), (2, " ".join(close)), (3, " ".join(far))]
    got = {x.doc_id: x.class_id for x in near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_words_that_break_polynomial_hashes(spark):
    """Unlike texts whose words have one polynomial hash modulo 2**64 stay apart; other columns' names do not matter."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = [(1, one, 0), (2, other, 0), (3, one, 1), (4, f"p q r s {one}", 1), (5, f"p q r s {other}", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, sketch int").selectExpr("*", "1 AS rep", "'x' AS words", "2 AS guest")
    assert {r.doc_id: r.class_id for r in near_classes(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_recall_of_pairs_by_length_and_similarity(spark):
    """Of pairs with a similarity of 0.8 to 0.95, short and long, at least 0.99 are found, and of unlike ones none."""
    r = random.Random(12)
    docs, similar, unlike = [], [], []
    for k in range(300):
        base = [f"w{r.randint(0, 10**6)}" for _ in range((9, 14, 30, 100, 400)[k % 5] + r.randint(0, 6))]
        words = base[:]
        target = r.uniform(0.7, 0.95)
        while True:
            new = words[:]
            # edits at the ends cost one shingle, others five
            if r.random() < 0.5 and len(new) > 12:
                new[r.randrange(len(new))] = "x%d" % r.randint(0, 10**6)
            else:
                new.append("y%d" % r.randint(0, 10**6)) if r.random() < 0.5 else new.pop()
            if similarity(shingles(" ".join(base)), shingles(" ".join(new))) < target:
                break
            words = new
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(words))]
        (similar if similarity(shingles(docs[-2][1]), shingles(docs[-1][1])) >= 0.8 else unlike).append(k)
    got = {x.doc_id: x.class_id for x in near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in similar) / len(similar)
    assert len(similar) > 150 and len(unlike) > 5 and found >= 0.99, found
    assert not any(got[2 * k + 1] == 2 * k for k in unlike)


def test_hot_bucket_with_open_texts(spark, monkeypatch):
    """A hot bucket's texts that are unlike its first one still meet all others, across blocks."""
    monkeypatch.setattr(near_dedup.near_links, "__defaults__", (*near_dedup.near_links.__defaults__[:3], 4))
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):  # a chain: each text is like its neighbours only
        base = base[4:] + [f"v{r.randint(0, 10**6)}" for _ in range(4)]
        docs.append((i, " ".join(base)))
    docs += [(100 + i, " ".join([*base[:-1], f"z{i}"])) for i in range(30)]
    r.shuffle(docs)
    got = {x.doc_id: x.class_id for x in near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(docs)


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Bounded by bytes, not 10,000 long texts at once; the session's setting stays."""
    setting, held, real = "spark.sql.execution.arrow.maxBytesPerBatch", {}, near_dedup.written

    def written(frame, name):
        held[name] = spark.conf.get(setting, None)
        return real(frame, name)

    monkeypatch.setattr(near_dedup, "written", written)
    before = spark.conf.get(setting, None)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 2000) AS text")
    out = near_classes(docs)
    assert {held[name] for name in ("texts", "sketches", "digests")} == {str(shared.BATCH_BYTES)} and spark.conf.get(setting, None) == before
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()  # no text goes to Python in the caller's run
    assert out.where("kept").count() == 3000

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with shared.small_batches(spark):
        assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 1.2 * shared.BATCH_BYTES
    assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] > 2 * shared.BATCH_BYTES
