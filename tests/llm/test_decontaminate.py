import random
import re

from sparkrank.llm import decontaminate
from sparkrank.llm.decontaminate import drop_contaminated, find_contamination


def words(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def brute(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            own = words(item)
            k = min(5, len(own))
            if not k:
                continue
            s = {tuple(own[x : x + k]) for x in range(len(own) - k + 1)}
            c = len(s & {tuple(w[x : x + k]) for x in range(len(w) - k + 1)})
            if c >= threshold * len(s) - 1e-9:
                out.append((d, i, c, len(s)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(11)
    say = lambda n: " ".join(f"w{r.randint(0, 500)}" for _ in range(n))
    items = [(i, say(r.choice([1, 3, 5, 9, 15, 30, 59, 200]))) for i in range(40)] + [(100, None), (101, "  "), (7, say(20))]
    docs = []
    for i in range(50):
        parts = [say(r.randint(0, 2000))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items[:40])[1].split()
            if r.random() < 0.5 and len(w) > 40:
                w[r.randrange(len(w))] = "changed"
            parts += [" ".join(w).upper(), say(r.randint(0, 50))]
        docs.append((i, " -- ".join(parts)))
    return docs + [(90, None), (91, ""), (None, docs[0][1])], items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    pairs = lambda: sorted(((r.doc_id, r.item_id, r.n_common, r.n_shingles) for r in find_contamination(frame, bench).collect()), key=repr)
    assert len(want) > 30 and pairs() == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 20)  # items go in several blocks
    assert pairs() == want
    bad = {d for d, *_ in want}
    assert {r.doc_id for r in drop_contaminated(frame, bench).collect()} == {d for d, _ in docs if d is None or d not in bad}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, item_id int"), spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, items).count() == 0 and drop_contaminated(docs, items).count() == 1
    assert find_contamination(docs.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_degenerate_items_collisions_and_long_texts(spark):
    """Items of few different shingles need no more hash functions; unlike words of one polynomial hash stay apart."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    r = random.Random(4)
    long = [f"w{r.randint(0, 10**6)}" for _ in range(250_000)]
    turns = " ".join(["a b c"] * 200)
    items = [(1, "a " * 1000), (2, turns), (3, one), (4, f"p q r s {one}"), (5, " ".join(long[200_000:200_030])), (6, " ".join(["x"] * 40 + long[:10]))]
    docs = [(1, "b " + "a " * 5 + "b"), (2, "a " * 4), (3, "c a b c a b c a"), (4, other + f" p q r s {other}"), (5, f"z {one} z"), (6, " ".join(long)), (7, items[5][1]), (8, "a " * 3000)]
    assert max(len(seeds) for *_, seeds, _ in decontaminate.Items([i for i, _ in items], [t for _, t in items], 0.8).classes) < 200
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(((x.doc_id, x.item_id, x.n_common, x.n_shingles) for x in find_contamination(frame, bench).collect()), key=repr) == brute(docs, items)
