import random

import numpy as np

from sparkrank.llm import toxicity
from sparkrank.llm.tokens import Block
from sparkrank.llm.toxicity import TRAIN_DOCS, Model, _scan, features, fit, in_training_fold, lowered, score_documents, train, unlike


def brute_marginals(odds, first, chain, start):
    """Forward-backward, word by word."""
    out, n = np.zeros(len(odds)), len(odds)
    bounds = [i for i in range(n) if first[i]] + [n]
    for a, b in zip(bounds, bounds[1:]):
        left = [np.array([1.0, start * odds[a]])]
        for i in range(a + 1, b):
            v = left[-1] @ chain * np.array([1.0, odds[i]])
            left.append(v / v.sum())
        right = [np.ones(2)]
        for i in range(b - 1, a, -1):
            v = chain @ (np.array([1.0, odds[i]]) * right[-1])
            right.append(v / v.sum())
        for k, (x, y) in enumerate(zip(left, reversed(right))):
            out[a + k] = x[1] * y[1] / (x * y).sum()
    return out


def test_scan_against_word_by_word():
    r = np.random.default_rng(1)
    for n in (1, 5, 255, 256, 257, 3000):
        odds, first = np.exp(r.normal(0, 3, n)), r.random(n) < 0.02
        first[0] = True
        chain, start = np.exp(r.normal(0, 1, (2, 2))), 0.3
        both = _scan(odds, first, chain, start, False) * _scan(odds, first, chain, start, True)
        assert np.allclose(both / (1 + both), brute_marginals(odds, first, chain, start), atol=1e-9)


def corpus(n=600):
    r = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        own = [r.choice(words) for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(r.randint(2, 5)):
                own.insert(r.randrange(len(own)), r.choice(["idiot", "scum", "grobx" + r.choice("abcdefgh")]))
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_held_out_and_offsets(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(frame, known)
    rows = {r.doc_id: r for r in score_documents(frame, model).collect()}
    held = {r.doc_id for r in frame.where(~in_training_fold(frame.doc_id)).collect()}
    right = [(rows[i].score >= 0.5) == bool(t) for i, t in labels if i in held]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    texts = dict(docs)
    found = [texts[r.doc_id][s.start : s.end] for r in rows.values() for s in r.spans]
    assert found and sum(any(w in x for w in ("idiot", "scum", "grobx")) for x in found) / len(found) > 0.95


def test_edge_rows(spark):
    docs, labels = corpus(200)
    model = train([t for _, t in docs], [bool(y) for _, y in labels])
    frame = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "idiot " * 30_000, 0.5), (None, "idiot scum", 1.0), (4, "é ß İ idiot scum idiot", 0.0)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in score_documents(frame, model).collect()}
    assert rows[1].score == rows[2].score < 0.5 and rows[3].score > 0.5 and len(rows) == 5
    assert score_documents(frame.where("false"), model).count() == 0
    assert all(r.score == 0 and r.spans == [] for r in score_documents(frame, None).collect())


def test_offsets_after_letters_that_grow_and_score_by_hand(spark):
    """Spans are cut from the text itself; a score is the curve of word-by-word marginals, whatever stands beside it."""
    docs, labels = corpus(300)
    model = train([t for _, t in docs], [bool(y) for _, y in labels])
    text = "İİİ ẞ İ " + docs[1][1] + " İ IDIOT scum İdiot"
    frame = spark.createDataFrame([(1, text), *((10 + i, t) for i, (_, t) in enumerate(docs))], "doc_id long, text string")
    one = {r.doc_id: r for r in score_documents(frame.coalesce(1), model).collect()}
    many = {r.doc_id: r for r in score_documents(frame.repartition(50), model).collect()}
    assert {i: r.score for i, r in one.items()} == {i: r.score for i, r in many.items()}
    assert "IDIOT scum" in [text[s.start : s.end] for s in one[1].spans]
    block = Block([lowered(text).encode()], separators=None)
    block.split()
    odds = np.exp(np.clip(model.weights[features(block)].sum(axis=0, dtype=np.float64) + model.bias, -30, 30))
    p = brute_marginals(odds, np.arange(len(odds)) == 0, np.exp(model.chain), float(np.exp(model.start)))
    x = np.array([1, np.log(p.sum() + 1e-2), np.log((p.sum() + 1e-2) / (len(p) + 20)), p.max()])
    assert abs(one[1].score - 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))) < 1e-8


def test_sample_is_refilled_and_bounded(spark, monkeypatch):
    """Copies leave room for others; the sample ends at its bytes; long texts are not learned from."""
    seen = []
    monkeypatch.setattr(toxicity, "_train_chain", lambda texts, truth: seen.append((len(texts), int(truth.sum()))) or Model(np.zeros(toxicity.SLOTS, dtype=np.float32), 0.0, np.zeros((2, 2)), 0.0, np.zeros(4)))
    docs, labels = corpus(60)
    texts = [docs[0][1]] * 20 + [t for _, t in docs]
    train(texts, [False] * 20 + [bool(y) for _, y in labels], 10)
    assert seen[0][0] == 13  # ten of each kind, but for the third that the curve keeps
    rows = [(i, t) for i, t in docs] + [(1000 + i, "word " * 400_000) for i in range(5)]
    known = spark.createDataFrame([*labels, *((1000 + i, 1) for i in range(5))], "doc_id long, toxic int")
    monkeypatch.undo()
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4_000)
    assert isinstance(fit(spark.createDataFrame(rows, "doc_id long, text string"), known), Model)


def test_no_labels(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert fit(frame, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")) is None
    assert isinstance(train(["a b"] * 3, [True, False, False]), Model)


def test_sample_loses_near_copies_only():
    r = random.Random(3)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = say(200)
    texts = [" ".join(base), " ".join(base[:120] + say(80)), " ".join([*base, "more"]), " ".join(base[60:] + say(60)), "", "", " ".join(base)]
    assert unlike(texts) == [0, 1, 3, 4, 5]
    assert TRAIN_DOCS == 1500
