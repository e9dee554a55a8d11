"""Each stage against what its operator's brute force would keep, on a small corpus written as tables."""

import random
import re

import pytest

import corpus_pipeline
from sparkrank.llm.toxicity import fit, score_documents
from tests.llm.test_mixing import brute as mixing_brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        own, toxic = say(r.randint(60, 200)), i % 4 == 0
        if toxic:
            for _ in range(4):
                own.insert(r.randrange(len(own)), r.choice(["idiot", "scum"]))
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    docs.append((1000, docs[1][1].replace(" ", "\n")))
    docs.append((1001, docs[2][1] + " one more"))
    docs.append((1002, " ".join(say(50)) + " " + items[3][1] + " " + " ".join(say(50))))
    docs += [(1003, ""), (1004, None), (1005, "  ")]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src1", "src12"]), len(t or "")) for i, t in docs]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), {i: t for i, _, t in labels}, dict(items)


def test_stages(spark, corpus):
    d, docs, toxic, items = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    frame = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept, ids = frame.columns, {}, set(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, d)
        rows = out.collect()
        if name != "mixing":
            assert out.columns == columns
        kept[name] = {r.doc_id for r in rows}
        assert kept[name] <= ids and all(r.text == docs[r.doc_id] for r in rows)
        ids = kept[name]
        frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], frame.schema) if name != "mixing" else out
    dropped = set(docs) - kept["toxicity"]
    scores = {r.doc_id: r.score for r in score_documents(spark.read.parquet(f"{d}/documents.parquet"), fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    assert dropped == {i for i, s in scores.items() if s >= 0.5}
    assert len(dropped ^ {i for i, t in toxic.items() if t}) < 12
    flat = lambda i: re.sub(r"\s", "", docs[i] or "")
    assert kept["toxicity"] - kept["exact dedup"] == {i for i in kept["toxicity"] if any(flat(j) == flat(i) and (-len(docs[j] or ""), j) < (-len(docs[i] or ""), i) for j in kept["toxicity"])}
    assert 1 not in kept["exact dedup"] or 1000 not in kept["exact dedup"]
    assert kept["exact dedup"] - kept["near dedup"] == {1001}
    assert kept["near dedup"] - kept["decontamination"] == {1002}
    assert kept["mixing"]


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert set(corpus_pipeline.COLUMNS) < set(out.columns) and out.count() > 0
    assert {r.doc_id for r in out.collect()} <= set(corpus[1])


def test_repeated_clashing_and_null_ids(spark, tmp_path):
    """Verdicts hit rows, not doc_ids."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, near, rude = say(20), say(150), lambda: say(40) + " " + " ".join(f"idiot {say(8)} scum" for _ in range(6))
    docs, labels = [], []
    for i in range(300):
        docs.append((i, rude() if i % 4 == 0 else say(120)))
        labels.append((i, int(i % 4 == 0)))
    repeated, clean = say(100), [say(100) for _ in range(4)]
    docs += [(2000, repeated)] * 4 + [(2001, near), (2002, near + " one more"), (2002, clean[0])]
    docs += [(2003, rude()), (2003, clean[1]), (2004, say(30) + " " + item + " " + say(30)), (2004, clean[2])]
    docs += [(None, rude()), (None, repeated), (None, near + " two more"), (None, say(30) + " " + item + " " + say(30)), (None, clean[3])]
    bad = {t for i, t in docs if i is None or i >= 2000} - {repeated, near, *clean}
    rows = [(i, t, "en", "src0", len(t)) for i, t in docs]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, d)
        kept = [(x.doc_id, x.text) for x in out.collect()]
        frame = spark.createDataFrame(out.collect(), frame.schema)
    assert not bad & {t for _, t in kept}
    assert [k for k in kept if k[1] == repeated] == [(2000, repeated)] and (2001, near) in kept
    assert {(2002, clean[0]), (2003, clean[1]), (2004, clean[2]), (None, clean[3])} <= set(kept)
    final = [(x.doc_id, x.text, x.epoch) for x in corpus_pipeline.run(spark, d).collect()]
    assert len(final) == len(set(final)) and {x[:2] for x in final} <= set(kept)
    # the last stage by itself: equal rows come out as often as they are chosen
    frame = spark.createDataFrame([x for x in rows if x[0] is None or x[0] >= 2000] * 2, frame.schema)
    mixed = corpus_pipeline.mix(spark, frame, d).collect()
    assert sum(x.n_tokens for x in mixed) <= 0.75 * sum(len(x.text.split()) for x in frame.collect())
    assert mixed and max(sum(y.text == x.text and y.epoch == x.epoch for y in mixed) for x in mixed) <= 10


def test_mixing_stage_against_brute_force(spark, tmp_path):
    """What the last stage draws is what the operator's brute force draws, by row."""
    from sparkrank.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS

    r = random.Random(3)
    docs = [(i, " ".join("x" * r.randint(1, 4) for _ in range(r.choice([0, 2, 30, 150]))), r.choice(["en", "de", "es", None]), r.choice(["src0", "src1", "src7", "src12", "src19"])) for i in range(300)]
    domain = lambda source: "crawl" if source == "src0" else "web" if len(source) == 4 else "curated"

    def weight(path):
        fits = [p for p in MIX_WEIGHTS if len(p) == len(path) and all(x in ("*", y) for x, y in zip(p, path))]
        return MIX_WEIGHTS[max(fits, key=lambda p: (sum(x != "*" for x in p), p))] if fits else 1

    # the brute force names a domain by its source's first letter
    renamed = [(i, t, lang, domain(source)[0] + source) for i, t, lang, source in docs]
    names = {"c": "crawl", "w": "web", "k": "curated"}
    renamed = [(i, t, lang, ("k" + s[1:]) if domain(s[1:]) == "curated" else s) for i, t, lang, s in renamed]
    budget = int(MIX_SHARE * sum(len(t.split()) for _, t, *_ in docs))
    want = mixing_brute(renamed, lambda path: weight(tuple(names.get(x, x) if k == 0 else x[1:] if k == 2 else x for k, x in enumerate(path))), budget, MIX_EPOCHS, MIX_SEED)
    frame = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix(spark, frame, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.epoch) for x in got) == want and len(want) > 50
    assert all(x.text == docs[x.doc_id][1] and x.domain == domain(x.source) for x in got)


def test_empty_tables(spark, tmp_path):
    """Stages over tables without rows give tables without rows."""
    d = str(tmp_path)
    documents, labels, benchmark = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, kind in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        spark.createDataFrame([], kind).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
