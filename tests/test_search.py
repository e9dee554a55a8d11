"""Lexical, dense and hybrid search on tables small enough to work out by hand, whatever the partitioning."""

import math
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkrank.errors import Refused
from sparkrank.functions import analysis
from sparkrank.functions.analysis import Analysis, normalise, porter, sentences, terms, unicode_words
from sparkrank.operators import dense, fusion, lexical, selection
from sparkrank.operators.highlight import sentence_snippets, window_snippets
from sparkrank.plans import queries
from sparkrank.sources import tables

DOCS = [(1, "the red fox"), (2, "The fox and the red red hen"), (3, "a hen"), (4, None), (5, ""), (6, "red hen red fox fox red")]


@pytest.fixture(params=[1, 3, 7])
def docs(spark, request):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(request.param)


def brute_bm25(query, k1=1.2, b=0.75):
    own = {i: (t or "").lower().split() for i, t in DOCS}
    n, avgdl = len(own), sum(map(len, own.values())) / len(own)
    out = {}
    for t in query:
        df = sum(t in w for w in own.values())
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for i, w in own.items():
            if tf := w.count(t):
                out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / avgdl))
    return out


def scores(df, key="doc_id"):
    return {r[key]: pytest.approx(r["score"]) for r in df.collect()}


def test_bm25_whatever_the_partitions(docs):
    want = brute_bm25(["red", "hen"])
    assert scores(lexical.bm25(docs, ["red", "hen"])) == want
    assert scores(lexical.bm25_indexed(lexical.postings(docs), lexical.field_stats(docs), ["red", "hen"])) == want
    top = [(r.rank, r.doc_id) for r in lexical.top_k(lexical.bm25(docs, ["red", "hen"]), 2).orderBy("rank").collect()]
    assert top == [(i + 1, d) for i, d in enumerate(sorted(want, key=lambda d: (-want[d], d))[:2])]
    with pytest.raises(Refused):
        lexical.top_k(docs, 0)


def test_postings_and_statistics(docs):
    rows = {(r.term, r.doc_id): (r.tf, list(r.positions), r.dl) for r in lexical.postings(docs, only=["red"]).collect()}
    assert rows == {("red", 1): (1, [1], 3), ("red", 2): (2, [4, 5], 7), ("red", 6): (3, [0, 2, 5], 6)}
    stats = lexical.field_stats(docs).first()
    assert (stats.n, stats.total) == (6, 18) and stats.avgdl == 3
    assert lexical.field_stats(docs.where("false")).first().avgdl == 1.0
    assert {r.term: r.df for r in lexical.vocabulary(docs).collect()}["fox"] == 3


def test_phrases(docs):
    found = lambda phrase, slop=0: {r.doc_id: r.n for r in lexical.phrase_matches(docs, phrase, slop).collect()}
    assert found(["red", "hen"]) == {2: 1, 6: 1} and found(["red", "fox"]) == {1: 1, 6: 1}
    assert found(["red", "fox"], 1) == {1: 1, 6: 1} and found(["fox", "red"], 1) == {6: 2} and found(["fox", "red"], 2) == {2: 1, 6: 2}
    assert {r.bigram for r in lexical.bigrams(docs.where("doc_id = 1")).collect()} == {"the red", "red fox"}
    assert lexical.phrase_route(2, 0, True, False) == "bigrams" and lexical.phrase_route(3, 0, True, True) == "positions"
    with pytest.raises(Refused):
        lexical.phrase_route(3, 0, True, False)


ODD = [(1, "a b a b"), (1, "a b c"), (2, "A b"), (None, "b c"), (None, "c b c"), (3, ""), (4, None), (5, "solo"), (6, "runs running run"), (2, "runs"), (None, "lone")]


def test_bigram_stats(spark, tmp_path):
    """Rows of one doc_id, or without any, are one document; a pair crosses the network once per task."""
    spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    held, tf = {}, {}
    for i, t in ODD:
        w = (t or "").lower().split()
        for b in map(" ".join, zip(w, w[1:], strict=False)):
            held.setdefault(b, set()).add(i)
            tf[b] = tf.get(b, 0) + 1
    got = {r.bigram: (r.docs, r.tf) for r in queries.QUERIES["bigrams"](spark, str(tmp_path)).collect()}
    assert got == {b: (len(held[b]), tf[b]) for b in tf}
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "alone" / "documents.parquet"))
    plan = queries.QUERIES["bigrams"](spark, str(tmp_path / "alone"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.bigram: (r.docs, r.tf) for r in plan.collect()}["red fox"] == (2, 2)


def test_stem_stats(spark, tmp_path):
    """Rows of one doc_id are one document, rows without any count for none; a stem crosses the network once per task."""
    spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    held = {}
    for i, t in ODD:
        for w in (t or "").lower().split():
            held.setdefault(porter(w), set()).update({i} - {None})
    got = {r.term: r.df for r in queries.QUERIES["stemmed_terms"](spark, str(tmp_path)).collect()}
    assert got == {w: len(ids) for w, ids in held.items()} and got["run"] == 2 and got["lone"] == 0
    spark.createDataFrame([*DOCS, (7, "foxes fox")], "doc_id long, text string").write.parquet(str(tmp_path / "alone" / "documents.parquet"))
    plan = queries.QUERIES["stemmed_terms"](spark, str(tmp_path / "alone"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.term: r.df for r in plan.collect()} == {"the": 2, "red": 3, "fox": 4, "and": 1, "hen": 3, "a": 1}


def test_postings_in_parts(spark, monkeypatch):
    """Parts of a few terms, odd rows and other normalisers give the rows that one text by itself gives; nothing is sorted by expressions."""
    monkeypatch.setattr(lexical, "POSTED_TERMS", 5)
    frame = spark.createDataFrame([*ODD, (9, "\u200b a \u200b b a")], "doc_id long, text string").repartition(1)
    for how in (analysis.INGEST, Analysis(strip_invisible=True)):
        want = []
        for i, t in frame.collect():
            words = [normalise(w, how.strip_invisible, False, True) for w in (t or "").split()]
            places = {w: [k for k, x in enumerate(words) if x == w] for w in words if w}
            want += [("body", w, i, len(at), at, sum(map(len, places.values()))) for w, at in places.items()]
        posted = lexical.postings(frame, analysis=how)
        assert sorted(map(tuple, posted.collect()), key=str) == sorted(want, key=str)
        assert "array_sort" not in posted._jdf.queryExecution().optimizedPlan().toString()


def test_index_reads_texts_once(spark, tmp_path):
    """The field's statistics come from the terms': no second job cuts the texts."""
    cut = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        cut.add(1)
        return t

    frame = spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", seen.asNondeterministic()("text").alias("text"))
    tables.write_index(frame, str(tmp_path / "index"), buckets=4)
    assert cut.value == len(DOCS)
    got, want = spark.read.parquet(f"{tmp_path}/index/field_stats"), lexical.field_stats(spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert got.collect() == want.collect() and got.dtypes == want.dtypes
    empty = str(tmp_path / "empty")
    tables.write_index(spark.createDataFrame([(1, None)], "doc_id long, text string"), empty, buckets=4)
    assert tuple(spark.read.parquet(f"{empty}/field_stats").first()) == (1, 0, 1.0)


def test_expansion(docs):
    vocab = lexical.vocabulary(docs)
    assert lexical.expand_prefix(vocab, "h") == ["hen"]
    with pytest.raises(Refused):
        lexical.expand_prefix(vocab, "", 5)
    with pytest.raises(Refused):
        lexical.expand_prefix(vocab.union(vocab.selectExpr("concat('h', term)", "df")), "h", 2)
    assert [r.term for r in lexical.suggest(vocab, "r", 1).collect()] == ["red"]
    assert [(r.term, r.distance) for r in lexical.did_you_mean(vocab, "hne").collect()] == [("hen", 1)]
    assert lexical.osa_distance("ab", "ba", 2) == 1 and lexical.osa_distance("abc", "xyz", 2) == 3 and lexical.osa_distance("a", "abcd", 2) == 3
    table = lexical.parse_synonyms(["car, motor car", "tv => television # x", ""])
    assert lexical.expand_synonyms(["motor", "car", "tv"], table) == ["motor", "car", "tv", "television"]
    assert lexical.expand_synonyms(["television"], table) == ["television"]
    got = {r.doc_id: (r.concept_id, r.score) for r in lexical.glossary_scores(docs, {"x": "red fox", "y": "hen", "z": "the red fox"}).collect()}
    assert got == {1: ("z", 3.0), 2: ("y", 1.0), 3: ("y", 1.0), 6: ("x", 2.0)}


def test_a_prefix_of_many_terms(spark, tmp_path):
    """The list for a query has a cap, the table of terms has none."""
    words = [f"from{i}" for i in range(lexical.PREFIX_MOST + 76)]
    spark.createDataFrame([(1, " ".join(words)), (2, "from7 other FROM7 far"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term: r.df for r in queries.QUERIES["prefix_expand"](spark, str(tmp_path)).collect()}
    assert got == {w: 1 + (w == "from7") for w in words}


def test_explain_sums_to_score(docs, spark):
    parts = lexical.explain_bm25(docs, ["red", "hen"], spark.createDataFrame([(2,), (6,)], "doc_id long"))
    sums = {r.doc_id: pytest.approx(r.s) for r in parts.groupBy("doc_id").agg(F.sum("contribution").alias("s")).collect()}
    assert sums == {i: s for i, s in brute_bm25(["red", "hen"]).items() if i in (2, 6)}


def test_analysis(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: porter(w) for w in pairs} == pairs
    assert normalise("Éa­ß", True, True, True) == "eass"
    assert unicode_words("Can't stop, 3.14 x_y!") == ["Can't", "stop", "3.14", "x_y"]
    assert [len(w) for w in unicode_words("a" * 600)] == [255, 255, 90]
    row = spark.createDataFrame([("A b　 C\r\n\r\n d ",)], "t string").select(terms(F.col("t")).alias("w"), terms(F.col("t"), Analysis(fold_case=False)).alias("c"), sentences(F.col("t")).alias("s")).first()
    assert row.w == ["a", "b", "c", "d"] and row.c == ["A", "b", "C", "d"] and row.s == ["A b　 C", "d"]
    own = spark.createDataFrame([(1, "caresses"), (2, "caress")], "doc_id long, term string")
    assert [r.term for r in analysis.stemmed(own).collect()] == ["caress", "caress"]


def test_highlights():
    text = "nothing here\nred fox runs\nred red hen and fox\nthe end"
    assert sentence_snippets(text, {"red", "fox"}, 1, 300) == ["red red hen and fox"]
    assert sentence_snippets(text, {"red", "fox"}, 2, 7) == ["red fox", "red red"]
    (window,) = window_snippets("x " * 100 + "red fox" + " y" * 100, {"red", "fox"}, 3, 30)
    assert "red fox" in window and len(window) <= 30 and window_snippets("none", {"red"}) == []


VECTORS = [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.0, 1.0], 1), (4, [0.6, 0.8], 1), (5, None, 1)]


def test_dense(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").repartition(3)
    top = lambda df: [r.vec_id for r in df.collect()]
    assert top(dense.dense_top_k(v, [0.0, 1.0], 3)) == [3, 2, 4]
    assert top(dense.dense_top_k(v.where("label = 0"), [0.0, 1.0], 3)) == [2, 1] and top(dense.dense_top_k(v, [0.0, 1.0], 3, min_score=0.9)) == [3]
    batch = dense.batch_top_k(v, [(10, [1.0, 0.0]), (11, [0.0, 1.0])], 2)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in batch.collect()) == [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 2)]
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in dense.block_top_k(v, asked, 2).collect()) == [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 2)]
    best = dense.best_of_parent(dense.scores(v, [0.0, 1.0]), "label", 5)
    assert [(r.label, r.vec_id) for r in best.collect()] == [(1, 3), (0, 2)]
    assert top(dense.rerank(v.where("vec_id in (1, 2)"), v, [0.0, 1.0])) == [2, 1]
    assert top(dense.prefix_shortlist(v.where("vec_id < 5"), [1.0, 0.0], 1, 3, 2)) == [1, 2]
    assert top(dense.quantised_top_k(v.where("vec_id < 5"), [1.0, 0.1], 2, 4)) == [1, 2]


def test_cells_recall(spark):
    import random

    r = random.Random(1)
    rows = [(i, [r.gauss(c % 4, 0.3), r.gauss(c // 4, 0.3)]) for i in range(400) for c in [i % 8]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centres = dense.train_cells(v, 8)
    celled = v.withColumn("cell", dense.nearest_cells(F.col("embedding"), centres)[0])
    assert celled.where("cell is null").count() == 0
    hits = 0
    for q in ([1.0, 0.2], [3.0, 1.0], [0.5, 1.0]):
        exact = {x.vec_id for x in dense.dense_top_k(v, q, 10).collect()}
        hits += len(exact & {x.vec_id for x in dense.probe_top_k(celled, centres, q, 10, 6).collect()})
    assert hits / 30 >= 0.9


def legs(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)], "doc_id long, score double").repartition(3)
    b = spark.createDataFrame([(3, 7.0), (9, 7.0), (1, 1.0)], "doc_id long, score double")
    return a, b


def test_fusion(spark):
    a, b = legs(spark)
    got = {r.doc_id: (pytest.approx(r.score), r.n_legs) for r in fusion.rrf([a, b], 10).collect()}
    assert got == {1: (1 / 61 + 1 / 63, 2), 3: (1 / 62 + 1 / 61, 2), 2: (1 / 62, 1), 4: (1 / 64, 1), 9: (1 / 61, 1)}
    assert [r.doc_id for r in fusion.tie_complete(a, 2).orderBy("doc_id").collect()] == [1, 2, 3]
    assert {r.doc_id for r in fusion.rrf([a, b], 10, weights=[0.0, 1.0]).collect()} == {1, 3, 9}
    with pytest.raises(Refused):
        fusion.rrf([a, b], 10, weights=[0.0, 0.0])
    blended = {r.doc_id: pytest.approx(r.score) for r in fusion.blend([a, b], 10, [1.0, 1.0]).collect()}
    assert blended == {1: 0.5, 2: 0.25, 3: 0.75, 4: 0.0, 9: 0.5}
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "doc_id long, score double")
    assert {r.score for r in fusion.blend([same], 5, [1.0]).collect()} == {1.0} and {r.score for r in fusion.blend([same], 5, [1.0], "z_score").collect()} == {0.0}
    assert [(r.doc_id, r.score) for r in fusion.cascade(a, b, 2).collect()] == [(3, 7.0), (1, 1.0), (2, 0.0)][:2]
    assert [r.doc_id for r in fusion.decomposed(a, b, 2, 1.0, 1.0).collect()] == [3, 1]
    ranks = {r.doc_id: r["rank"] for r in fusion.boost(a, b, 3, 1.0, 1.0).collect()}
    assert ranks == {3: 1, 1: 2, 2: 3, 4: 4}
    assert fusion.leg_depth(10) == 60 and fusion.leg_depth(100) == 100 and fusion.leg_depth(10, leg_k=5) == 10


def test_index_files(spark, tmp_path, docs):
    path = str(tmp_path / "index")
    tables.write_index(docs, path, buckets=8)
    got = scores(lexical.bm25_indexed(tables.read_postings(spark, path, ["red", "hen"], 8), spark.read.parquet(f"{path}/field_stats"), ["red", "hen"]))
    assert got == brute_bm25(["red", "hen"])


def test_sources(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(struct.pack("<ii4f", 2, 2, 1, 2, 3, 4))
    assert [list(r.embedding) for r in tables.read_vector_file(spark, str(tmp_path / "v.bin")).orderBy("row").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "g.tsv").write_text("c1\tred fox\nc2\thot dog\n")
    assert tables.read_glossary(spark, str(tmp_path / "g.tsv")) == {"c1": "red fox", "c2": "hot dog"}
    (tmp_path / "s.txt").write_text("a, b\nc => d\n")
    assert tables.read_synonyms(spark, str(tmp_path / "s.txt")) == {("a",): [("b",)], ("b",): [("a",)], ("c",): [("d",)]}
    v = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    tables.write_vectors(v, str(tmp_path / "vec"), dims=2)
    assert spark.read.parquet(str(tmp_path / "vec")).count() == 1
    with pytest.raises(Exception, match="not 3 values"):
        tables.write_vectors(v, str(tmp_path / "vec"), dims=3)


def test_cells_recall_with_the_registered_parameters(spark):
    """Recall of dense_cells against all rows, for the stated query set on the embeddings table."""
    d = "/root/testdata/sf0.1"
    if not Path(f"{d}/embeddings.parquet").exists():
        pytest.skip("no test tables here")
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in dense.block_top_k(t, t.where("vec_id % 20 = 0"), 10).collect()}
    got = {(r.query_id, r.vec_id) for r in queries.dense_cells(spark, d).collect()}
    assert len(exact) == 1000 and len(got & exact) / len(exact) >= 0.9


def test_matching_corpus_terms_and_overlapping_phrases(spark):
    rows = [(1, "the The of"), (2, "a a a\ta"), (3, None), (4, " other the "), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in lexical.matching(frame, ["the", "zzz"]).collect()) == [1, 4]
    assert {(r.term, r.df, r.cf) for r in lexical.corpus_terms(frame).collect()} == {("the", 2, 3), ("of", 1, 1), ("a", 1, 4), ("other", 1, 1)}
    assert [(r.doc_id, r.n) for r in lexical.phrase_matches(frame, ["a", "a"]).collect()] == [(2, 3)]
    assert [(r.doc_id, r.n) for r in lexical.phrase_matches(frame, ["the", "of"], slop=1).collect()] == [(1, 2)]
    assert {(r.term, r.doc_id, r.tf, tuple(r.positions), r.dl) for r in lexical.postings(frame).collect()} == {
        ("the", 1, 2, (0, 1), 3), ("of", 1, 1, (2,), 3), ("a", 2, 4, (0, 1, 2, 3), 4), ("other", 4, 1, (0,), 2), ("the", 4, 1, (1,), 2)
    }


def test_searches_as_leaves_provenance_and_lost_pages(spark):
    docs = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, odd int")
    one = spark.createDataFrame([(0, 2.0), (1, 1.0)], "doc_id long, score double")
    two = spark.createDataFrame([(1, 5.0), (4, 4.0)], "doc_id long, score double")
    tree = selection.Bool(should=[selection.found("a"), selection.found("b"), selection.Clause(F.col("odd") == 1)], minimum_should_match=2)
    got = selection.select(selection.searched(docs, {"a": one, "b": two}), tree).select("doc_id", "score").collect()
    assert [tuple(r) for r in got] == [(1, 6.0)]
    rows = {r.doc_id: r for r in fusion.provenance({"a": one, "b": two}, 10).collect()}
    assert (rows[1].a_rank, rows[1].a_score, rows[1].b_rank, rows[1].b_score) == (2, 1.0, 1, 5.0)
    assert rows[0].b_rank is None and abs(rows[1].score - (1 / 62 + 1 / 61)) < 1e-12
    with pytest.raises(Refused):
        selection.sorted_after(docs, [("odd", True)], [1, 0], 3)
    assert [r.doc_id for r in selection.sorted_after(docs, [("odd", True)], [0, 4], 2).collect()] == [1, 3]


def test_stems_of_words_with_digits():
    assert [porter(w) for w in ("1990s", "mp3s", "as", "éclairs")] == ["1990", "mp3", "as", "éclair"]
