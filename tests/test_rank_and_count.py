"""Scores, selection, aggregates, comparison, vocabulary, placement and streams on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from sparkrank.errors import Refused
from sparkrank.operators import aggregates as agg
from sparkrank.operators import compare, placement, scoring, vocabulary
from sparkrank.operators import selection as sel
from sparkrank.streaming.queries import event_windows, progressive_top_k, tail_log


def test_stages(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0), (2, 2.0, None)], "doc_id long, score double, x double")
    out = scoring.chain(df, [lambda s: scoring.exp_decay(s, F.col("x"), 0, 10), lambda s: scoring.log_boost(s, F.col("x"), 2.0), lambda s: scoring.add_linear(s, F.col("x"), 0.5)])
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].score == pytest.approx(2 * math.exp(-1) * (1 + 2 * math.log(11)) + 5) and got[2].score == 2.0
    assert got[1].stage_1 == pytest.approx(2 * math.exp(-1))


def test_composite(spark):
    pool = spark.createDataFrame([(1, 0.0, 4.0), (2, 5.0, None), (3, 10.0, 2.0)], "doc_id long, a double, b double")
    dims = [scoring.Dimension("a", 1.0, "min_max"), scoring.Dimension("b", 2.0, "none", "skip")]
    got = lambda how, d=dims: {r.doc_id: pytest.approx(r.score) for r in scoring.composite(pool, d, how).collect()}
    assert got("weighted_sum") == {1: 8.0, 2: 0.5, 3: 5.0}
    assert got("weighted_mean") == {1: 8 / 3, 2: 0.5, 3: 5 / 3}
    assert got("maximum") == {1: 8.0, 2: 0.5, 3: 4.0}
    assert got("geometric_mean") == {1: 0.0, 2: 0.5, 3: 4 ** (1 / 3)}
    assert got("harmonic_mean") == {1: 0.0, 2: 0.5, 3: 1.5}
    with pytest.raises(Exception, match="a row without b"):
        got("weighted_sum", [scoring.Dimension("b", 1.0, "none", "error")])
    with pytest.raises(Refused):
        got("median")


def test_boolean_trees(spark):
    df = spark.createDataFrame([(1, True, True, None), (2, True, None, True), (3, False, True, False), (4, None, None, None)], "id long, a boolean, b boolean, c boolean")
    a, b, c = (sel.Clause(F.col(x), F.lit(s)) for x, s in (("a", 1.0), ("b", 2.0), ("c", 4.0)))
    got = lambda tree: {r.id: r.score for r in sel.select(df, tree).collect()}
    assert got(sel.Bool(must=[a], should=[b])) == {1: 3.0, 2: 1.0}
    assert got(sel.Bool(should=[a, b, c], minimum_should_match=2)) == {1: 3.0, 2: 5.0}
    assert got(sel.Bool(must_not=[c])) == {1: 0.0, 3: 0.0, 4: 0.0}  # the unknown is not taken away
    assert got(sel.Bool(should=[sel.Bool(must=[a], must_not=[c]), c])) == {1: 1.0, 2: 4.0}
    for bad in (sel.Bool(), sel.Bool(should=[a], minimum_should_match=2)):
        with pytest.raises(Refused):
            sel.boolean(bad)


def test_paging_and_collapse(spark):
    df = spark.createDataFrame([(i, float(i % 3), "k" if i % 2 else None) for i in range(9)], "doc_id long, score double, key string").repartition(4)
    pages, last = [], None
    while True:
        page = (sel.search_after(df, *last, 4) if last else sel.limited(df, 4, F.col("score").desc(), "doc_id")).collect()
        if not page:
            break
        pages += [r.doc_id for r in page]
        last = page[-1].score, page[-1].doc_id
    assert pages == [2, 5, 8, 1, 4, 7, 0, 3, 6]
    with pytest.raises(Refused):
        sel.search_after(df, 2.0, 99, 4)
    (row,) = sel.collapse(df, "key", 5, inner_hits=2).collect()
    assert (row.doc_id, row.pool_hits, list(row.inner_hits)) == (5, 4, [5, 1])
    assert [r.doc_id for r in sel.sort_rows(df, [("key", True), ("score", False)], 3).collect()] == [5, 1, 7]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, v int, p string")
    assert sorted((r.k, r.v, r.p) for r in sel.latest(rows, "k", "v").collect()) == [("a", 3, "y"), ("b", 2, None)]
    assert sel.without_deleted(rows, rows.where("k = 'a'").select("k"), "k").count() == 1
    with pytest.raises(Refused):
        sel.limited(df, 10_001, "doc_id")


def test_aggregates(spark):
    df = spark.createDataFrame([(2**62, 1.0, "a"), (2**62, float("nan"), "a"), (-1, 2.0, None), (None, None, "b")], "n long, x double, g string")
    rows = agg.aggregate(df.where("n < 0 or n is null"), {"s": ("sum", "n"), "c": ("count", "n"), "d": ("cardinality", "x")}, "g").collect()
    assert [(r.g, r.matched, r.s, r.c, r.ungrouped) for r in rows] == [("b", 1, None, 0, 1)]
    assert math.isnan(agg.aggregate(df, {"m": ("min", "x")}).first().m) and agg.aggregate(df.where("g is null"), {"m": ("min", "x")}).first().m == 2.0
    with pytest.raises(Exception, match="64 bits"):
        agg.aggregate(df.where("n > 0"), {"s": ("sum", "n")}).collect()
    for bad in ({"m": ("mean", "n")}, {"m": ("sum", "g")}, {"m": ("median", "x")}, {}):
        with pytest.raises(Refused):
            agg.aggregate(df, bad)
    with pytest.raises(Refused):
        agg.aggregate(df, {"c": ("count", "n")}, "g", max_groups=1)
    h = agg.histogram(df, "x", 2.0).collect()
    assert [(r.bucket, r.n, r.unbucketable) for r in h] == [(0.0, 1, 1), (2.0, 1, 1)]
    assert [(r.low, r.n) for r in agg.range_facet(df, "x", [0, 2, 3]).collect()] == [(0.0, 1), (2.0, 1)]
    assert [(r.value, r.n) for r in agg.facet(df, "g").collect()] == [("a", 2), ("b", 1)]


def test_percentiles(spark):
    values = [5, 1, 9, 9, 3, 7, 2**60, -4]
    df = spark.createDataFrame([(x,) for x in values * 3] + [(None,)], "n long").repartition(5)
    ordered = sorted(values * 3)
    want = {p: ordered[max(1, math.ceil(p / 100 * len(ordered))) - 1] for p in (0, 10, 50, 99, 100)}
    assert {round(r.p): r.value for r in agg.percentiles(df, "n", [(p, 1) for p in want]).collect()} == want
    assert agg.percentiles(df.where("n is null"), "n", [(50, 1)]).count() == 0
    twice = agg.percentiles(df, "n", [(50, 1), (50, 1)]).collect()
    assert [(r.value, r.unrankable) for r in twice] == [(want[50], 0)] * len(twice) and twice
    doubles = spark.createDataFrame([(x,) for x in (2.0, float("nan"), -0.0, 0.0, float("inf"), float("nan"), None)], "x double").repartition(3)
    assert [(r.value, r.unrankable) for r in agg.percentiles(doubles, "x", [(0, 1), (75, 1), (100, 1)]).orderBy("p").collect()] == [(0.0, 2), (2.0, 2), (float("inf"), 2)]
    with pytest.raises(Refused):
        agg.percentiles(df, "n", [(101, 1)])


def test_histogram_limit_counts_buckets_only(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 3.0, 5.0, float("nan"), float("-inf"), None)], "x double")
    assert [(r.bucket, r.n, r.unbucketable) for r in agg.histogram(df, "x", 2.0, max_buckets=3).collect()] == [(0.0, 1, 2), (2.0, 1, 2), (4.0, 1, 2)]
    with pytest.raises(Refused):
        agg.histogram(df, "x", 2.0, max_buckets=2)
    assert agg.histogram(df.where("false"), "x", 2.0).count() == 0


def rank_list(spark, ids):
    return spark.createDataFrame([(d, i + 1, 10.0 - i) for i, d in enumerate(ids)], "doc_id long, rank long, score double")


def test_comparison(spark):
    a, b = rank_list(spark, [1, 2, 3, 4]), rank_list(spark, [2, 1, 5])
    assert compare.overlap(a, b).first()[0] == pytest.approx(2 / 3)
    assert compare.kendall_tau(a, a).first()[0] == 1 and compare.kendall_tau(a, rank_list(spark, [4, 3, 2, 1])).first()[0] == -1
    assert compare.rbo(a, b).first()[0] == pytest.approx(0.1 * (0 + 0.9 * 2 / 2 + 0.81 * 2 / 3))
    r = compare.score_regret(a, b).first()
    assert (r.regret, r.counted, r.unscored) == (pytest.approx((10 - 9 + 9 - 10) / 2), 2, 1)
    assert compare.top1_flipped(a, b).first()[0] and not compare.top1_flipped(a, a).first()[0]
    mixed = compare.interleave(a, b, 5, "s")
    assert len({d for d, _ in mixed}) == 5 and mixed == compare.interleave(a, b, 5, "s") and {d for d, _ in mixed[:2]} == {1, 2}
    assert {x.arm: x.overlap for x in compare.variants({"a": a, "b": b, "c": a}).collect()} == {"b": pytest.approx(2 / 3), "c": 1.0}


def test_vocabulary(spark):
    docs = spark.createDataFrame([(0, "a a b"), (1, "b"), (2, "b c c c")], "doc_id long, text string").repartition(3)
    w = vocabulary.windowed_terms(docs, 2)
    assert sorted((r.window, r.term, r.n) for r in w.collect()) == [(0, "a", 2), (0, "b", 2), (1, "b", 1), (1, "c", 3)]
    assert [(r.window, r.term) for r in vocabulary.heavy_hitters(w, 1).orderBy("window").collect()] == [(0, "a"), (1, "c")]
    d = vocabulary.drift(w, 0, 1).first()
    assert (d.novelty, d.oov_share) == (0.5, 0.75) and 0 < d.js < 1 and vocabulary.drift(w, 0, 0).first().js == 0
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    est = vocabulary.sketches(many, 20_000).select(F.hll_sketch_estimate("distinct_sketch")).first()[0]
    assert abs(est - 20_000) < 600


def test_placement(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (5, "x"), (20, "x"), (20, "y")], "n long, s string")
    levels = [[("low", F.col("n") < 5), ("mid", F.col("n") < 10)], [("x", F.col("s") == "x")]]
    code = placement.leaf(levels)
    assert [(placement.leaf_name(r.leaf, levels), r.n) for r in placement.plan_placement(df, code).collect()] == [("low/default", 1), ("mid/x", 1), ("default/x", 1), ("default/default", 1)]
    placement.write_placed(df, code, str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where("leaf = 257")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    shards = {r.s for r in df.select(placement.route(F.col("s"), 4).alias("s")).collect()}
    assert shards <= {None, 0, 1, 2, 3}


def test_streams(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    rows = [(i, float(i * 7 % 11)) for i in range(20)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "doc_id long, score double").coalesce(1).write.mode("append").parquet(log)
    stream = tail_log(spark, log, spark.read.parquet(log).schema, files_per_batch=1)
    q = progressive_top_k(stream, 3, str(tmp_path / "ck"), str(tmp_path / "state"), lambda df, n: seen.append((n, [r.doc_id for r in df.orderBy(F.col("score").desc(), "doc_id").collect()])))
    q.awaitTermination(120)
    assert [n for n, _ in seen] == sorted({n for n, _ in seen}) and len(seen) >= 4
    assert seen[-1][1] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:3]]
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0)], "event_id long, ts string, event_type string, value double")
    (w,) = event_windows(events.withColumn("ts", F.to_timestamp("ts"))).collect()
    assert (w.n, w.total) == (2, 3.0)
