"""Hybrid search: two ranked legs made one.

A leg is a DataFrame (doc_id, score). Ranks inside a leg are competition ranks - one more than
the number of strictly better rows - so ties share a rank and nothing depends on their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.errors import require
from sparkrank.operators.lexical import ranking

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def leg_depth(k: int, rrf_k: int = RRF_K, leg_k: int | None = None) -> int:
    """Rows a leg gives: max(k, rrf_k) unless said otherwise, and never fewer than k."""
    return max(k, rrf_k if leg_k is None else leg_k)


def tie_complete(leg: DataFrame, depth: int, by: list[str] | None = None) -> DataFrame:
    """Rows whose competition rank is at most depth, with that rank.

    A plain top-k gives the score at the edge; what reaches it is then all there is, so only
    the best rows are ever sorted in one place.
    """
    score = F.col("score").cast("float") + F.lit(0.0).cast("float")
    leg = leg.withColumn("wire", score)
    if by:
        w = Window.partitionBy(*by).orderBy(F.col("wire").desc())
    else:
        edge = leg.select("wire").orderBy(F.col("wire").desc()).limit(depth).agg(F.min("wire").alias("edge"))
        leg = leg.join(F.broadcast(edge), F.col("wire") >= F.col("edge")).drop("edge")  # one row
        w = Window.partitionBy(F.lit(0)).orderBy(F.col("wire").desc())
    return leg.withColumn("rank", F.rank().over(w).cast("long")).where(F.col("rank") <= depth).drop("wire")


def _weights(weights: list[float]) -> None:
    require(all(w >= 0 for w in weights), "a negative weight")
    require(any(w > 0 for w in weights), "all legs disabled")


def rrf(legs: list[DataFrame], k: int, rrf_k: int = RRF_K, weights: list[float] | None = None, leg_k: int | None = None) -> DataFrame:
    """(doc_id, score, n_legs): sum over legs of weight / (rrf_k + rank); a weight of 0 disables a leg."""
    weights = weights or [1.0] * len(legs)
    _weights(weights)
    ranked = [tie_complete(leg, leg_depth(k, rrf_k, leg_k)).select("doc_id", (F.lit(w) / (rrf_k + F.col("rank"))).alias("part")) for leg, w in zip(legs, weights, strict=True) if w > 0]
    fused = reduce(lambda a, b: a.unionByName(b), ranked).groupBy("doc_id").agg(F.sum("part").alias("score"), F.count("*").alias("n_legs"))
    wire, by_id = ranking()
    return fused.orderBy(wire, F.col("n_legs").desc(), by_id).limit(k)


def provenance(legs: dict[str, DataFrame], k: int, rrf_k: int = RRF_K, weights: list[float] | None = None, leg_k: int | None = None) -> DataFrame:
    """The rows of rrf and where they come from: doc_id, score, and for each leg by name its rank and raw score, null where it lacks the row."""
    weights = weights or [1.0] * len(legs)
    _weights(weights)
    ranked = [
        tie_complete(leg, leg_depth(k, rrf_k, leg_k)).select("doc_id", F.lit(name).alias("leg"), "rank", F.col("score").alias("raw"), (F.lit(w) / (rrf_k + F.col("rank"))).alias("part"))
        for (name, leg), w in zip(legs.items(), weights, strict=True)
        if w > 0
    ]
    named = [F.max(F.when(F.col("leg") == n, F.col(c))).alias(f"{n}_{o}") for n in legs for c, o in (("rank", "rank"), ("raw", "score"))]
    fused = reduce(lambda a, b: a.unionByName(b), ranked).groupBy("doc_id").agg(F.sum("part").alias("score"), F.count("*").alias("n_legs"), *named)
    wire, by_id = ranking()
    return fused.orderBy(wire, F.col("n_legs").desc(), by_id).limit(k).drop("n_legs")


def rrf_two_level(legs: list[DataFrame], shard: Column, k: int, rrf_k: int = RRF_K, leg_k: int | None = None) -> DataFrame:
    """RRF inside each shard, then RRF over the shards' lists. shard: an expression over doc_id."""
    depth = leg_depth(k, rrf_k, leg_k)
    ranked = [tie_complete(leg.withColumn("shard", shard), depth, ["shard"]).select("shard", "doc_id", (1 / (rrf_k + F.col("rank"))).alias("part")) for leg in legs]
    inner = reduce(lambda a, b: a.unionByName(b), ranked).groupBy("shard", "doc_id").agg(F.sum("part").alias("score"))
    outer = tie_complete(inner, depth, ["shard"]).select("doc_id", (1 / (rrf_k + F.col("rank"))).alias("score"))
    return outer.orderBy(*ranking()).limit(k)


def _normalised(leg: DataFrame, how: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0))
    score, low, high = F.col("score"), F.min("score").over(w), F.max("score").over(w)
    if how == "min_max":
        norm = F.when(high == low, 1.0).otherwise((score - low) / F.when(high != low, high - low))
    elif how == "z_score":
        deviation = F.stddev_pop("score").over(w)
        norm = F.when(deviation == 0, 0.0).otherwise((score - F.avg("score").over(w)) / F.when(deviation != 0, deviation))
    else:
        require(how == "none", f"normalisation {how}")
        norm = score
    return leg.withColumn("norm", norm)


def blend(legs: list[DataFrame], k: int, weights: list[float] | None = None, normalise: str = "min_max", combine: str = "arithmetic", leg_k: int | None = None) -> DataFrame:
    """(doc_id, score): normalised scores of tie-complete legs, combined by weight.

    Arithmetic divides by the total weight, a missing leg counting 0; geometric and harmonic
    take the legs with positive values and weigh those alone.
    """
    weights = weights or [1.0] * len(legs)
    _weights(weights)
    require(combine in ("arithmetic", "geometric", "harmonic"), f"combination {combine}")
    depth = leg_depth(k, k, leg_k)
    parts = [_normalised(tie_complete(leg, depth), normalise).select("doc_id", F.lit(w).alias("w"), "norm") for leg, w in zip(legs, weights, strict=True) if w > 0]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    total, w, x = sum(weights), F.col("w"), F.col("norm")
    positive = F.when(x > 0, w)
    made = {
        "arithmetic": F.sum(w * x) / total,
        "geometric": F.exp(F.sum(F.when(x > 0, w * F.log(x))) / F.sum(positive)),
        "harmonic": F.sum(positive) / F.sum(F.when(x > 0, w / F.when(x > 0, x))),
    }
    fused = union.groupBy("doc_id").agg(F.coalesce(made[combine], F.lit(0.0)).alias("score"))
    return fused.orderBy(*ranking()).limit(k)


def decomposed(dense: DataFrame, lexical: DataFrame, k: int, dense_weight: float, lexical_weight: float) -> DataFrame:
    """Exact first k of dense_weight x v + lexical_weight x b over every document of the dense leg; b is 0 where no term occurs."""
    require(dense_weight > 0 and lexical_weight > 0, "both weights have to be positive")
    both = dense.join(lexical.withColumnRenamed("score", "lexical"), "doc_id", "left")
    return both.select("doc_id", (dense_weight * F.col("score") + lexical_weight * F.coalesce("lexical", F.lit(0.0))).alias("score")).orderBy(*ranking()).limit(k)


def cascade(dense: DataFrame, lexical: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """Gate by the dense leg, all ties in; order by BM25, then by the dense score, then by id."""
    gate = tie_complete(dense if min_score is None else dense.where(F.col("score") >= min_score), k)
    both = gate.select("doc_id", F.col("score").alias("dense")).join(lexical, "doc_id", "left")
    own = both.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), "dense")
    return own.orderBy(F.col("score").cast("float").desc(), F.col("dense").cast("float").desc(), "doc_id").limit(k)


def boost(base: DataFrame, boosts: DataFrame, window: int, base_weight: float, boost_weight: float) -> DataFrame:
    """Reorder the first `window` rows by base_weight x base + boost_weight x boost; the score shown stays the base.

    base, a bounded pool: (doc_id, score). Returns it with its new rank.
    """
    ranked = base.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ranking())))
    both = ranked.join(boosts.withColumnRenamed("score", "boost"), "doc_id", "left")
    key = base_weight * F.col("score") + boost_weight * F.coalesce("boost", F.lit(0.0))
    inside = F.col("place") <= window
    order = Window.partitionBy(F.lit(0)).orderBy(inside.desc(), F.when(inside, key.cast("float")).desc(), F.when(~inside, F.col("place")), "doc_id")
    return both.select("doc_id", "score", F.row_number().over(order).cast("long").alias("rank"))
