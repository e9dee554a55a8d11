"""Score functions over stored values, and composite scores over a pool of candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.errors import require
from sparkrank.functions.geo import haversine, manhattan
from sparkrank.operators.lexical import ranking

# stages: each takes the score so far; an absent value leaves it as it is


def exp_decay(score: Column, x: Column, origin: float, scale: float) -> Column:
    require(scale > 0, f"a scale of {scale}")
    return _kept(score, score * F.exp(-F.abs(x - origin) / scale))


def log_boost(score: Column, x: Column, weight: float) -> Column:
    return _kept(score, score * (1 + weight * F.log(1 + F.greatest(x, F.lit(0.0)))), x)


def add_linear(score: Column, x: Column, weight: float) -> Column:
    return _kept(score, score + weight * x)


def geo_decay(score: Column, lat: Column, lon: Column, lat0: float, lon0: float, scale: float, metric: str = "haversine") -> Column:
    require(metric in ("haversine", "manhattan"), f"the metric {metric}")
    metres = (haversine if metric == "haversine" else manhattan)(lat, lon, lat0, lon0)
    return _kept(score, score * F.exp(-metres / scale))


def _kept(score: Column, made: Column, x: Column | None = None) -> Column:
    return F.coalesce(made if x is None else F.when(x.isNotNull(), made), score)


def chain(scored: DataFrame, stages: Sequence, score: str = "score") -> DataFrame:
    """Apply stages - functions of the score so far - in order, keeping each one's result as stage_1, stage_2, .. for an explanation."""
    for i, stage in enumerate(stages, 1):
        scored = scored.withColumn(f"stage_{i}", stage(F.col(score if i == 1 else f"stage_{i - 1}")))
    return scored.withColumn(score, F.col(f"stage_{len(stages)}")) if stages else scored


# composite scores


@dataclass(frozen=True)
class Dimension:
    """A signal of the pool, its weight, its normalisation (none, min_max, z_score) and what a missing value does (zero, skip, error)."""

    column: str
    weight: float = 1.0
    normalise: str = "none"
    missing: str = "zero"


def _dimension(d: Dimension) -> Column:
    """Normalised over the pool's present values."""
    x, pool = F.col(f"`{d.column}`").cast("double"), Window.partitionBy(F.lit(0))
    if d.normalise == "none":
        return x
    if d.normalise == "min_max":
        low, high = F.min(x).over(pool), F.max(x).over(pool)
        return F.when(x.isNotNull(), F.when(high == low, 1.0).otherwise((x - low) / F.when(high != low, high - low)))
    require(d.normalise == "z_score", f"normalisation {d.normalise}")
    deviation = F.stddev_pop(x).over(pool)
    return F.when(x.isNotNull(), F.when(deviation == 0, 0.0).otherwise((x - F.avg(x).over(pool)) / F.when(deviation != 0, deviation)))


def composite(pool: DataFrame, dimensions: Sequence[Dimension], combine: str, doc_id: str = "doc_id") -> DataFrame:
    """The pool with a new score: weighted_sum, weighted_mean, maximum, product, geometric_mean or harmonic_mean of its dimensions.

    A missing value counts 0 with its weight, or is skipped with its weight, or makes the query
    fail when it runs; so does a result that is no finite number. A pool is a bounded top-k.
    """
    require(len(dimensions) > 0, "no dimensions")
    made = pool
    for i, d in enumerate(dimensions):
        require(d.missing in ("zero", "skip", "error"), f"missing values by {d.missing}")
        made = made.withColumn(f"_d{i}", _dimension(d))
    values, weights = [], []
    for i, d in enumerate(dimensions):
        x, absent = F.col(f"_d{i}"), F.col(f"_d{i}").isNull()
        if d.missing == "zero":
            values.append(F.coalesce(x, F.lit(0.0)))
            weights.append(F.lit(float(d.weight)))
        elif d.missing == "skip":
            values.append(x)
            weights.append(F.when(~absent, F.lit(float(d.weight))))
        else:
            values.append(F.when(absent, F.raise_error(F.lit(f"a row without {d.column}"))).otherwise(x))
            weights.append(F.lit(float(d.weight)))
    pairs = list(zip(values, weights, strict=True))
    zero, one = F.lit(0.0), F.lit(1.0)
    total = reduce(lambda a, b: a + b, [F.coalesce(w, zero) for w in weights])
    weighed = reduce(lambda a, b: a + b, [F.coalesce(w * v, zero) for v, w in pairs])
    positive = [F.coalesce(v > 0, F.lit(True)) for v in values]
    all_positive = reduce(lambda a, b: a & b, positive)
    logs = reduce(lambda a, b: a + b, [F.coalesce(w * F.log(F.when(v > 0, v)), zero) for v, w in pairs])
    inverses = reduce(lambda a, b: a + b, [F.coalesce(w / F.when(v > 0, v), zero) for v, w in pairs])
    some = F.when(total > 0, total)
    results = {
        "weighted_sum": lambda: weighed,
        "weighted_mean": lambda: weighed / some,
        "maximum": lambda: F.greatest(*[w * v for v, w in pairs]) if len(pairs) > 1 else pairs[0][1] * pairs[0][0],
        "product": lambda: reduce(lambda a, b: a * b, [F.coalesce(F.pow(v, w), one) for v, w in pairs]),
        "geometric_mean": lambda: F.when(all_positive, F.exp(logs / some)).otherwise(0.0),
        "harmonic_mean": lambda: F.when(all_positive, some / F.when(inverses > 0, inverses)).otherwise(0.0),
    }
    require(combine in results, f"combination {combine}")
    score = F.coalesce(results[combine](), zero)
    finite = F.when(F.isnan(score) | (F.abs(score) == float("inf")), F.raise_error(F.lit("a score that is no finite number"))).otherwise(score)
    return made.withColumn("score", finite).drop(*[f"_d{i}" for i in range(len(dimensions))]).orderBy(*ranking("score", doc_id))


def sentence_overlap(query_terms: Column, sentence_terms: Column) -> Column:
    """Share of the query's distinct terms that the best sentence holds. sentence_terms: array of arrays."""
    n = F.size(F.array_distinct(query_terms))
    shares = F.transform(sentence_terms, lambda s: F.size(F.array_intersect(query_terms, s)) / F.when(n > 0, n))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


#: Weights of the deterministic second stage.
OVERLAP_WEIGHT, PRIOR_WEIGHT, BIAS = 2.5, 0.75, -0.5


def second_stage(overlap: Column, prior: Column) -> Column:
    """A logistic score from sentence overlap and the first stage's score."""
    return 1 / (1 + F.exp(-(OVERLAP_WEIGHT * overlap + PRIOR_WEIGHT * F.tanh(prior) + BIAS)))
