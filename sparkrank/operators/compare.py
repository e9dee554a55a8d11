"""Comparing rankings: overlap, Kendall's tau-b, rank-biased overlap, regret, interleaving.

A ranking is a DataFrame (doc_id, rank, score), a bounded top-k; its pairs are k squared at most.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: persistence of rank-biased overlap.
RBO_P = 0.9


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows in common over the shorter depth."""
    common = a.select("doc_id").join(b.select("doc_id"), "doc_id").agg(F.count("*").alias("n"))
    depth = a.agg(F.count("*").alias("x")).join(b.agg(F.count("*").alias("y")))
    return common.join(depth).select((F.col("n") / F.when(F.least("x", "y") > 0, F.least("x", "y"))).alias("overlap"))


def _ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both ranks of the union; what a list lacks ties past its end."""
    past = a.agg((F.count("*") + 1).alias("past_a")).join(b.agg((F.count("*") + 1).alias("past_b")))
    both = a.select("doc_id", F.col("rank").alias("ra")).join(b.select("doc_id", F.col("rank").alias("rb")), "doc_id", "full")
    return both.join(F.broadcast(past)).select("doc_id", F.coalesce("ra", "past_a").alias("ra"), F.coalesce("rb", "past_b").alias("rb"))  # one row


def kendall_tau(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: tau-b over the union of two bounded lists."""
    r = _ranks(a, b)
    s = r.select(F.col("doc_id").alias("other"), F.col("ra").alias("sa"), F.col("rb").alias("sb"))
    pairs = r.join(s, F.col("doc_id") < F.col("other"))
    x, y = F.signum(F.col("ra") - F.col("sa")), F.signum(F.col("rb") - F.col("sb"))
    sums = pairs.agg(F.sum(x * y).alias("s"), F.count_if(x != 0).alias("na"), F.count_if(y != 0).alias("nb"))
    spread = F.sqrt(F.col("na").cast("double") * F.col("nb"))
    return sums.select(F.when(spread > 0, F.col("s") / F.when(spread > 0, spread)).alias("tau"))


def rbo(a: DataFrame, b: DataFrame, p: float = RBO_P) -> DataFrame:
    """One row: (1 - p) x sum of p^(d-1) x overlap at d / d, down to the shorter list's depth.

    A document in both lists counts from its later rank on, so its share is a sum over depths.
    """
    depth = a.agg(F.count("*").alias("x")).join(b.agg(F.count("*").alias("y"))).select(F.least("x", "y").alias("depth"))
    both = a.select("doc_id", F.col("rank").alias("ra")).join(b.select("doc_id", F.col("rank").alias("rb")), "doc_id").select(F.greatest("ra", "rb").alias("d"))
    own = both.join(F.broadcast(depth)).where(F.col("d") <= F.col("depth"))  # one row
    share = F.aggregate(F.sequence(F.col("d"), F.col("depth")), F.lit(0.0), lambda acc, d: acc + F.pow(F.lit(p), d - 1) / d)
    return own.agg(F.coalesce((1 - p) * F.sum(share), F.lit(0.0)).alias("rbo"))


def score_regret(reference: DataFrame, other: DataFrame) -> DataFrame:
    """One row: mean reference score lost rank by rank, over ranks whose document the reference scored; how many, and how many not."""
    judged = other.select("rank", "doc_id").join(reference.select("doc_id", F.col("score").alias("own")), "doc_id", "left")
    pairs = judged.join(reference.select("rank", F.col("score").alias("ideal")), "rank", "left")
    counted = F.col("own").isNotNull() & F.col("ideal").isNotNull()
    return pairs.agg(F.avg(F.when(counted, F.col("ideal") - F.col("own"))).alias("regret"), F.count_if(counted).alias("counted"), F.count_if(~counted).alias("unscored"))


def top1_flipped(a: DataFrame, b: DataFrame) -> DataFrame:
    first = lambda r: r.where("rank = 1").agg(F.max("doc_id").alias("d"))
    return first(a).join(first(b).withColumnRenamed("d", "e")).select((~F.col("d").eqNullSafe(F.col("e"))).alias("flipped"))


def interleave(a: DataFrame, b: DataFrame, k: int, seed: str) -> list[tuple[int, str]]:
    """Team draft of two bounded lists: the team with fewer picks goes next, a seeded coin decides ties. On the driver: k rows."""
    lists = {"a": [r["doc_id"] for r in a.orderBy("rank").limit(k).collect()], "b": [r["doc_id"] for r in b.orderBy("rank").limit(k).collect()]}
    picks, out, seen = {"a": 0, "b": 0}, [], set()
    while len(out) < k:
        for team in lists:
            while lists[team] and lists[team][0] in seen:
                lists[team].pop(0)
        able = [t for t in lists if lists[t]]
        if not able:
            break
        fewest = min(picks[t] for t in able)
        able = [t for t in able if picks[t] == fewest]
        coin = hashlib.sha256(f"{seed}:{len(out)}".encode()).digest()[0] % 2
        team = able[0] if len(able) == 1 else able[coin]
        doc = lists[team].pop(0)
        seen.add(doc)
        picks[team] += 1
        out.append((doc, team))
    return out


def variants(arms: dict[str, DataFrame]) -> DataFrame:
    """One row per arm after the first: its overlap, tau, rbo and flip against the first."""
    (_, base), *rest = arms.items()
    out = None
    for name, arm in rest:
        row = overlap(base, arm).join(kendall_tau(base, arm)).join(rbo(base, arm)).join(top1_flipped(base, arm)).select(F.lit(name).alias("arm"), "*")
        out = row if out is None else out.unionByName(row)
    return out
