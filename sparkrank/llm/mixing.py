"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain-language-source tree hold tokens; a leaf can be read max_epochs times.
From the root down, a node's budget goes to its children by weight; a child that has less than
its share gives all it has, and the shortage goes to its siblings by their weights. A budget
never exceeds what a node's leaves hold, so a shortage leaves a node only when all its children
are used up: siblings come before ancestors. What a node holds is what its leaves may give: a leaf
that has weight 0 itself, or under a node of weight 0, holds nothing. All of this is integer arithmetic in windows over
the (small) table of nodes.

A leaf's budget is whole epochs and a prefix of one more, in an order seeded for leaf and epoch.
Prefix sums are taken in two steps - over SLICES slices of the order, then in each slice - so a
source with a third of all rows is spread over as many tasks.

Null domains, languages and sources are nodes named "". A null text has no tokens; such rows
are part of every whole epoch. Nodes with weight 0 get nothing. Equal rows tie; their order does
not change how many of them are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.llm.shared import join_hot, written

#: Hexadecimal digits of the seeded order that name a slice: 4096 slices of a leaf.
SLICE_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def count_tokens(text: Column) -> Column:
    """Words between characters of [\\x20\\x09-\\x0D]."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(levels: tuple[str, ...], weights: dict[tuple[str, ...], int]) -> Column:
    """The weight of a node: that of the longest listing that fits, "*" fitting any name; else 1."""
    out = F.lit(1).cast("long")
    listed = sorted((p for p in weights if len(p) == len(levels)), key=lambda p: (sum(x != "*" for x in p), p))
    for path in listed:
        fits = F.lit(True)
        for level, name in zip(levels, path, strict=True):
            if name != "*":
                fits = fits & (F.col(level) == name)
        out = F.when(fits, F.lit(weights[path]).cast("long")).otherwise(out)
    return out


def allocate(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of the children of each parent: nodes has parent columns, name, budget (of the parent), weight and cap."""
    own = Window.partitionBy(*(parent or [F.lit(0)]))
    order = own.orderBy((F.col("cap") / F.col("weight")), name)
    upto, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    full = F.col("cap") * F.sum("weight").over(onward) <= left * F.col("weight")
    nodes = nodes.where("weight > 0").withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(own), F.lit(0))
    weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(own)
    nodes = nodes.withColumn("rest", rest).withColumn("open", weight)
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(rest * weight) div open"))
    return nodes.select(*parent, name, given.cast("long").alias("given"))


def plan_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], budget: int, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens, rows. Returns domain, lang, source, tokens, rows, given."""
    drawn = F.lit(True)
    for depth in range(1, len(LEVELS) + 1):
        drawn = drawn & (_weight(LEVELS[:depth], weights) > 0)
    leaves = leaves.where(drawn).withColumn("cap", F.col("tokens") * max_epochs)
    given = None
    for depth in range(1, len(LEVELS) + 1):
        levels = LEVELS[:depth]
        nodes = leaves.groupBy(*levels).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(levels, weights))
        parent = list(levels[:-1])
        if given is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget).cast("long"), F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(given.withColumnRenamed("given", "budget"), parent)
        given = allocate(nodes, parent, levels[-1])
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "tokens", "rows", "given")


def mix_sources(
    docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], share: float | None = None, budget: int | None = None, max_epochs: int = 2, seed: int = 0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Rows to train on, one per document and epoch: doc_id, domain, lang, source, n_tokens, epoch.

    domain: an expression over docs. The budget in tokens, or as a share of docs' own tokens.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), named(domain).alias("domain"), named(F.col(f"`{lang}`")).alias("lang"), named(F.col(f"`{source}`")).alias("source"), count_tokens(F.col(f"`{text}`")).alias("n_tokens")
    )
    own = written(own, "tokens")  # a few bytes a row: the texts are read once
    leaves = own.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    # a leaf without tokens is read once, for it costs nothing
    plan = plan_budgets(leaves, weights, budget, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(1))
    plan = plan.select(*LEVELS, "rows", epochs.alias("epochs"), (F.col("given") - F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0)) * F.col("tokens")).alias("rest"))
    own = join_hot(own, written(plan, "plan"), list(LEVELS), "rows").where("epochs is not null").drop("rows")
    whole = own.where("epochs > 0").select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    place = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = own.where("rest > 0").withColumn("place", place).withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    sums = part.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    # what begins at the end of the prefix or later cannot be in it
    part = part.join(sums, [*LEVELS, "slice"]).where("before <= rest")
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).where("upto <= rest")
    return whole.union(part.select("doc_id", *LEVELS, "n_tokens", F.col("epochs").alias("epoch")))
