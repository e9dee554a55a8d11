"""Vocabulary windows over a stream of documents, their sketches, and drift between windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.functions.analysis import INGEST, Analysis, terms


def windowed_terms(docs: DataFrame, size: int, text: str = "text", sequence: str = "doc_id", analysis: Analysis = INGEST) -> DataFrame:
    """(window, term, n): tumbling windows of so many documents by their sequence number; exact and mergeable."""
    own = docs.select(F.floor(F.col(sequence) / size).cast("long").alias("window"), F.explode(F.filter(terms(F.col(text), analysis), lambda t: t != "")).alias("term"))
    return own.groupBy("window", "term").agg(F.count("*").alias("n"))


def heavy_hitters(windowed: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms of each window, by count, then bytes. Spark keeps the first k of each task before the shuffle."""
    place = Window.partitionBy("window").orderBy(F.col("n").desc(), "term")
    return windowed.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k)


def sketches(docs: DataFrame, size: int, text: str = "text", sequence: str = "doc_id", analysis: Analysis = INGEST) -> DataFrame:
    """(window, n_tokens, distinct_sketch): a HyperLogLog of 2^14 registers per window, to be merged by hll_union_agg."""
    own = docs.select(F.floor(F.col(sequence) / size).cast("long").alias("window"), F.explode(F.filter(terms(F.col(text), analysis), lambda t: t != "")).alias("term"))
    return own.groupBy("window").agg(F.count("*").alias("n_tokens"), F.hll_sketch_agg("term", F.lit(14)).alias("distinct_sketch"))


def drift(windowed: DataFrame, a: int, b: int) -> DataFrame:
    """One row: novelty (share of b's terms that a lacks), oov_share (of b's tokens), and the Jensen-Shannon divergence in bits."""
    n = F.col("n")
    both = windowed.where(F.col("window").isin(a, b)).groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("window") == a, n)), F.lit(0)).alias("na"), F.coalesce(F.sum(F.when(F.col("window") == b, n)), F.lit(0)).alias("nb"))
    totals = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    p, q = F.col("na") / F.col("ta"), F.col("nb") / F.col("tb")
    middle = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    rows = both.join(F.broadcast(totals))  # one row
    sums = rows.agg(F.count_if((F.col("na") == 0) & (F.col("nb") > 0)).alias("new"), F.count_if(F.col("nb") > 0).alias("kinds"), F.sum(F.when(F.col("na") == 0, F.col("nb")).otherwise(0)).alias("oov"), F.sum("nb").alias("tokens"), (F.sum(part(p)) / 2 + F.sum(part(q)) / 2).alias("js"))
    return sums.select((F.col("new") / F.col("kinds")).alias("novelty"), (F.col("oov") / F.col("tokens")).alias("oov_share"), "js")
