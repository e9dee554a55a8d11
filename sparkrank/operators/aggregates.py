"""Exact aggregates, histograms, percentiles and facets over a match set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.errors import require
from sparkrank.functions.calendar import bucket_start
from sparkrank.staging import staging_folder

#: Limits of a request.
MAX_AGGREGATES, MAX_GROUPS, MAX_BUCKETS, MAX_DISTINCT = 32, 1000, 1024, 100_000


def metric(kind: str, x: Column, data_type: T.DataType) -> Column:
    """One aggregate. Whole numbers sum exactly, and a sum outside 64 bits is refused when the query runs; NaN poisons extremes."""
    whole = isinstance(data_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType))
    double = isinstance(data_type, (T.DoubleType, T.FloatType))
    if kind == "count":
        return F.count(x)
    if kind == "cardinality":
        return F.count_distinct(x)
    require(whole or double, f"{kind} of {data_type.simpleString()}")
    if kind == "sum" and whole:
        total = F.sum(x.cast("decimal(38,0)"))
        fits = total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
        return F.when(total.isNull() | fits, total.cast("decimal(19,0)").try_cast("long")).otherwise(F.raise_error(F.lit("the sum leaves 64 bits: sum double() of it")).cast("long"))
    if kind == "sum":
        return F.sum(x)
    if kind in ("min", "max"):
        best = F.min(x) if kind == "min" else F.max(x)
        return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(best) if double else best
    require(double, f"{kind} of whole numbers: take double() of it")
    made = {"mean": F.avg, "variance": F.var_pop, "stddev": F.stddev_pop}
    require(kind in made, f"the aggregate {kind}")
    return made[kind](x)


def aggregate(df: DataFrame, wanted: Mapping[str, tuple[str, str]], by: str | None = None, max_groups: int = MAX_GROUPS, strict: bool = True) -> DataFrame:
    """Aggregates {name: (kind, column)} of the rows, or of each value of a facet, in its order.

    Rows without the facet are counted in the column ungrouped of every row. strict: more than
    max_groups groups, or MAX_DISTINCT distinct values, are refused, which runs the plan once more.
    """
    require(1 <= len(wanted) <= MAX_AGGREGATES, f"{len(wanted)} aggregates")
    made = [metric(kind, F.col(f"`{c}`"), df.schema[c].dataType).alias(name) for name, (kind, c) in wanted.items()]
    if by is None:
        out = df.agg(F.count("*").alias("matched"), *made)
    else:
        groups = df.groupBy(by).agg(F.count("*").alias("matched"), *made)
        if strict:
            n = groups.where(F.col(by).isNotNull()).limit(max_groups + 1).count()
            require(n <= max_groups, f"more than {max_groups} groups")
        lost = F.coalesce(F.sum(F.when(F.col(by).isNull(), F.col("matched"))).over(Window.partitionBy(F.lit(0))), F.lit(0))
        out = groups.withColumn("ungrouped", lost).where(F.col(by).isNotNull()).orderBy(by)
    distinct = [name for name, (kind, _) in wanted.items() if kind == "cardinality"]
    if strict and distinct:
        most = out.agg(*[F.max(d).alias(d) for d in distinct]).first()
        for d in distinct:
            require((most[d] or 0) <= MAX_DISTINCT, f"{d}: more than {MAX_DISTINCT} distinct values")
    return out


def histogram(df: DataFrame, column: str, width: float, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(bucket, n) of floor(x / width) x width where there are rows; NaN and infinities are counted as unbucketable."""
    require(width > 0, f"a width of {width}")
    x = F.col(f"`{column}`")
    fit = F.lit(True)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        fit = ~F.isnan(x) & (F.abs(x) < float("inf"))
    key = F.when(fit, F.floor(x / width).cast("double") * width)
    # what has no bucket is a group of its own, so the input is read once
    groups = df.where(x.isNotNull()).groupBy(key.alias("bucket")).agg(F.count("*").alias("n"))
    first = groups.orderBy(F.asc_nulls_first("bucket")).limit(max_buckets + 2).collect()
    lost = sum(r["n"] for r in first if r["bucket"] is None)
    rows = [(r["bucket"], r["n"], lost) for r in first if r["bucket"] is not None]
    require(len(rows) <= max_buckets, f"more than {max_buckets} buckets")
    return df.sparkSession.createDataFrame(rows, "bucket double, n long, unbucketable long")


def calendar_histogram(df: DataFrame, column: str, unit: str, offset_minutes: int = 0) -> DataFrame:
    """(bucket, n): bucket is the start of the calendar unit, in microseconds."""
    x = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(x.cast("timestamp"))
    return df.where(x.isNotNull()).groupBy(bucket_start(x, unit, offset_minutes).alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")


def percentiles(df: DataFrame, column: str, ps: Sequence[tuple[int, int]]) -> DataFrame:
    """(p, value, unrankable): nearest rank, max(1, ceil(p / 100 x n)); p as a fraction (numerator, denominator) of 100 per cent.

    NaN has no rank and is counted as unrankable. The column is counted once: its distinct values
    are written down in ranges of their order, a folder each, and every wanted rank reads the one
    range that holds it, so no task sorts the whole column. Without a value there are no rows.
    """
    require(all(0 <= num <= 100 * den for num, den in ps), f"percentiles of {list(ps)}")
    spark, kind = df.sparkSession, df.schema[column].dataType
    x = F.col(f"`{column}`")
    counts = df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count("*").alias("n"))
    folder = staging_folder(spark, "percentiles")
    counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(folder)
    schema = T.StructType([T.StructField("value", kind), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType())])
    ranged = spark.read.schema(schema).parquet(folder)
    lost = F.isnan("value") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
    held = ranged.groupBy("part").agg(F.sum(F.when(~lost, F.col("n"))).alias("held"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("lost"))
    edges = held.orderBy("part").collect()  # one row per range
    total, unrankable = sum(e["held"] or 0 for e in edges), sum(e["lost"] for e in edges)
    made = "p double, rank long, part int, before long"
    wanted = []
    for num, den in ps if total else ():
        rank, before = max(1, -(-num * total // (100 * den))), 0
        for e in edges:
            if before + (e["held"] or 0) >= rank:
                wanted.append((num / den, rank, e["part"], before))
                break
            before += e["held"] or 0
    parts = sorted({w[2] for w in wanted})
    upto = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.where(~lost & F.col("part").isin(parts)).withColumn("upto", F.sum("n").over(upto))
    at = F.broadcast(spark.createDataFrame(wanted, made))  # one row per percentile
    hit = inside.join(at, "part").where(F.col("upto") + F.col("before") >= F.col("rank"))
    return hit.groupBy("p", "rank").agg(F.min("value").alias("value")).select("p", "value", F.lit(unrankable).cast("long").alias("unrankable"))


# facets


def facet(df: DataFrame, column: str | Column, k: int | None = None) -> DataFrame:
    """(value, n) over the whole match set, whatever the answer's k; by count, then bytes."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    out = df.select(c.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")
    return out.limit(k) if k else out


def map_facet(df: DataFrame, column: str, key: str, k: int | None = None) -> DataFrame:
    return facet(df, F.try_element_at(F.col(f"`{column}`"), F.lit(key)), k)


def range_facet(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """(low, high, n) for each pair of neighbouring edges, high excluded; buckets without rows too, in one pass."""
    require(len(edges) >= 2 and all(a < b for a, b in zip(edges, edges[1:], strict=False)), "edges have to ascend")
    x = F.col(f"`{column}`")
    pairs = list(zip(edges, edges[1:], strict=False))
    counts = df.agg(*[F.count_if((x >= a) & (x < b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))


def facet_cardinality(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(F.col(f"`{column}`")).alias("n"))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per number column: present, min, max, sum and mean, as doubles, and the exact sum of whole numbers. One pass."""
    parts = []
    for c in columns:
        x, whole = F.col(f"`{c}`"), not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        exact = F.sum(x.cast("decimal(38,0)")).cast("string") if whole else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("present"), F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"), F.sum(x.cast("double")).alias("sum"), F.avg(x.cast("double")).alias("mean"), exact.alias("exact_sum")))
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
