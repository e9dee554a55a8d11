"""Placement: an ordered list of conditions decides the leaf of each row; the leaf is a partition column."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.errors import require
from sparkrank.functions.values import fnv1a


def leaf(levels: Sequence[Sequence[tuple[str, Column]]], bits: int = 8) -> Column:
    """Code of a row's leaf. Each level is a list of (name, condition); the first that is true wins, none is the default, last."""
    require(bits * len(levels) <= 63, "more levels than fit in a code")
    code = F.lit(0).cast("long")
    for level in levels:
        require(len(level) < 2**bits, "more branches than a level's bits")
        branch = F.lit(len(level))
        for i in range(len(level) - 1, -1, -1):
            branch = F.when(level[i][1], F.lit(i)).otherwise(branch)
        code = code * 2**bits + branch
    return code


def leaf_name(code: int, levels: Sequence[Sequence[tuple[str, Column]]], bits: int = 8) -> str:
    parts = []
    for i, level in enumerate(reversed(levels)):
        branch = (code >> (bits * i)) % 2**bits
        parts.append(level[branch][0] if branch < len(level) else "default")
    return "/".join(reversed(parts))


def plan_placement(df: DataFrame, code: Column) -> DataFrame:
    """(leaf, n): a dry run."""
    return df.groupBy(code.alias("leaf")).agg(F.count("*").alias("n")).orderBy("leaf")


def write_placed(df: DataFrame, code: Column, path: str) -> None:
    """Write a table with a folder per leaf, so that a filter on leaf reads its folders only; rows of one leaf may go to several tasks."""
    df.withColumn("leaf", code).write.partitionBy("leaf").parquet(path)


def route(key: Column, shards: int) -> Column:
    """Shard of a stable key: FNV-1a of its bytes, scaled to the number of shards. An Arrow function."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else (fnv1a(k.encode() if isinstance(k, str) else bytes(k)) * shards) >> 64)

    return shard(key)
