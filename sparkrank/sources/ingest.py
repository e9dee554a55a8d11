"""From raw records to a corpus: projection by a field plan, derived columns, routing and replacement."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.errors import Refused, UnknownColumn, require
from sparkrank.operators.placement import route
from sparkrank.schema import Kind, kind_of

#: The Spark type in which a kind is stored.
STORED = {Kind.FACET: "string", Kind.TEXT: "string", Kind.NUMERIC: "double", Kind.INTEGER: "bigint", Kind.UNSIGNED: "decimal(20,0)", Kind.TIMESTAMP: "bigint", Kind.VECTOR: "array<float>", Kind.GEO: "struct<lat: double, lon: double>", Kind.MAP_FACET: "map<string,string>", Kind.MAP_NUMERIC: "map<string,double>", Kind.MAP_INTEGER: "map<string,bigint>"}


def map_records(records: DataFrame, plan: Mapping[str, tuple[str, Kind]]) -> DataFrame:
    """Columns of a corpus from nested records. plan: name to (path of the field, kind).

    Timestamps become microseconds; a point out of range, or a number that is not finite, fails
    the write, for it could be neither stored nor found.
    """
    made = []
    for name, (path, kind) in plan.items():
        require(kind in STORED, f"{name}: {kind.value} is not stored")
        c = F.col(path)
        if kind is Kind.TIMESTAMP:
            c = F.unix_micros(c.cast("timestamp"))
        c = c.cast(STORED[kind])
        if kind is Kind.NUMERIC:
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(c)
        if kind is Kind.GEO:
            fits = c["lat"].between(-90, 90) & c["lon"].between(-180, 180)
            c = F.when(c.isNull() | fits, c).otherwise(F.raise_error(F.lit(f"{name} is no place")).cast(STORED[kind]))
        made.append(c.alias(name))
    return records.select(*made)


@dataclass(frozen=True)
class Derived:
    """A column computed at ingest: an expression, its kind, and the columns it reads (it is disclosed only with these)."""

    value: Column
    kind: Kind
    inputs: frozenset[str]


def derive(df: DataFrame, columns: Mapping[str, Derived]) -> tuple[DataFrame, str]:
    """The table with derived columns, and a fingerprint of their declaration."""
    for name, d in columns.items():
        require(d.kind in (Kind.NUMERIC, Kind.INTEGER, Kind.UNSIGNED, Kind.FACET), f"{name}: a derived {d.kind.value}")
        require(name not in df.columns, f"{name} is there already")
        for i in d.inputs:
            if i not in df.columns:
                raise UnknownColumn("table", i)
    out = df.withColumns({n: d.value for n, d in columns.items()})
    for name, d in columns.items():
        if kind_of(out.schema[name].dataType) is not d.kind:
            raise Refused(f"{name} is {kind_of(out.schema[name].dataType).value}, declared as {d.kind.value}")
    listed = json.dumps([[n, d.kind.value, sorted(d.inputs), str(d.value)] for n, d in sorted(columns.items())])
    return out, hashlib.sha256(listed.encode()).hexdigest()


def write_routed(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Append to a folder per shard of a stable key."""
    df.withColumn("shard", route(F.col(key), shards)).write.mode("append").partitionBy("shard").parquet(path)


def replace_documents(current: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Arriving rows in place of those with their keys; what does not arrive stays."""
    return current.join(arriving.select(key).distinct(), key, "left_anti").unionByName(arriving)
