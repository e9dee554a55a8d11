"""Column kinds of a corpus, and a plan of a table's fields with a fingerprint."""

from __future__ import annotations

import hashlib
import json
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.errors import Refused, UnknownColumn


class Kind(Enum):
    FACET = "facet"
    NUMERIC = "numeric"
    INTEGER = "integer"
    UNSIGNED = "unsigned"
    TIMESTAMP = "timestamp"
    GEO = "geo"
    MAP_FACET = "map facet"
    MAP_NUMERIC = "map numeric"
    MAP_INTEGER = "map integer"
    TEXT = "text"
    VECTOR = "vector"
    BOOLEAN = "boolean"
    NONE = "none"


def kind_of(data_type: T.DataType) -> Kind:
    """The kind a Spark type stands for; what has none is not searchable."""
    if isinstance(data_type, T.StringType):
        return Kind.FACET
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return Kind.NUMERIC
    if isinstance(data_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return Kind.INTEGER
    if isinstance(data_type, T.DecimalType) and data_type.scale == 0:
        return Kind.UNSIGNED
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return Kind.TIMESTAMP
    if isinstance(data_type, T.StructType) and data_type.names == ["lat", "lon"]:
        return Kind.GEO
    if isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType):
        value = kind_of(data_type.valueType)
        return {Kind.FACET: Kind.MAP_FACET, Kind.NUMERIC: Kind.MAP_NUMERIC, Kind.INTEGER: Kind.MAP_INTEGER}.get(value, Kind.NONE)
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, (T.FloatType, T.DoubleType)):
        return Kind.VECTOR
    if isinstance(data_type, T.BooleanType):
        return Kind.BOOLEAN
    return Kind.NONE


def plan_schema(schema: T.StructType, hints: dict[str, Kind] | None = None) -> tuple[dict[str, Kind], str]:
    """Field name to kind, and a SHA-256 fingerprint of that; a hint that the type cannot carry is refused."""
    plan = {}
    hints = hints or {}
    for name in hints:
        if name not in schema.names:
            raise UnknownColumn("schema", name)
    for field in schema.fields:
        kind, hint = kind_of(field.dataType), hints.get(field.name)
        if hint and hint is not kind and (hint, kind) not in ((Kind.TEXT, Kind.FACET), (Kind.TIMESTAMP, Kind.INTEGER)):
            raise Refused(f"{field.name} is {kind.value}, not {hint.value}")
        plan[field.name] = hint or kind
    listed = json.dumps([[name, kind.value] for name, kind in sorted(plan.items())])
    return plan, hashlib.sha256(listed.encode()).hexdigest()


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: its kind, how many rows have a value, and rows in all. One pass over the table."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(kind_of(f.dataType).value).alias("kind"), F.col(f"c{i}").alias("present"), F.col("n").alias("total")) for i, f in enumerate(df.schema.fields)])
    return counts.select(F.inline(rows))
