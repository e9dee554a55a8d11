"""Value expressions that give null (absent) where the answer does not exist, and IEEE arithmetic on doubles.

Spark is ANSI by default: overflow and division by zero raise. Here whole numbers that overflow
are absent, and doubles follow IEEE 754: infinities and NaN, which is unequal to itself.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.errors import require

LEAST_LONG = -(2**63)
_U64 = "decimal(20,0)"


def _inf() -> Column:
    return F.lit(float("inf"))


def _nan() -> Column:
    return F.lit(float("nan"))


# whole numbers

#: Bits of the whole types' magnitudes.
_BITS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def _in_range(made: Column, near: Column) -> Column:
    """made, absent where `near`, the same computed in doubles, is out of its type's range.

    The try_ functions find an overflow by an exception, which costs a row tens of microseconds.
    A double is at most some thousands off, so only next to the limit is it left to them.
    """
    kind, limit = F.typeof(made), F.lit(0.0)
    for name, bits in _BITS.items():
        limit = F.when(kind == name, 2.0**bits * (1 + 2.0**-50)).otherwise(limit)
    return F.when(kind.isin(list(_BITS)) & (F.abs(near) > limit), None).otherwise(made)


def add(a: Column, b: Column) -> Column:
    return _in_range(F.try_add(a, b), a.cast("double") + b.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return _in_range(F.try_subtract(a, b), a.cast("double") - b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return _in_range(F.try_multiply(a, b), a.cast("double") * b.cast("double"))


def divide(a: Column, b: Column) -> Column:
    """Toward zero; absent for a zero divisor and for the one overflow."""
    safe = F.when((b != 0) & ~((a == LEAST_LONG) & (b == -1)), b)
    return F.call_function("div", a, safe)


def modulo(a: Column, b: Column) -> Column:
    """The sign of the dividend; absent where divide is."""
    return F.when(~((a == LEAST_LONG) & (b == -1)), F.try_mod(a, b))


def negate(a: Column) -> Column:
    return F.try_subtract(F.lit(0).cast("long"), a)


def unsigned(op: str, a: Column, b: Column) -> Column:
    """Checked arithmetic in 0 .. 2**64-1, on decimal(20,0)."""
    wide_a, wide_b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    made = {
        "+": lambda: F.try_add(wide_a.cast("decimal(38,0)"), wide_b.cast("decimal(38,0)")), "-": lambda: F.try_subtract(wide_a.cast("decimal(38,0)"), wide_b.cast("decimal(38,0)")),
        "*": lambda: F.try_multiply(wide_a.cast("decimal(38,0)"), wide_b.cast("decimal(38,0)")), "/": lambda: F.floor(F.try_divide(wide_a.cast("decimal(38,0)"), wide_b.cast("decimal(38,0)"))),
        "%": lambda: F.try_mod(wide_a, wide_b),
    }
    require(op in made, f"operator {op}")
    out = made[op]()
    return F.when((out >= 0) & (out <= F.lit(Decimal(2**64 - 1))), out).cast(_U64)


# doubles


def ieee_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


def ieee_compare(op: str, a: Column, b: Column) -> Column:
    """NaN is unequal to everything and in no order."""
    made = {"==": a == b, "!=": ~(a == b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    require(op in made, f"operator {op}")
    present = a.isNotNull() & b.isNotNull()
    return F.when(present & (F.isnan(a) | F.isnan(b)), F.lit(op == "!=")).when(present, made[op])


def ln(x: Column) -> Column:
    """-inf at 0 and NaN below, where Spark's is null."""
    return F.when(x == 0, -_inf()).when((x < 0) | F.isnan(x), _nan()).otherwise(F.log(x))


def log10(x: Column) -> Column:
    return F.when(x == 0, -_inf()).when((x < 0) | F.isnan(x), _nan()).otherwise(F.log10(x))


def sign(x: Column) -> Column:
    """Of the argument's type; NaN stays and both zeros give zero."""
    one = F.when(x > 0, F.lit(1)).when(x < 0, F.lit(-1)).when(x == 0, F.lit(0))
    return one


def double_sign(x: Column) -> Column:
    return F.when(F.isnan(x), x).when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).when(x == 0, F.lit(0.0))


def absolute(x: Column) -> Column:
    """Of a whole number; absent for the least one."""
    return F.when(x != LEAST_LONG, F.abs(x))


def _rounded(x: Column, made: Column) -> Column:
    """From 2**52 on a double is whole, and Spark's functions pass through a long that may overflow."""
    small = F.when(F.abs(x) < 2.0**52, x)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(made if made is not None else small)


def ceil(x: Column) -> Column:
    return _rounded(x, F.ceil(F.when(F.abs(x) < 2.0**52, x)).cast("double"))


def floor(x: Column) -> Column:
    return _rounded(x, F.floor(F.when(F.abs(x) < 2.0**52, x)).cast("double"))


def trunc(x: Column) -> Column:
    small = F.when(F.abs(x) < 2.0**52, x)
    return _rounded(x, F.when(small < 0, F.ceil(small)).otherwise(F.floor(small)).cast("double"))


def round_half_away(x: Column) -> Column:
    return _rounded(x, F.round(F.when(F.abs(x) < 2.0**52, x), 0))


def is_inf(x: Column) -> Column:
    return F.abs(x) == _inf()


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < _inf())


def _extreme(made: Column, columns: tuple[Column, ...], double: bool) -> Column:
    require(len(columns) > 0, "no arguments")
    absent = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
    out = F.when(~absent, made)
    if double:
        out = F.when(~absent & reduce(lambda a, b: a | b, [F.isnan(c) for c in columns]), _nan()).otherwise(out)
    return out


def greatest(*columns: Column, double: bool = True) -> Column:
    """Absent if any is; NaN if any is."""
    return _extreme(F.greatest(*columns) if len(columns) > 1 else columns[0], columns, double)


def least(*columns: Column, double: bool = True) -> Column:
    return _extreme(F.least(*columns) if len(columns) > 1 else columns[0], columns, double)


# logic, dates, hashes


def choose(condition: Column, a: Column, b: Column) -> Column:
    """a ? b : c; an absent condition gives an absent value."""
    return F.when(condition, a).when(~condition, b)


def year(micros: Column) -> Column:
    return F.year(F.timestamp_micros(micros)).cast("long")


def month(micros: Column) -> Column:
    return F.month(F.timestamp_micros(micros)).cast("long")


def day(micros: Column) -> Column:
    return F.dayofmonth(F.timestamp_micros(micros)).cast("long")


#: Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    out = FNV_OFFSET
    for byte in data:
        out = (out ^ byte) * FNV_PRIME % 2**64
    return out


@F.pandas_udf(T.DecimalType(20, 0))
def _fnv64(values: pd.Series) -> pd.Series:
    known = {v: Decimal(fnv1a(v.encode() if isinstance(v, str) else v)) for v in values.dropna().unique()}
    return values.map(known.get).where(values.notna(), None)


def fnv64(key: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes, as decimal(20,0); an Arrow function, meant for ingest."""
    return _fnv64(key)
