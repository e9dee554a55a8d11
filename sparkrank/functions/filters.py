"""Three-valued filters on typed columns.

Each function returns a boolean Column that is null where a value is absent: SQL's logic, so
`&`, `|` and `~` combine them and where() admits what is true. Refusals happen when the filter is
built, before any plan runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.errors import Refused, UnknownColumn, require
from sparkrank.functions.geo import haversine, manhattan
from sparkrank.schema import Kind, kind_of

Number = int | float | Decimal
_WHOLE = (Kind.INTEGER, Kind.UNSIGNED, Kind.MAP_INTEGER)


class Filters:
    """Filters over one table, checked against its schema."""

    def __init__(self, df: DataFrame, table: str = "table", use: set[str] | None = None):
        """use: the columns that a reader may ask about, all if None; a filter on another one is refused."""
        self.use = use
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        self.table = table

    def _column(self, name: str, *kinds: Kind) -> Column:
        if name not in self.kinds:
            raise UnknownColumn(self.table, name)
        require(self.use is None or name in self.use, f"{name}, which this reader may not use")
        require(not kinds or self.kinds[name] in kinds, f"{name} is {self.kinds[name].value}")
        return F.col(f"`{name}`")

    # facets

    def equals(self, name: str, value: str) -> Column:
        return self._column(name, Kind.FACET) == F.lit(value)

    def differs(self, name: str, value: str) -> Column:
        """Not equal; an absent value stays unknown."""
        return ~self.equals(name, value)

    def one_of(self, name: str, values: Iterable) -> Column:
        values = list(values)
        require(len(values) > 0, "an empty list")
        require(len({isinstance(v, str) for v in values}) == 1, "a list of mixed types")
        if isinstance(values[0], str):
            return self._column(name, Kind.FACET).isin(values)
        out = self.number(name, "==", values[0])
        for v in values[1:]:
            out = out | self.number(name, "==", v)
        return out

    def text(self, name: str, op: str, value: str) -> Column:
        """Order of bytes: < <= > >= against a string."""
        return _compare(self._column(name, Kind.FACET), op, F.lit(value))

    def starts_with(self, name: str, prefix: str) -> Column:
        require(prefix != "", "an empty prefix")
        return self._column(name, Kind.FACET).startswith(prefix)

    # numbers

    def number(self, name: str, op: str, value: Number) -> Column:
        """Exact comparison of a number column with any literal, whatever their types."""
        c = self._column(name, Kind.NUMERIC, Kind.INTEGER, Kind.UNSIGNED)
        return exact_compare(c, self.kinds[name] in _WHOLE, op, value, 64 if self.kinds[name] is Kind.UNSIGNED else 63)

    def between(self, name: str, low: Number, high: Number) -> Column:
        return self.number(name, ">=", low) & self.number(name, "<=", high)

    def time(self, name: str, op: str, value: str) -> Column:
        """Against an RFC 3339 timestamp, cut to microseconds."""
        c, micros = self._column(name, Kind.TIMESTAMP, Kind.INTEGER), micros_of(value)
        if self.kinds[name] is Kind.INTEGER:
            return _compare(c, op, F.lit(micros))
        return _compare(c.cast("timestamp_ntz"), op, F.timestamp_micros(F.lit(micros)).cast("timestamp_ntz"))

    # maps

    def entry(self, name: str, key: str, op: str, value: Number | str) -> Column:
        c = F.try_element_at(self._column(name, Kind.MAP_FACET, Kind.MAP_NUMERIC, Kind.MAP_INTEGER), F.lit(key))
        if isinstance(value, str):
            require(self.kinds[name] is Kind.MAP_FACET, f"{name} holds numbers")
            return _compare(c, op, F.lit(value))
        require(self.kinds[name] is not Kind.MAP_FACET, f"{name} holds strings")
        return exact_compare(c, self.kinds[name] is Kind.MAP_INTEGER, op, value)

    def has_key(self, name: str, key: str) -> Column:
        """Total: an absent map has no keys."""
        c = self._column(name, Kind.MAP_FACET, Kind.MAP_NUMERIC, Kind.MAP_INTEGER)
        return F.coalesce(F.map_contains_key(c, key), F.lit(False))

    def has(self, name: str) -> Column:
        """Total: whether there is a value."""
        return self._column(name).isNotNull()

    # places

    def in_box(self, name: str, south: float, north: float, west: float, east: float) -> Column:
        require(west <= east, "a box over the date line")
        require(south <= north, "a box upside down")
        c = self._column(name, Kind.GEO)
        return c["lat"].between(south, north) & c["lon"].between(west, east)

    def within(self, name: str, lat: float, lon: float, metres: float) -> Column:
        c = self._column(name, Kind.GEO)
        return haversine(c["lat"], c["lon"], lat, lon) <= _finite(metres)

    def within_manhattan(self, name: str, lat: float, lon: float, metres: float) -> Column:
        c = self._column(name, Kind.GEO)
        return manhattan(c["lat"], c["lon"], lat, lon) <= _finite(metres)


def _finite(x: float) -> float:
    require(math.isfinite(x) and x >= 0, f"a distance of {x}")
    return x


def _compare(a: Column, op: str, b: Column) -> Column:
    made = {"==": lambda: a == b, "!=": lambda: ~(a == b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}
    require(op in made, f"operator {op}")
    return made[op]()


def exact_compare(c: Column, whole: bool, op: str, value: Number, bits: int = 63) -> Column:
    """Compare a whole-number or double column with a literal without rounding either.

    A literal that the column's type cannot hold is replaced by its neighbour in that type, and
    the operator by the one that asks the same question of the neighbour. bits: of the largest
    whole number; beyond it every present value gives one answer.
    """
    if isinstance(value, float) and not math.isfinite(value):
        raise Refused(f"the number {value}")
    exact = Decimal(value)
    near = Decimal(math.floor(exact)) if whole else Decimal(float(value))
    present = c.isNotNull()
    if not whole:
        # a NaN is no number: unequal to all, and in no order
        op, literal = _shifted(op, near, exact)
        return F.when(F.isnan(c), F.lit(op == "!=")).when(present, _compare(c, op, literal))
    if near >= 2**bits or near < -(2**63) or (near != exact and op in ("==", "!=")):
        _compare(c, op, F.lit(0))  # refuses an unknown operator
        return F.when(present, F.lit({"==": False, "!=": True}.get(op, (op[0] == "<") == (near > 0))))
    if near != exact:
        op, _ = _shifted(op, near, exact)
    return _compare(c, op, F.lit(int(near)) if bits == 63 else F.lit(near).cast("decimal(20,0)"))


def _shifted(op: str, near: Decimal, exact: Decimal) -> tuple[str, Column]:
    """The question about `exact` as one about `near`: x < e is x <= n where n < e, and so on."""
    if near < exact:
        op = {"<": "<=", ">=": ">"}.get(op, op)
    elif near > exact:
        op = {"<=": "<", ">": ">="}.get(op, op)
    return op, F.lit(float(near))


def micros_of(rfc3339: str) -> int:
    try:
        at = datetime.fromisoformat(rfc3339.replace("Z", "+00:00"))
    except ValueError:
        raise Refused(f"the timestamp {rfc3339}") from None
    require(at.tzinfo is not None, f"{rfc3339} without an offset")
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + at.microsecond


def visible(df: DataFrame, policy: Column) -> DataFrame:
    """Rows that a reader may see; every read goes through it, and statistics over it cover these rows."""
    return df.where(policy)


def permitted(df: DataFrame, use: set[str], disclose: set[str], inputs: dict[str, set[str]] | None = None) -> DataFrame:
    """The columns a reader may get. A derived column is disclosed only with all its inputs. What may be asked about is kept by Filters(use=...)."""
    inputs = inputs or {}
    for name in use | disclose:
        if name not in df.columns:
            raise UnknownColumn("table", name)
    kept = [n for n in df.columns if n in disclose and inputs.get(n, set()) <= disclose]
    return df.select(*[F.col(f"`{n}`") for n in kept])
