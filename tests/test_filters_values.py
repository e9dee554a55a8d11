"""Three-valued filters and value expressions against plain Python, and refusals."""

import math
import time
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.errors import Refused, UnknownColumn
from sparkrank.functions import values as v
from sparkrank.functions.calendar import bucket_start
from sparkrank.functions.filters import Filters, micros_of, permitted
from sparkrank.schema import Kind, plan_schema

SCHEMA = "id long, s string, n long, x double, u decimal(20,0), m map<string,string>, c map<string,long>, p struct<lat: double, lon: double>"
ROWS = [
    (1, "a", 2**53 + 1, 1.5, Decimal(2**64 - 1), {"k": "v"}, {"k": 3}, (10.0, 20.0)),
    (2, "ab", -5, float("nan"), Decimal(0), {}, {}, (10.0, 21.0)),
    (3, None, None, None, None, None, None, None),
    (4, "é", 2, float("inf"), Decimal(7), {"k": "w"}, {"k": None}, (-90.0, 180.0)),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df, condition):
    return sorted(r.id for r in df.where(condition).collect())


def test_facets_and_unknowns(rows):
    f = Filters(rows, "docs")
    assert ids(rows, f.equals("s", "a")) == [1]
    assert ids(rows, f.differs("s", "a")) == [2, 4]  # the absent value stays unknown
    assert ids(rows, ~f.one_of("s", ["a", "ab"])) == [4]
    assert ids(rows, f.text("s", ">", "ab")) == [4]  # order of bytes
    assert ids(rows, f.starts_with("s", "a")) == [1, 2]
    assert ids(rows, f.has("s")) == [1, 2, 4] and ids(rows, ~f.has("s")) == [3]
    assert ids(rows, f.has_key("m", "k")) == [1, 4] and ids(rows, ~f.has_key("m", "k")) == [2, 3]
    assert ids(rows, f.entry("m", "k", "!=", "v")) == [4]
    assert ids(rows, f.entry("c", "k", ">=", 2.5)) == [1]


def test_exact_numbers(rows):
    f = Filters(rows)
    # a double would round 2**53 + 1 to 2**53
    assert ids(rows, f.number("n", "==", 2**53)) == [] and ids(rows, f.number("n", ">", 2**53)) == [1]
    assert ids(rows, f.number("n", "<", 2.5)) == [2, 4] and ids(rows, f.number("n", ">=", 2.5)) == [1]
    assert ids(rows, f.number("n", "==", 2.5)) == [] and ids(rows, f.number("n", "!=", 2.5)) == [1, 2, 4]
    assert ids(rows, f.number("n", "<", 2**70)) == [1, 2, 4]
    assert ids(rows, f.number("u", "==", 2**64 - 1)) == [1] and ids(rows, f.number("u", ">", 6.5)) == [1, 4]
    assert ids(rows, f.number("x", "!=", 1.5)) == [2, 4] and ids(rows, f.number("x", ">", 0)) == [1, 4]
    assert ids(rows, f.one_of("n", [2, -5])) == [2, 4]


def test_number_comparison_agrees_with_fractions(spark):
    numbers = [-(2**63), -1, 0, 1, 2**53, 2**53 + 1, 2**63 - 1]
    literals = [0, 0.5, -0.5, 2**53, 2**53 + 1, float(2**53), 2**63, -(2**63), 1e300, Decimal("0.1")]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "id long, n long")
    f = Filters(df)
    import operator

    ops = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
    made = [f.number("n", op, x).alias(f"r{i}") for i, (op, x) in enumerate(product(ops, literals))]
    for row, n in zip(sorted(df.select("id", *made).collect()), numbers):
        for i, (op, x) in enumerate(product(ops, literals)):
            assert row[f"r{i}"] == ops[op](Decimal(n), Decimal(x)), (n, op, x)


def test_kleene(spark):
    df = spark.createDataFrame([(a, b) for a, b in product([True, False, None], repeat=2)], "a boolean, b boolean")
    for r in df.select("a", "b", (F.col("a") & F.col("b")).alias("and_"), (F.col("a") | F.col("b")).alias("or_"), (~F.col("a")).alias("not_")).collect():
        low = lambda xs: False if False in xs else None if None in xs else True
        assert r.and_ == low([r.a, r.b]) and r.not_ == (None if r.a is None else not r.a)
        assert r.or_ == (True if True in (r.a, r.b) else None if None in (r.a, r.b) else False)


def test_places_and_times(rows, spark):
    f = Filters(rows)
    assert ids(rows, f.in_box("p", 10, 10, 20, 20.5)) == [1]
    assert ids(rows, f.within("p", 10.0, 20.0, 120_000)) == [1, 2] and ids(rows, f.within("p", 10.0, 20.0, 100_000)) == [1]
    assert ids(rows, ~f.within("p", 10.0, 20.0, 120_000)) == [4]
    assert ids(rows, f.within_manhattan("p", 10.0, 20.0, 110_000)) == [1, 2]
    assert micros_of("1970-01-01T00:00:01.0000019Z") == 1_000_001 and micros_of("1970-01-01T02:00:00+02:00") == 0


def test_refusals(rows):
    f = Filters(rows, "docs")
    with pytest.raises(UnknownColumn, match="docs has no column y"):
        f.equals("y", "a")
    for bad in (lambda: f.one_of("s", []), lambda: f.one_of("s", ["a", 1]), lambda: f.starts_with("s", ""), lambda: f.equals("n", "a"), lambda: f.number("n", "<", math.nan), lambda: f.number("n", "=", 1), lambda: f.in_box("p", 0, 1, 5, 4), lambda: f.within("p", 0, 0, -1), lambda: f.time("n", "<", "yesterday"), lambda: f.time("n", "<", "2020-01-01T00:00:00"), lambda: f.entry("m", "k", ">", 1)):
        with pytest.raises(Refused):
            bad()
    assert permitted(rows, {"n"}, {"id", "s"}, {"s": {"x"}}).columns == ["id"]
    own = Filters(rows, "docs", use={"n"})
    own.number("n", "<", 1)
    for bad in (lambda: own.equals("s", "a"), lambda: own.has("s"), lambda: own.within("p", 0, 0, 1)):
        with pytest.raises(Refused, match="may not use"):
            bad()


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_whole_numbers(spark):
    big, low = F.lit(2**63 - 1), F.lit(-(2**62)) * 2
    long = lambda x: F.lit(x).cast("long")
    assert one(spark, v.add(big, long(1))) is None and one(spark, v.multiply(big, long(2))) is None
    assert one(spark, v.divide(long(-7), long(2))) == -3 and one(spark, v.modulo(long(-7), long(2))) == -1
    assert one(spark, v.divide(long(1), long(0))) is None and one(spark, v.modulo(long(1), long(0))) is None
    assert one(spark, v.divide(low, long(-1))) is None and one(spark, v.negate(low)) is None and one(spark, v.absolute(low)) is None
    u = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    assert one(spark, v.unsigned("-", u(3), u(4))) is None and one(spark, v.unsigned("+", u(2**64 - 1), u(1))) is None
    assert one(spark, v.unsigned("/", u(2**64 - 1), u(2))) == 2**63 - 1 and one(spark, v.unsigned("%", u(7), u(0))) is None


def test_overflow_at_the_limits(spark):
    """Of each type, in columns that no one folds: what fits stays, though doubles cannot tell it from what does not."""
    root, edge = 3037000499, 2**63 - 1
    pairs = [(root, root), (root + 1, root + 1), (-(2**62), 2), (2**62, 2), (2**62, -2), (edge, 1), (edge, -1), (-edge - 1, 1), (-edge - 1, -1), (edge, 0), (None, 2), (2**62, None), (5, 7)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", v.multiply(F.col("a"), F.col("b")).alias("m"), v.add(F.col("a"), F.col("b")).alias("p"), v.subtract(F.col("a"), F.col("b")).alias("s")).collect()
    fits = lambda x: x if -(2**63) <= x < 2**63 else None
    for r in got:
        want = (None, None, None) if None in (r.a, r.b) else (fits(r.a * r.b), fits(r.a + r.b), fits(r.a - r.b))
        assert (r.m, r.p, r.s) == want, r
    i, x = F.lit(2**31 - 1), F.lit(1e300)
    assert one(spark, v.add(i, F.lit(1))) is None and one(spark, v.multiply(i, F.lit(1))) == 2**31 - 1 and one(spark, v.multiply(F.lit(2**16), F.lit(2**15))) is None
    assert one(spark, v.multiply(x, F.lit(2.0))) == 2e300 and one(spark, v.add(F.lit(Decimal(2**64)), F.lit(Decimal(1)))) == 2**64 + 1
    assert math.isnan(one(spark, v.multiply(F.lit(float("nan")), F.lit(2.0))))


def test_overflow_costs_no_more_than_a_product(spark):
    """An exception for each row took fifty times as long."""

    def seconds(factor):
        start = time.perf_counter()
        assert spark.range(2, 300_002, 1, 1).select(v.multiply(F.col("id"), F.lit(factor)).alias("m")).agg(F.count("m")).first()[0] == (300_000 if factor == 2 else 0)
        return time.perf_counter() - start

    seconds(2)
    assert seconds(2**62) < 5 * seconds(2) + 1


def test_doubles(spark):
    d = lambda x: F.lit(float(x))
    nan, inf = float("nan"), float("inf")
    assert one(spark, v.ieee_divide(d(1), d(0))) == inf and one(spark, v.ieee_divide(d(-1), d(0))) == -inf and math.isnan(one(spark, v.ieee_divide(d(0), d(0))))
    assert one(spark, v.ln(d(0))) == -inf and math.isnan(one(spark, v.ln(d(-1)))) and math.isnan(one(spark, v.log10(d(nan)))) and one(spark, v.log10(d(100))) == 2
    for op, want in (("==", False), ("!=", True), ("<", False), (">", False), (">=", False)):
        assert one(spark, v.ieee_compare(op, d(nan), d(nan))) is want
    assert [one(spark, v.round_half_away(d(x))) for x in (2.5, -2.5, 1e300)] == [3.0, -3.0, 1e300]
    assert [one(spark, v.trunc(d(x))) for x in (2.7, -2.7)] == [2.0, -2.0] and one(spark, v.ceil(d(-0.5))) == 0
    assert math.isnan(one(spark, v.greatest(d(1), d(nan)))) and one(spark, v.greatest(d(1), F.lit(None).cast("double"))) is None
    assert one(spark, v.double_sign(d(-0.0))) == 0 and one(spark, v.is_inf(d(-inf))) and not one(spark, v.is_finite(d(nan)))
    assert one(spark, v.choose(F.lit(None).cast("boolean"), d(1), d(2))) is None


def test_hash_and_calendar(spark):
    assert one(spark, v.fnv64(F.lit("a"))) == 0xAF63DC4C8601EC8C and one(spark, v.fnv64(F.lit(""))) == v.FNV_OFFSET
    assert one(spark, v.year(F.lit(-1).cast("long"))) == 1969 and one(spark, v.month(F.lit(0).cast("long"))) == 1
    monday = one(spark, bucket_start(F.lit(micros_of("2024-01-07T23:30:00Z")), "week", 60))
    assert monday == micros_of("2024-01-07T23:00:00Z")
    with pytest.raises(Refused):
        bucket_start(F.lit(0), "decade")


def test_schema_plan():
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.FloatType())), T.StructField("c", T.BinaryType())])
    plan, print_ = plan_schema(schema, {"a": Kind.TEXT})
    assert plan == {"a": Kind.TEXT, "b": Kind.VECTOR, "c": Kind.NONE} and print_ == plan_schema(schema, {"a": Kind.TEXT})[1] != plan_schema(schema)[1]
    with pytest.raises(Refused):
        plan_schema(schema, {"b": Kind.NUMERIC})
    with pytest.raises(UnknownColumn):
        plan_schema(schema, {"z": Kind.TEXT})
