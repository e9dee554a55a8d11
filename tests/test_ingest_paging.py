import pytest
from pyspark.sql import functions as F

from sparkrank.errors import Refused, UnknownColumn
from sparkrank.operators.paging import decode_cursor, encode_cursor, measured_depth, unique_ids
from sparkrank.schema import Kind
from sparkrank.sources.ingest import Derived, derive, map_records, replace_documents, write_routed


def test_map_and_derive(spark):
    raw = spark.sql("select struct('a' as name, 2 as n, timestamp '1970-01-01 00:00:01' as at) as meta, named_struct('lat', 1.0D, 'lon', 2.0D) as p, 1.5D as x")
    plan = {"name": ("meta.name", Kind.FACET), "n": ("meta.n", Kind.INTEGER), "at": ("meta.at", Kind.TIMESTAMP), "p": ("p", Kind.GEO), "x": ("x", Kind.NUMERIC)}
    (row,) = map_records(raw, plan).collect()
    assert (row.name, row.n, row["at"], row.p.lat, row.x) == ("a", 2, 1_000_000, 1.0, 1.5)
    with pytest.raises(Exception, match="no place"):
        map_records(raw.withColumn("p", F.struct(F.lit(91.0).alias("lat"), F.lit(0.0).alias("lon"))), plan).collect()
    out, print_ = derive(map_records(raw, plan), {"twice": Derived(F.col("n") * 2, Kind.INTEGER, frozenset({"n"}))})
    assert out.first().twice == 4 and len(print_) == 64
    for bad, error in ((Derived(F.col("n") * 2, Kind.NUMERIC, frozenset({"n"})), Refused), (Derived(F.col("n"), Kind.INTEGER, frozenset({"z"})), UnknownColumn)):
        with pytest.raises(error):
            derive(map_records(raw, plan), {"d": bad})


def test_routing_and_replacement(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    write_routed(df, "k", 4, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    got = replace_documents(df, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_cursors():
    c = encode_cursor(b"s", "q", 0.1, 7, ["x"])
    score, doc, keys = decode_cursor(b"s", "q", c)
    assert (round(score, 6), doc, keys) == (0.1, 7, ["x"])
    for secret, request, cursor in ((b"t", "q", c), (b"s", "r", c), (b"s", "q", c[:-4] + "AAAA"), (b"s", "q", "?")):
        with pytest.raises(Refused):
            decode_cursor(secret, request, cursor)
    with pytest.raises(Refused):
        unique_ids(["a", "a"])
    profile = {(10, 0.9): 50, (10, 0.99): 200, (100, 0.9): 400}
    assert measured_depth(profile, 10, 0.95) == 200 and measured_depth(profile, 50, 0.9) == 400
    with pytest.raises(Refused):
        measured_depth(profile, 100, 0.99)
