"""Folders and sizes that several operators need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made by this driver.
_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one job, in the place that the cluster shares.

    spark.checkpoint.dir names it; only where that is unset and the master is local, as in
    tests, a temporary folder of this machine is taken and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def folders() -> set[str]:
    """The folders made by this driver so far."""
    return set(_made)


def discard(spark: SparkSession, keep: set[str]) -> None:
    """Delete the folders made by this driver but those to keep: for when what was read from them is written elsewhere."""
    for path in [p for p in _made if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


#: Bytes that a task hands to Python at a time, where its rows hold texts. A batch lies in memory several times on its way.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in here hands rows to Python in batches of BATCH_BYTES, instead of 10,000 texts however long they are."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Keys with more than this part of all rows count as hot: fewer than so many can be.
HOT_PARTS = 2048


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, least: int = 1000, fits: Column | None = None) -> DataFrame:
    """left.join(right, keys, "left") that deals no key with many rows of left to one task.

    right, written down, has one row per key; its column weight counts the rows of left under it.
    The keys with over 1/HOT_PARTS of all rows, fewer than HOT_PARTS whatever the data's size, go
    to every task; fits says which rows are small enough for that. The others are shuffled.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > max(total / HOT_PARTS, least)
    is_hot = F.coalesce(is_hot if fits is None else is_hot & fits, F.lit(False))
    hot = right.where(is_hot)
    if hot.isEmpty():
        return left.join(right, keys, "left")
    hot, names = F.broadcast(hot), F.broadcast(hot.select(*keys))
    cold = left.join(names, keys, "left_anti").join(right.where(~is_hot), keys, "left")
    return left.join(hot, keys).unionByName(cold)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of UTF-8 in a text column, to size buckets by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def power_of_two(n: float, least: int, most: int) -> int:
    """The power of two at or above n, within bounds."""
    out = least
    while out < n and out < most:
        out *= 2
    return out


def only(frame: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names, so that no other column can clash."""
    return frame.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
