"""Where data comes from and goes to: corpora, postings, vectors, logs and rule files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.errors import require
from sparkrank.functions.analysis import INGEST, Analysis
from sparkrank.operators.lexical import counted_field_stats, parse_synonyms, postings, term_stats


def write_index(docs: DataFrame, path: str, text: str = "text", analysis: Analysis = INGEST, buckets: int = 64) -> None:
    """Postings in `buckets` folders by their term's hash, sorted by term, and the statistics.

    A query reads the folders of its terms, and in them the row groups that hold these: the
    filter on the partition column prunes files, the one on term prunes row groups.
    """
    posted = postings(docs, text, analysis=analysis).withColumn("bucket", term_bucket(F.col("term"), buckets))
    # the field is the same in every row and needs not cross the network
    dealt = posted.drop("field").repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc_id")
    dealt.select(F.lit("body").alias("field"), *dealt.columns).write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = docs.sparkSession
    term_stats(spark.read.schema(posted.schema).parquet(f"{path}/postings")).write.parquet(f"{path}/term_stats")
    counted_field_stats(docs, spark.read.parquet(f"{path}/term_stats")).write.parquet(f"{path}/field_stats")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """The postings of some terms, from their folders alone."""
    known = spark.createDataFrame([(t,) for t in terms], "term string").select(term_bucket(F.col("term"), buckets).alias("b")).distinct().collect()
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r["b"] for r in known]) & F.col("term").isin(terms))


def write_vectors(vectors: DataFrame, path: str, vec_id: str = "vec_id", vector: str = "embedding", dims: int | None = None) -> None:
    """Append rows of 32-bit vectors; one of another length fails the write."""
    own = vectors.select(vec_id, F.col(vector).cast("array<float>").alias(vector))
    if dims:
        own = own.withColumn(vector, F.when(F.size(vector) == dims, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector that has not {dims} values")).cast("array<float>")))
    own.write.mode("append").parquet(path)


def read_vector_file(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of flat files: two little-endian 32-bit integers, count and dimension, then the values row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                count, dim = struct.unpack_from("<ii", content)
                values = np.frombuffer(content, dtype="<f4", offset=8, count=count * dim).reshape(count, dim)
                for i in range(0, count, 4096):
                    yield pd.DataFrame({"row": np.arange(i, min(i + 4096, count)), "embedding": list(values[i : i + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, embedding array<float>")


def read_glossary(spark: SparkSession, path: str) -> dict[str, str]:
    """id and surface form per line, tab between; at most 100,000 of them, as they travel with the query."""
    rows = spark.read.csv(path, sep="\t", schema="id string, surface string").where("surface is not null").limit(100_001).collect()
    require(len(rows) <= 100_000, "more than 100,000 concepts")
    return {r["id"]: r["surface"] for r in rows}


def read_synonyms(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).limit(100_001).collect()
    require(len(rows) <= 100_000, "more than 100,000 rules")
    return parse_synonyms(r["value"] for r in rows)


def append_log(rows: DataFrame, path: str) -> None:
    """Append records to a log folder; readers see whole files only."""
    rows.write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str) -> str:
    """Write an image of a table that can be read back elsewhere."""
    require(PurePath(path).name != "", "a snapshot needs a path")
    df.write.mode("error").parquet(path)
    return path
