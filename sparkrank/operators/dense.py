"""Dense retrieval by inner product, exact unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.errors import require
from sparkrank.operators.lexical import ranking


def dot(vector: Column, query: Sequence[float], single: bool = False) -> Column:
    """Inner product in row order, as doubles or rounded to 32 bits after each step. No Python per row."""
    kind = "float" if single else "double"
    zero = F.lit(0.0).cast(kind)
    terms = F.zip_with(vector, F.lit([float(x) for x in query]), lambda a, b: a.cast(kind) * b.cast(kind))
    return F.aggregate(terms, zero, lambda acc, x: acc + x)


def scores(vectors: DataFrame, query: Sequence[float], vec_id: str = "vec_id", vector: str = "embedding", single: bool = False) -> DataFrame:
    """Every row with its score. Filters go before: a filtered search scores the rows that pass, never fewer hits."""
    return vectors.where(F.col(f"`{vector}`").isNotNull()).withColumn("score", dot(F.col(f"`{vector}`"), query, single)).drop(vector)


def dense_top_k(vectors: DataFrame, query: Sequence[float], k: int, min_score: float | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    require(1 <= k <= 10_000, f"k of {k}")
    own = scores(vectors, query, vec_id, vector)
    if min_score is not None:
        own = own.where(F.col("score") >= min_score)
    return own.orderBy(*ranking("score", vec_id)).limit(k)


def batch_top_k(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score): a stated set of queries against all rows, in one pass.

    A task multiplies blocks of rows with all queries and passes on its own best k of each, so
    at most tasks x queries x k rows are shuffled.
    """
    require(len(queries) * len(queries[0][1]) <= 4_000_000, "more queries than travel to the tasks at once")
    ids, matrix = np.array([q[0] for q in queries], dtype=np.int64), np.array([q[1] for q in queries], dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        for batch in batches:
            product = np.stack(batch["vector"].to_numpy()).astype(np.float64) @ matrix.T
            take = min(k, len(batch))
            # ties at the edge all go on; ids decide between them below
            edge = -np.partition(-product, take - 1, axis=0)[take - 1]
            row, query = np.nonzero(product >= edge)
            found = pd.DataFrame({"query_id": ids[query], "id": batch["id"].to_numpy()[row], "score": product[row, query]})
            best = pd.concat([best, found]).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield best

    own = vectors.where(F.col(f"`{vector}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    found = own.mapInPandas(run, "query_id long, id long, score double")
    place = Window.partitionBy("query_id").orderBy(*ranking("score", "id"))
    return found.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k).withColumnRenamed("id", vec_id)


#: Queries and rows that meet in one step of block_top_k, about.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", cells: tuple[Column, Column] | None = None) -> DataFrame:
    """As batch_top_k for any number of queries: blocks of queries meet blocks of rows, and of each meeting only the best k of a query go on.

    Neither the queries nor the rows pass through the driver. cells: the cell of a row and the
    list of cells that a query probes, as expressions; only rows of these cells are compared.
    """
    where = (F.explode(cells[1]), cells[0]) if cells else (F.lit(0), F.lit(0))
    own = [df.where(F.col(f"`{vector}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"), c.alias("cell")) for df, c in zip((queries, vectors), where, strict=True)]
    counts = [-(-df.count() // size) for df, size in zip(own, (QUERY_BLOCK, ROW_BLOCK), strict=True)]

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        listed = df.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).cast("int").alias(f"{name}_block"))
        return listed.agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("vector")).alias(f"{name}_values"))

    q, r = packed(own[0], counts[0], "query"), packed(own[1], counts[1], "row")
    meetings = r.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(max(counts[0], 1) - 1)))).join(q, ["cell", "query_block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch.itertuples(index=False):
                rows, asked = np.asarray(m.row_ids), np.asarray(m.query_ids)
                product = np.asarray(m.row_values, dtype=np.float64).reshape(len(rows), -1) @ np.asarray(m.query_values, dtype=np.float64).reshape(len(asked), -1).T
                take = min(k, len(rows))
                edge = -np.partition(-product, take - 1, axis=0)[take - 1]
                row, query = np.nonzero(product >= edge)  # ties at the edge go on, ids decide later
                yield pd.DataFrame({"query_id": asked[query], "id": rows[row], "score": product[row, query]})

    found = meetings.mapInPandas(run, "query_id long, id long, score double")
    place = Window.partitionBy("query_id").orderBy(*ranking("score", "id"))
    return found.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k).withColumnRenamed("id", vec_id)


def best_of_parent(scored: DataFrame, parent: str, k: int, vec_id: str = "vec_id") -> DataFrame:
    """The best row of each parent, and of these the first k. The best comes from a partial aggregate, so a parent with most rows is no burden."""
    best = scored.groupBy(parent).agg(F.max(F.struct((F.col("score").cast("float") + F.lit(0.0).cast("float")).alias("wire"), (-F.col(vec_id)).alias("negated"), "score")).alias("best"))
    return best.select(parent, (-F.col("best.negated")).alias(vec_id), F.col("best.score").alias("score")).orderBy(*ranking("score", vec_id)).limit(k)


def rerank(pool: DataFrame, vectors: DataFrame, query: Sequence[float], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Replace a fixed pool's scores by full-precision ones, reading the pool's rows only."""
    exact = vectors.join(pool.select(vec_id), vec_id, "left_semi")
    return scores(exact, query, vec_id, vector, single=True).select(vec_id, "score").orderBy(*ranking("score", vec_id))


def prefix_shortlist(vectors: DataFrame, query: Sequence[float], dims: int, pool: int, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nested embeddings: a shortlist by the first `dims` values, ranked by all of them."""
    require(1 <= dims <= len(query) and k <= pool <= 10_000, "dims within the vector and k within the pool")
    short = vectors.withColumn("score", dot(F.slice(vector, 1, dims), list(query)[:dims])).orderBy(*ranking("score", vec_id)).limit(pool)
    return scores(short.drop("score"), query, vec_id, vector).orderBy(*ranking("score", vec_id)).limit(k)


def quantise(vector: Column) -> Column:
    """Signed 8-bit codes and their scale: struct(scale, codes)."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(largest > 0, largest / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: F.round(x / scale).cast("tinyint")).alias("codes"))


def quantised_top_k(vectors: DataFrame, query: Sequence[float], k: int, pool: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A pool by 8-bit codes, its order by full precision."""
    coded = vectors.withColumn("code", quantise(F.col(vector)))
    coded = coded.withColumn("score", F.col("code.scale") * dot(F.col("code.codes"), query)).orderBy(*ranking("score", vec_id)).limit(pool)
    return scores(coded.drop("score", "code"), query, vec_id, vector).orderBy(*ranking("score", vec_id)).limit(k)


def train_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """Centroids of a partition, from at most `sample` rows with the least hashes of their ids; every row is assigned later."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vec_id), vec_id).limit(sample).select(vector).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * cells < 10**7 else np.array([((v - centres) ** 2).sum(axis=1).argmin() for v in x])
        for c in range(cells):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres.tolist()


def nearest_cells(vector: Column, centres: Sequence[Sequence[float]], n: int = 1) -> Column:
    """Numbers of the n nearest centroids, nearest first."""
    far = F.array(*[F.struct(F.aggregate(F.zip_with(vector, F.lit(list(c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.transform(F.slice(F.array_sort(far), 1, n), lambda s: s["i"])


def probe_top_k(celled: DataFrame, centres: Sequence[Sequence[float]], query: Sequence[float], k: int, probes: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate: only rows of the cells whose centroids score best. celled has a column cell, best a partition column of the table."""
    order = np.argsort(-(np.array(centres) @ np.array(query)))[:probes]
    return dense_top_k(celled.where(F.col("cell").isin([int(c) for c in order])).drop("cell"), query, k, vec_id=vec_id, vector=vector)
