"""Which rows, in which order: boolean trees, sorting, paging, collapsing, projection, replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.errors import Refused, require
from sparkrank.operators.lexical import ranking

#: Most rows of an answer, and the depth of a tree.
MAX_K, MAX_DEPTH = 10_000, 64


@dataclass(frozen=True)
class Clause:
    """A leaf: a condition, which an unknown value does not meet, and an optional score."""

    condition: Column
    score: Column | None = None


@dataclass(frozen=True)
class Bool:
    """must, should and must_not over leaves and trees; must_not takes away what is true and nothing else."""

    must: Sequence = field(default=())
    should: Sequence = field(default=())
    must_not: Sequence = field(default=())
    minimum_should_match: int = 0


def boolean(node: Clause | Bool, depth: int = 0) -> tuple[Column, Column]:
    """Membership (never null) and score - the sum over positive clauses that match - of a tree, as expressions of one row."""
    require(depth <= MAX_DEPTH, "a tree too deep")
    zero = F.lit(0.0)
    if isinstance(node, Clause):
        member = F.coalesce(node.condition, F.lit(False))
        return member, F.when(member, F.coalesce(node.score, zero) if node.score is not None else zero).otherwise(zero)
    require(bool(node.must or node.should or node.must_not), "an empty tree")
    least = node.minimum_should_match or (1 if node.should and not node.must else 0)
    require(least <= len(node.should), f"{least} of {len(node.should)} clauses")
    must, should, must_not = ([boolean(x, depth + 1) for x in xs] for xs in (node.must, node.should, node.must_not))
    member = reduce(lambda a, b: a & b, [m for m, _ in must], F.lit(True))
    if least:
        member = member & (reduce(lambda a, b: a + b, [m.cast("int") for m, _ in should]) >= least)
    member = reduce(lambda a, b: a & ~b, [m for m, _ in must_not], member)
    score = reduce(lambda a, b: a + b, [s for _, s in [*must, *should]], zero)
    return member, F.when(member, score).otherwise(zero)  # a tree that is left out brings no score


def searched(df: DataFrame, searches: Mapping[str, DataFrame], doc_id: str = "doc_id") -> DataFrame:
    """df with a column for each search (doc_id, score): its score, null where it found nothing. Make leaves of them by found()."""
    for name, scored in searches.items():
        df = df.join(scored.select(F.col("doc_id").alias(doc_id), F.col("score").alias(name)), doc_id, "left")
    return df


def found(name: str) -> Clause:
    """A leaf: what a search of searched() found, with its score."""
    return Clause(F.col(name).isNotNull(), F.col(name))


def select(df: DataFrame, tree: Clause | Bool) -> DataFrame:
    """The rows of a tree with their score."""
    member, score = boolean(tree)
    return df.where(member).withColumn("score", score)


def limited(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    require(1 <= k <= MAX_K, f"k of {k}")
    return df.orderBy(*order).limit(k)


def browse(df: DataFrame, condition: Column, k: int, doc_id: str = "doc_id") -> DataFrame:
    """A filter alone, by doc_id."""
    return limited(df.where(condition), k, doc_id)


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], k: int, doc_id: str = "doc_id") -> DataFrame:
    """By several keys (name, ascending), then doc_id. A row without one of the keys is no row of the answer."""
    present = df.dropna(subset=[name for name, _ in keys])
    return limited(present, k, *[F.col(n).asc() if up else F.col(n).desc() for n, up in keys], F.col(doc_id).asc())


def search_after(scored: DataFrame, score: float, doc_id: int, k: int, id_column: str = "doc_id") -> DataFrame:
    """The page after a row, given by its 32-bit score and id. A row that is not there any more is refused."""
    wire = F.col("score").cast("float") + F.lit(0.0).cast("float")
    at = F.lit(score).cast("float")
    if scored.where((wire == at) & (F.col(id_column) == doc_id)).limit(1).count() == 0:
        raise Refused("the page's last row is not in the result")
    return limited(scored.where((wire < at) | ((wire == at) & (F.col(id_column) > doc_id))), k, *ranking("score", id_column))


def sorted_after(df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence, k: int, doc_id: str = "doc_id") -> DataFrame:
    """The page of sort_rows after the row with these key values and, last, this id. A row that is not there any more is refused."""
    order = [*keys, (doc_id, True)]
    there = reduce(lambda a, b: a & b, [F.col(name) == F.lit(value) for (name, _), value in zip(order, last, strict=True)])
    if df.where(there).limit(1).count() == 0:
        raise Refused("the page's last row is not in the result")
    after, same = F.lit(False), F.lit(True)
    for (name, up), value in zip(order, last, strict=True):
        c, v = F.col(name), F.lit(value)
        after = after | (same & ((c > v) if up else (c < v)))
        same = same & (c == v)
    return sort_rows(df.where(after), keys, k, doc_id)


def collapse(scored: DataFrame, key: str, k: int, inner_hits: int = 1, doc_id: str = "doc_id") -> DataFrame:
    """The best row of each key, with pool_hits and its inner_hits best rows; rows without a key are dropped.

    The first rows of a key come from a bounded rank per key, which a partial filter applies in
    each task before the shuffle.
    """
    pool = scored.where(F.col(key).isNotNull())
    place = Window.partitionBy(key).orderBy(*ranking("score", doc_id))
    best = pool.withColumn("place", F.row_number().over(place)).where(F.col("place") <= inner_hits)
    inner = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", doc_id, "score"))).alias("hits"))
    counted = pool.groupBy(key).agg(F.count("*").alias("pool_hits"))
    first = inner.select(key, F.col("hits")[0][doc_id].alias(doc_id), F.col("hits")[0]["score"].alias("score"), F.transform("hits", lambda h: h[doc_id]).alias("inner_hits"))
    return limited(first.join(counted, key), k, *ranking("score", doc_id))


def project(hits: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Named values of each hit, after selection."""
    return hits.select("*", *[v.alias(n) for n, v in values.items()])


def fetch(docs: DataFrame, ids: DataFrame, columns: Sequence[str], doc_id: str = "doc_id") -> DataFrame:
    """Stored values of a bounded list of ids; each id once."""
    wanted = ids.select(doc_id).distinct()
    return docs.join(F.broadcast(wanted) if ids.isLocal() else wanted, doc_id, "left_semi").select(doc_id, *columns)


# mutations and lineage


def without_deleted(df: DataFrame, deleted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that no tombstone names."""
    return df.join(deleted.select(doc_id).distinct(), doc_id, "left_anti")


def latest(df: DataFrame, key: str, version: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key. The largest (version, tie) comes from a partial aggregate, so no key is sorted in one task."""
    fields = [c for c in df.columns if c not in (key, version, tie)]
    best = df.groupBy(key).agg(F.max(F.struct(version, *([tie] if tie else []), *fields)).alias("best"))
    return best.select(key, "best.*").select(*df.columns)


def parents(chunks: DataFrame, lineage: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Chunks with parent and group, null where there is none."""
    return chunks.join(lineage, doc_id, "left")
