"""Exact dedup by recipes of content-defined chunks.

A task cuts each normalised text where a rolling hash of the last 32 bytes says so, and keeps
of every chunk only its length and digests; the long texts themselves never move. Chunks are
deduplicated to identifiers: one per (64-bit hash, length, SHA-256), so two chunks share an
identifier only when the strong digest verifies that their bytes are equal. A document is then
the ordered list of its chunks' identifiers, and documents are equal when these lists are.

Null texts count as empty; all empty texts are equal. Of rows that tie in length and doc_id (a
repeated row) each carries the same keep_id, and `kept` is true for one of them only. A row
without doc_id takes part like any other and loses ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import join_hot, only, written
from sparkrank.llm.tokens import MIX, WHITESPACE, mix

#: A cut falls after a byte whose rolling hash ends in so many zero bits: chunks of 1 KB on average.
CUT_BITS = 10
#: A chunk without such a byte ends here.
MOST_BYTES = 16_384
#: A list of at most so many identifiers may go to every task, if very many documents share it: 25 MB for all that can be.
HOT_CHUNKS = 512

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX[0])).astype(np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data: content decides, so equal bytes around a place cut it alike."""
    n = len(data)
    if not n:
        return []
    rolling = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after these the hash covers 32 bytes
        shifted = rolling.copy()
        shifted[step:] += rolling[:-step] << np.uint32(step) if step < n else np.uint32(0)
        rolling = shifted
    ends = np.flatnonzero((rolling >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > MOST_BYTES:
            last += MOST_BYTES
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("digest", pa.binary())]))
    for batch in batches:
        digests, chunks = [], []
        for text in batch.column(2).to_pylist():
            data = text.translate(None, WHITESPACE)
            digests.append(hashlib.sha256(data).hexdigest())
            own, last = [], 0
            for end in cut_points(data):
                strong = hashlib.sha256(data[last:end]).digest()
                weak = int.from_bytes(hashlib.blake2b(data[last:end], digest_size=8).digest(), "little", signed=True)
                own.append({"hash": weak, "length": end - last, "digest": strong})
                last = end
            chunks.append(own)
        columns = [batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(chunks, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_sha256", "chunks"])


def chunk_recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size in code points, text_sha256 of the normalised text and its ordered chunks."""
    own = only(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )
    return own.mapInArrow(_recipes, "doc_id long, size long, text_sha256 string, chunks array<struct<hash: long, length: int, digest: binary>>")


def dedup_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and n_chunks.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. The row
    with the most code points in its original text stays, then the smallest doc_id.
    """
    row = ["doc_id", "size", "text_sha256"]
    # the one pass over the texts; all that follows reads the recipes
    rows = written(chunk_recipes(docs, doc_id, text).groupBy(*row).agg(F.count("*").alias("copies"), F.first("chunks").alias("chunks")), "recipes")
    chunks = rows.select(*row, "copies", F.posexplode_outer("chunks").alias("place", "chunk")).select(*row, "copies", "place", "chunk.*")
    # the digests under one (hash, length) tell apart chunks that merely clash; what stands in one
    # place only gets no identifier, and its document is like no other
    known = chunks.where("hash is not null").groupBy("hash", "length").agg(F.sum("copies").alias("uses"), F.count("*").alias("places"), F.sort_array(F.collect_set("digest")).alias("digests"))
    known = written(known.where("uses > 1"), "chunks")
    named = join_hot(chunks.where("hash is not null"), known, ["hash", "length"], "places").select(
        *row, "copies", "place", F.when(F.col("uses").isNotNull(), F.struct("hash", "length", F.array_position("digests", F.col("digest")).alias("variant"))).alias("chunk_id"), F.lit(True).alias("real")
    )
    # texts without chunks would meet under one null key
    named = named.union(chunks.where("hash is null").select(*row, "copies", "place", F.lit(None).cast(named.schema["chunk_id"].dataType), F.lit(False)))
    listed = named.groupBy(*row).agg(
        F.first("copies").alias("copies"), F.count_if("real").alias("n_chunks"), F.count("chunk_id").alias("n_named"), F.sort_array(F.collect_list(F.when(F.col("real"), F.struct("place", "chunk_id")))).alias("recipe")
    )
    # a recipe with an unnamed chunk is like no other: it gets a key of its own, so that these
    # rows, most of a corpus, spread evenly instead of meeting under one null key
    named_only = F.transform("recipe", lambda x: x["chunk_id"])
    alone = F.array(F.struct(F.xxhash64(*row).alias("hash"), F.lit(-1).alias("length"), F.lit(0).alias("variant")))
    unnamed = F.col("n_chunks") > F.col("n_named")
    listed = written(listed.select(*row, "copies", "n_chunks", unnamed.alias("unnamed"), F.when(unnamed, alone).otherwise(named_only).alias("recipe")), "lists")
    best = F.min(F.struct((-F.col("size")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "size"))
    groups = listed.where("not unnamed").groupBy("recipe").agg(F.sum("copies").alias("n"), F.count("*").alias("members"), best.alias("best")).where("members > 1")
    out = join_hot(listed, written(groups, "groups"), ["recipe"], "members", fits=F.size("recipe") <= HOT_CHUNKS).select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", "copies").alias("group_size"),
        (F.col("n").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.size") == F.col("size")))).alias("first"), "text_sha256", "n_chunks", "copies",
    )
    # repeated rows come back as often as they came
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks"
    )
