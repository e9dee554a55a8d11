"""The corpus pipeline: five stages over documents, each an operator of sparkrank.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to
the shared folder and reads it again as the next one's docs, so a lost executor costs a stage's
tasks and never the stages before. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.decontaminate import find_contamination
from sparkrank.llm.exact_dedup import dedup_exact
from sparkrank.llm.mixing import mix_sources
from sparkrank.llm.near_dedup import near_classes
from sparkrank.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, domain_of, table
from sparkrank.llm.shared import discard, folders, shared_folder, written
from sparkrank.llm.toxicity import fit, score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected from this score on.
TOXIC = 0.5
#: Ids of dropped documents that may travel to every task: 8 bytes each, some 32 MB as a hash table.
BROADCAST_IDS = 1_000_000


def _digest(*columns: str) -> Column:
    """128 bits that tell apart the values of columns; null is told from empty in all but the text, for no stage reads them apart there."""
    parts = [F.sha2(F.coalesce(F.col(c), F.lit("")) if c == "text" else F.col(c).cast("string"), 256) for c in columns]
    whole = parts[0] if len(parts) == 1 else F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
    return F.unhex(F.substring(whole, 1, 32))


def _small(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Marked to go to every task, if it is no longer than most rows. rows is written down, so that counting it is cheap."""
    return F.broadcast(rows) if rows.count() <= most else rows


def with_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a column row, and the values of row that repeat. Rows share a value if and only if doc_id and text are equal.

    It is the doc_id; but the second and further texts under one doc_id, and texts without a
    doc_id, get numbers above all doc_ids, in the order of doc_id and digest. If these leave no
    room above, all texts are numbered anew in that order.
    """
    texts = written(docs.select("doc_id", _digest("text").alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n")), "keys")
    clash = texts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("texts"), F.min("key").alias("own")).where("texts > 1")
    further = texts.where("doc_id is not null").join(clash, "doc_id").where("key != own").select("doc_id", "key")
    odd = written(texts.where("doc_id is null").select("doc_id", "key").union(further), "odd")
    if odd.isEmpty():
        repeated = texts.where("n > 1").select(F.col("doc_id").alias("row"))
        return docs.withColumn("row", F.col("doc_id")), written(repeated, "repeated")
    top = texts.agg(F.max("doc_id")).first()[0]
    start = 0 if top is None else top + 1
    if start > 1 << 62:
        odd, start = texts, 0
    number = (F.lit(start).cast("long") + F.monotonically_increasing_id()).alias("number")
    odd = written(odd.orderBy(F.asc_nulls_last("doc_id"), "key").select(F.col("doc_id").alias("odd_id"), F.col("key").alias("odd_key"), number), "numbers")
    small = _small(odd, BROADCAST_IDS // 4)  # a row here is four times as long

    def named(frame: DataFrame) -> DataFrame:
        at = frame["doc_id"].eqNullSafe(small["odd_id"]) & (frame["key"] == small["odd_key"])
        return frame.join(small, at, "left").withColumn("row", F.coalesce("number", "doc_id"))

    repeated = written(named(texts.where("n > 1")).select("row"), "repeated")
    return named(docs.withColumn("key", _digest("text"))).select(*COLUMNS, "row"), repeated


def once(docs: DataFrame, name: str, repeated: DataFrame) -> DataFrame:
    """docs with the first row of each value of name in repeated, and all others. The first comes from a partial aggregate."""
    if repeated.isEmpty():
        return docs
    small = _small(repeated)
    first = docs.join(small, name, "left_semi").groupBy(name).agg(F.min(F.struct(*COLUMNS)).alias("first"))
    return docs.join(small, name, "left_anti").select(*COLUMNS, name).union(first.select("first.*", name))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose value of row is not among rows (in its column doc_id).

    The values are written down and counted; up to BROADCAST_IDS of them go to every task, so that
    no text moves. Beyond that the join deals both sides by row.
    """
    rows = written(rows.select(F.col("doc_id").alias("row")).distinct(), "dropped")
    return docs.join(_small(rows), "row", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the model of toxic spans, fitted on the labelled ones, scores below TOXIC."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    docs, _ = with_rows(docs)
    scored = score_documents(docs, model, doc_id="row")
    return without(docs, scored.where(F.col("score") >= TOXIC)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, repeated rows included."""
    docs, repeated = with_rows(docs)
    judged = dedup_exact(docs, doc_id="row").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return once(without(docs, judged.where("not kept")), "row", repeated).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near duplicates, repeated rows included."""
    docs, repeated = with_rows(docs)
    return once(without(docs, near_classes(docs, doc_id="row").where("not kept")), "row", repeated).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    docs, _ = with_rows(docs)
    return without(docs, find_contamination(docs, table(spark, sf_dir, "benchmark"), doc_id="row")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents to the target weights: one row per document and epoch, with its text.

    A row is drawn under its doc_id, and one that shares its doc_id or has none under a digest of
    all its columns too; equal rows are drawn as often as they are chosen.
    """
    keys = written(docs.select("doc_id", _digest("text", "lang", "source", "n_chars").alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n")), "keys")
    shared = written(keys.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("shared")), "shared")
    name = "doc_id"
    rows = docs
    if not (shared.isEmpty() and keys.where("doc_id is null").isEmpty()):
        name = "row"
        small = _small(shared)
        label = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex("key"))

        def named(frame: DataFrame) -> DataFrame:
            # rows without a doc_id would meet in one task of the join
            known = frame.where("doc_id is not null").join(small, "doc_id", "left").withColumn("row", F.when(F.col("shared"), label).otherwise(F.col("doc_id").cast("string")))
            return known.drop("shared").unionByName(frame.where("doc_id is null").withColumn("row", label))

        docs = named(docs.withColumn("key", _digest("text", "lang", "source", "n_chars"))).select(*COLUMNS, "row")
        rows = once(docs, "row", written(named(keys.where("n > 1")).select("row"), "repeated"))
    chosen = mix_sources(docs, domain_of(), MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED, doc_id=name)
    return rows.join(chosen.select(F.col("doc_id").alias(name), "domain", "n_tokens", "epoch"), name).select(*COLUMNS, "domain", "n_tokens", "epoch")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix)]

#: SQL cannot express the first and the third stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), folders()
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, keep=others | {path})  # the stage before, and what this one wrote on its way
        docs = spark.read.parquet(path)
    return docs
