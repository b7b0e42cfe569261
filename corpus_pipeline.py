"""A corpus from raw documents to packed sequences: rules, exact and near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the
last return the columns of ``documents``. Exact and near dedup tell rows apart where ids are null or repeated: one row of a group stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, minhash, mixing, packing, quality_rules
from helixframe.llm.common import cut, forget_at_exit, shared_dir
from helixframe.llm.tokens import vocabulary_path
from helixframe.shipping import ship

KEY = "row_key"

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; documents that fail, or lose too much, go."""
    ship(spark)
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship(spark)
    rows = keyed(docs)
    gone = exact_dedup.dedup(rows, id_col=KEY).where("NOT kept").select(F.col("doc_id").alias(KEY))
    return without(rows, gone).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship(spark)
    rows = keyed(docs)
    gone = minhash.near_duplicates(rows, id_col=KEY).where("NOT kept").select(F.col("doc_id").alias(KEY))
    return without(rows, gone).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training positions: over files by number, then rows."""
    ship(spark)
    return mixing.mix(docs).drop("mix_position")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, which by ``place`` come in the order of training positions."""
    ship(spark)
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), in_order=True)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key of the row: the id where ids are whole and unique, else the row's place in order of id, null ids last."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id"))
    order = docs.sort(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return cut(order.withColumn(KEY, F.monotonically_increasing_id()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key isn't in ``gone``; the keys are the hashed side, so texts are dealt once and never sorted."""
    return docs.join(gone.distinct().hint("shuffle_hash"), KEY, "left_anti")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Word shingles with a similarity and learned vocabularies are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder, where it stays while the application runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    forget_at_exit(spark, at)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs.select(*[F.col(c) for c in docs.columns])
