"""A training-data pipeline of five stages over ``documents``; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import documents, id_and_text, saved
from girder.llm.jaccard import grouped
from girder.llm.mixing import mix_documents
from girder.llm.packing import pack_documents
from girder.llm.private import redact
from girder.llm.quality import Selection
from girder.llm.tokenizing import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones takes."""
    return Selection(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at a similarity of 0.8.

    Rows count, not ids: of a group stays the row with the smallest id, null ids last, then the smallest hash of its
    text; of several rows with that id and text the least by all columns. Rows without words all stay.
    """
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("__row")
    rows = grouped(id_and_text(docs).select("*", key)).where("group IS NOT NULL")
    copies = saved(rows.groupBy("group", "doc_id", "__row").agg(F.count("*").alias("times")), "copies")
    first = copies.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__row") == F.col("first.__row"))
    # Rows that go, and rows that stay but are repeated; all others stay as they are.
    odd = saved(copies.join(first, "group").select(F.col("doc_id").alias("__id"), F.col("__row").alias("__odd"), "times", stays.alias("__stays")).where("NOT __stays OR times > 1").drop("times"), "odd")
    keyed = docs.select("*", key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__odd"))
    told = keyed.join(odd, same, "left")  # both branches below read the one exchange of the texts
    single = told.where("__stays IS NULL").select(*docs.columns)
    least = told.where("__stays").groupBy("doc_id", "__row").agg(F.min(F.struct(*docs.columns)).alias("least")).select("least.*")
    return single.unionByName(least)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_documents(docs, [3, 1, 2])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the resampling nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
