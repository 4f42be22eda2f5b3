"""Stored tables that are kept up to date: chunks by document, facts by key, and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def rewrite(kept: DataFrame, path: str) -> None:
    """Overwrite only the partitions that ``kept`` has. It must not be read lazily from the files that go, so it is written aside first."""
    spark = kept.sparkSession
    aside = path.rstrip("/") + ".new"
    kept.write.mode("overwrite").partitionBy("project", "bucket").parquet(aside)
    fresh = spark.read.schema(kept.schema).parquet(aside)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "bucket").parquet(path)


def replace_chunks(chunks: DataFrame, path: str, buckets: int = 16) -> None:
    """Put the chunks of documents in place of those that the table has of them; NUL characters go.

    Tables are partitioned by project and a bucket of the document; only the partitions of changed documents are read and
    written.
    """
    spark = chunks.sparkSession
    clean = chunks.withColumn("text", F.translate("text", "\0", "")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    old = stored(spark, path)
    if old is None:
        clean.write.partitionBy("project", "bucket").parquet(path)
        return
    touched = clean.select("project", "bucket").distinct()
    keys = clean.select("project", "doc_id").distinct()
    same = old.join(touched, ["project", "bucket"], "left_semi").join(keys, ["project", "doc_id"], "left_anti")
    rewrite(same.select(*clean.columns).unionByName(clean), path)


def delete_documents(keys: DataFrame, path: str) -> None:
    """Remove the chunks of the documents (project, doc_id) from the table.

    What stays is written aside and then in place of the table.
    """
    spark = keys.sparkSession
    old = stored(spark, path)
    if old is None:
        return
    aside = path.rstrip("/") + ".kept"
    old.join(keys.select("project", "doc_id").distinct(), ["project", "doc_id"], "left_anti").select(*old.columns).write.mode("overwrite").partitionBy("project", "bucket").parquet(aside)
    spark.read.schema(old.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("project", "bucket").parquet(path)


def insert_absent(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table has not; of several with the same keys the first by all columns."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*rows.columns))
    new = rows.withColumn("__k", first).where("__k = 1").drop("__k")
    old = stored(rows.sparkSession, path)
    (new if old is None else new.join(old.select(*keys), keys, "left_anti").select(*rows.columns)).write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_tail(spark: SparkSession, path: str, schema: str, order: str, last: int, keep: Column | None = None) -> DataFrame:
    """The ``last`` lines of a log by ``order``, after ``keep``; lines that are no JSON of this kind are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")
    return (rows if keep is None else rows.where(keep)).orderBy(F.desc(order)).limit(last)
