"""Changes of a folder from one listing to the next: new, changed, deleted and renamed files, each reported once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTING = "path string, hash string"
CHANGES = "change string, path string, old_path string, hash string"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, path, old_path, hash) between two listings (path, hash).

    A path with another hash is changed. Of the paths that came and those that went, those with one hash are renamed,
    pair by pair in order of path; what is left over is new or deleted. Paths that occur twice in a listing count
    once, with the smallest hash; a null hash equals no other.
    """
    once = lambda df, name: df.where("path IS NOT NULL").groupBy("path").agg(F.min("hash").alias(name))
    both = once(before, "was").withColumn("there", F.lit(1)).join(once(after, "now").withColumn("here", F.lit(1)), "path", "full")
    same = F.col("there").isNotNull() & F.col("here").isNotNull()
    changed = both.where(same & ~F.coalesce(F.col("was") == F.col("now"), F.lit(False))).select(F.lit("changed").alias("change"), "path", F.lit(None).cast("string").alias("old_path"), F.col("now").alias("hash"))
    # Null hashes are told apart by their paths.
    key = lambda c: F.coalesce(F.col(c), F.concat(F.lit("no hash: "), "path"))
    numbered = lambda df, c: df.select("path", key(c).alias("hash"), F.row_number().over(Window.partitionBy(key(c)).orderBy("path")).alias("k"))
    came = numbered(both.where("there IS NULL"), "now")
    went = numbered(both.where("here IS NULL"), "was").withColumnRenamed("path", "old_path")
    moved = came.join(went, ["hash", "k"], "full")
    kind = F.when(F.col("old_path").isNull(), "new").when(F.col("path").isNull(), "deleted").otherwise("renamed")
    told = moved.select(kind.alias("change"), F.coalesce("path", "old_path").alias("path"), F.when(kind == "renamed", F.col("old_path")).alias("old_path"), F.when(~F.col("hash").startswith("no hash: "), F.col("hash")).alias("hash"))
    return changed.unionByName(told)


def versions(spark: SparkSession, at: str) -> list[int]:
    """The numbers of the listings that are complete below ``at``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/listing-*/_SUCCESS")) or []
    return sorted(int(str(f.getPath().getParent().getName()).split("-")[1]) for f in found)


def report(listing: DataFrame, at: str) -> DataFrame:
    """The changes since the last listing kept below ``at``, which ``listing`` then replaces; a rerun with it gives none.

    Changes are written before the listing that makes them known, each under the number of the run: a run that stops
    between the two is made good by the next, under the same number. Two listings are kept.
    """
    spark = listing.sparkSession
    done = versions(spark, at)
    number = done[-1] + 1 if done else 0
    kept = spark.read.schema(LISTING).parquet(f"{at}/listing-{done[-1]}") if done else spark.createDataFrame([], LISTING)
    now = listing.select(F.col("path").cast("string").alias("path"), F.col("hash").cast("string").alias("hash"))
    found = f"{at}/changes-{number}"
    changes(kept, now).write.mode("overwrite").parquet(found)
    now.write.mode("overwrite").parquet(f"{at}/listing-{number}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for old in done[:-1]:
        path = hadoop(f"{at}/listing-{old}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(CHANGES).parquet(found)


def follow(listings: DataFrame, at: str, checkpoint: str) -> None:
    """Report each listing of a stream (at most one a micro-batch) of (path, hash); a rerun goes on where the last one stopped."""
    listings.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else (report(batch, at), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
