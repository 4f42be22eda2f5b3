"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source; targets follow from the weights, with no source above a multiple of its size;
each document is then taken floor(rate) times and once more with probability equal to the fraction of its
source's rate, by a hash of its identifier and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    Sources, by code point and null last, weigh ``weights`` in turn. All targets together are ``share`` of
    all sizes; none is above ``most`` times its source's size, and what is cut off there goes to the others
    by weight. In order of most * size / weight, a source is cut off exactly if filling all sources to its
    level needs no more than is to be shared, so a running sum finds the level; no loop is needed.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    cut = (F.col("caps") + F.col("cap") / F.col("weight") * (F.col("all_weight") - F.col("weights"))) <= F.col("budget")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("caps", F.sum("cap").over(upto))
        .withColumn("weights", F.sum("weight").over(upto))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("cut", cut)
        .withColumn("cut_size", F.coalesce(F.sum(F.when(F.col("cut"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("cut"), F.col("weight"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("cut"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * (F.col("budget") - F.col("cut_size")) / F.col("open_weight"))),
        )
        .select("source", F.col("source_size").cast("long").alias("source_size"), "target")
    )


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash; null keys share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = "mix:") -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies: how often the mix takes each document.

    A null text has size 0; a null source is a source; repeated rows are decided alike; no rows give no rows.
    Clashing columns with two leading underscores would be replaced.
    """
    sized = docs.withColumn("__size", n_words(F.col("text")))
    sizes = sized.groupBy(F.col("source")).agg(F.sum("__size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    more = F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    # One row per source against all documents: broadcast when Spark has measured it as small, else a sort-merge join whose hot source AQE splits.
    return sized.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").withColumn("__copies", (F.floor(rate) + more).cast("long"))


def mix_documents(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = "mix:") -> DataFrame:
    """Each document as often as the mix takes it, with the columns that it had."""
    names = docs.columns
    mixed = copies(docs, weights, share, most, seed).where(F.col("__copies") > 0)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = copies(documents(spark, sf_dir).select("doc_id", "text", "source"), [3, 1, 2])
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


SQL = r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
ranked AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][k % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, sum(weight) OVER () AS all_weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
cuts AS (SELECT *, caps + cap / weight * (all_weight - weights) <= budget AS cut FROM levels),
opened AS (SELECT *, coalesce(sum(CASE WHEN cut THEN cap END) OVER (), 0) AS cut_size, sum(CASE WHEN NOT cut THEN weight END) OVER () AS open_weight FROM cuts),
targets AS (SELECT source, source_size, CASE WHEN cut THEN cap ELSE least(cap, weight * (budget - cut_size) / open_weight) END AS target FROM opened),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
