"""Ranks, latest values and running figures per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schedule import cut


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark drops later ones before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.withColumn(name, rank).where(F.col(name) <= k)


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in their group, for groups of any size: no task has a whole group.

    Rows are cut into ranges of (by, order), numbered in each, and moved on by what the ranges before hold of their
    group. The ranges are written before they are counted, so that a task that runs again finds the same ones. Rows
    that ``order`` doesn't tell apart stand in any order.
    """
    at = cut(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = at.groupBy(*by, "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    keys = F.struct(*by)  # so that groups by null are met, too
    local = at.withColumn("__place", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order))).withColumn("__key", keys)
    met = local.join(sizes.select("__range", keys.alias("__key"), "__before"), ["__range", "__key"])
    return met.withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).drop("__range", "__key", "__place", "__before")


def rolling(by: list[str], order: list[str], last: int) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(last - 1), 0)


def islands(rows: DataFrame, by: list[str], number: str, width: int = 1 << 16) -> DataFrame:
    """(first, last, n) of each run of consecutive numbers.

    Runs are found in ranges of ``width`` numbers, so that a group with many rows is split; only runs that touch the end
    of a range are then joined to each other.
    """
    cell = F.floor(F.col(number) / width)
    key = F.col(number) - F.row_number().over(Window.partitionBy(*by, cell).orderBy(number))
    runs = rows.withColumn("__cell", cell).withColumn("__run", key).groupBy(*by, "__cell", "__run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    touches = (F.col("first") == F.col("__cell") * width) | (F.col("last") == (F.col("__cell") + 1) * width - 1)
    order = Window.partitionBy(*by).orderBy("first")  # two runs a range at most
    new = F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("int"), F.lit(1))
    edges = runs.where(touches).withColumn("__new", new).withColumn("__chain", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edges.groupBy(*by, "__chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("__chain")
    return runs.where(~touches).select(*by, "first", "last", "n").unionByName(stitched)
