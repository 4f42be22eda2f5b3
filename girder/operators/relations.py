"""Joins and checks between two tables that a platform keeps in step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n_children") -> DataFrame:
    """``parents`` with how many rows of ``children`` have their key; children are counted before the join."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def dangling(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def existing(ids: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return ids.join(parents.select(key).distinct(), key, "left_semi")
