"""Schedules: critical path, float, histograms and working days over many networks at once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one where it is unset and all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|:|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: written to the shared folder and read again. Spark then knows its size, and broadcasts it where that is small."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def weighted(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """(network, pred, succ, w) of (network, pred, succ, kind, lag): the start of succ is at least that of pred plus w."""
    before = activities.select("network", F.col("activity").alias("pred"), F.col("duration").alias("d_pred"))
    after = activities.select("network", F.col("activity").alias("succ"), F.col("duration").alias("d_succ"))
    at_end = F.when(F.col("kind").isin("FS", "FF"), F.col("d_pred")).otherwise(0)
    to_end = F.when(F.col("kind").isin("FF", "SF"), F.col("d_succ")).otherwise(0)
    both = edges.join(before, ["network", "pred"]).join(after, ["network", "succ"])
    return both.select("network", "pred", "succ", (at_end - to_end + F.col("lag")).cast("long").alias("w"))


def longest(nodes: DataFrame, arcs: DataFrame, most: int) -> DataFrame:
    """(network, activity, at): the least values of ``at`` that are at least those given and ``at`` of source plus w along each arc.

    Each round joins the nodes that moved with their arcs and keeps only what moves further; the values of all nodes are
    put together at the end. Raises ValueError if values still move after as many rounds as the largest
    network has activities: that takes a cycle.
    """
    moved, told, rounds = nodes, nodes, 0
    while True:
        pushed = (
            moved.withColumnRenamed("activity", "source")
            .join(arcs, ["network", "source"])
            .groupBy("network", F.col("target").alias("activity"))
            .agg(F.max(F.col("at") + F.col("w")).alias("pushed"))
        )
        # Of what was told before, only the values of the nodes that are pushed now are looked at.
        now = told.join(pushed, ["network", "activity"]).groupBy("network", "activity", "pushed").agg(F.max("at").alias("was"))
        moved = cut(now.where("pushed > was").select("network", "activity", F.col("pushed").alias("at")))
        if moved.isEmpty():
            return told.groupBy("network", "activity").agg(F.max("at").alias("at"))
        told = told.unionByName(moved)
        rounds += 1
        if rounds > most:
            raise ValueError("a schedule network has a cycle")


def critical_path(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """networks.critical_path by rounds of joins, for networks that no task should hold; as many rounds as the longest chain has links."""
    activities = cut(activities.select("network", "activity", F.col("duration").cast("long").alias("duration")))
    arcs = cut(weighted(activities, edges))
    most = activities.groupBy("network").count().agg(F.max("count")).first()[0] or 0
    start = activities.select("network", "activity", F.lit(0).cast("long").alias("at"))
    early = longest(start, arcs.select("network", F.col("pred").alias("source"), F.col("succ").alias("target"), "w"), most)
    dated = activities.join(early.withColumnRenamed("at", "early_start"), ["network", "activity"]).withColumn("early_finish", F.col("early_start") + F.col("duration"))
    ends = dated.groupBy("network").agg(F.max("early_finish").alias("finish"))
    # Backwards in time the same: minus the late start grows along reversed arcs.
    back = activities.join(ends, "network").select("network", "activity", (F.col("duration") - F.col("finish")).alias("at"))
    late = longest(back, arcs.select("network", F.col("succ").alias("source"), F.col("pred").alias("target"), "w"), most)
    both = dated.join(late.select("network", "activity", (-F.col("at")).alias("late_start")), ["network", "activity"])
    at = lambda name: both.select("network", F.col("activity").alias(name), F.col("early_start").alias(f"at_{name}"))
    slack = arcs.join(at("pred"), ["network", "pred"]).join(at("succ"), ["network", "succ"])
    free = slack.groupBy("network", F.col("pred").alias("activity")).agg(F.greatest(F.lit(0).cast("long"), F.min(F.col("at_succ") - F.col("at_pred") - F.col("w"))).alias("free"))
    total = F.col("late_start") - F.col("early_start")
    return both.join(free, ["network", "activity"], "left").select(
        "network", "activity", "duration", "early_start", "early_finish", "late_start", (F.col("late_start") + F.col("duration")).alias("late_finish"),
        total.alias("total_float"), F.coalesce("free", total).alias("free_float"), (total <= 0).alias("is_critical"),
    )


def by_period(spans: DataFrame, period: str, start: str = "start", finish: str = "finish") -> DataFrame:
    """``spans`` (both dates included) once for each ``period`` ('WEEK', 'MONTH') they touch, with ``period_start`` and ``days`` in it."""
    step = F.expr(f"INTERVAL 1 {period}")
    first, last = (F.date_trunc(period, F.col(c)).cast("date") for c in (start, finish))
    each = spans.withColumn("period_start", F.explode(F.sequence(first, last, step)))
    end = F.date_sub((F.col("period_start") + step).cast("date"), 1)
    return each.withColumn("days", F.datediff(F.least(F.col(finish), end), F.greatest(F.col(start), F.col("period_start"))) + 1)


def index_quantile(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, n, at): the value at index floor(share * n) of each group's sorted values; no task has a whole group's."""
    from .boq import exact_quantiles

    return exact_quantiles(rows, [by], value, {}, count="", places={"at": share})


def confidence(n: Column, cv: Column) -> Column:
    """How far a calibration can be trusted, by its number of samples and coefficient of variation."""
    return F.when((n >= 10) & (cv <= 0.15), "high").when((n >= 5) & (cv <= 0.3), "medium").otherwise("low")


def add_working_days(dates: DataFrame, start: str, days: str, calendar: DataFrame) -> DataFrame:
    """``dates`` with ``finish``: the working day ``days`` after the first one from ``start`` on; null beyond the calendar.

    ``calendar`` is (day, working), a row for each day and so small at any scale.
    """
    running = F.sum(F.col("working").cast("long")).over(Window.orderBy("day"))
    numbered = calendar.select("day", "working", running.alias("no"))
    # The first working day from a day that is none on has the next number.
    first = numbered.select(F.col("day").alias("any_day"), (F.col("no") + F.when(F.col("working"), 0).otherwise(1)).alias("first_no"))
    placed = dates.join(first, dates[start] == F.col("any_day"), "left").withColumn("no_end", F.col("first_no") + F.col(days))
    ends = numbered.where("working").select(F.col("no").alias("no_end"), F.col("day").alias("finish"))
    return placed.join(ends, "no_end", "left").drop("no_end", "first_no", "any_day")
