"""Streams against the same on static rows, and readers against small files."""

import pytest
from pyspark.sql import functions as F

from girder.functions import parsing
from girder.operators import schedule
from girder.sources import files
from girder.streaming import events as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_static(spark, tmp_path):
    spark.read.parquet(EVENTS).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.windowed_metrics(streams.read_events(spark, str(tmp_path / "in")), "event_type")
    streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("last"))
    static = streams.windowed_metrics(rows, "event_type").join(last, F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.col("last"))
    closed = {tuple(r) for r in static.drop("last").collect()}
    assert got == closed and closed


def test_bill_headers(spark, tmp_path):
    at = tmp_path / "bill.csv"
    at.write_text('Item Description,Qty,Unit,Rate (AED),Amount\nSlab,"1,200",m3,300.5,360600\nNone,,m2,,\n')
    rows = [tuple(r) for r in files.bill(spark, str(at)).collect()]
    assert rows == [("Slab", 1200.0, "m3", 300.5, 360600.0), ("None", 0.0, "m2", 0.0, 0.0)]
    at.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.bill(spark, str(at))


def test_schedule_tables(spark, tmp_path):
    (tmp_path / "a.xer").write_text("ERMHDR\t1\n%T\tTASK\n%F\tid\tname\n%R\t1\tDig\n%R\t2\tPour\n%T\tPRED\n%F\tid\tpred\n%R\t2\t1\n%E\n")
    got = sorted((r.table, r["values"]["id"], r["values"].get("name")) for r in files.schedule_tables(spark, str(tmp_path)).collect())
    assert got == [("PRED", "2", None), ("TASK", "1", "Dig"), ("TASK", "2", "Pour")]


def test_money_notations(spark):
    written = ["1,234.50", "1.234,50", "1.234", "1,234", "12,5", "1.234.567", "-3.5", "none"]
    rows = spark.createDataFrame([(w,) for w in written], "t string").select(parsing.money(F.col("t")).alias("m"))
    assert [r.m for r in rows.collect()] == [1234.5, 1234.5, 1234.0, 1234.0, 12.5, 1234567.0, -3.5, None]


def test_planted_network_and_cycle(spark):
    acts = spark.createDataFrame([("n", "A", 5), ("n", "B", 3), ("n", "C", 2), ("n", "D", 1)], "network string, activity string, duration int")
    edges = [("n", "A", "B", "FS", 0), ("n", "B", "C", "FS", 0), ("n", "A", "D", "FS", 0)]
    kinds = "network string, pred string, succ string, kind string, lag int"
    got = {r.activity: r for r in schedule.critical_path(acts, spark.createDataFrame(edges, kinds)).collect()}
    assert max(r.early_finish for r in got.values()) == 10 and got["D"].total_float == 4 and [k for k in "ABCD" if got[k].is_critical] == ["A", "B", "C"]
    with pytest.raises(ValueError):
        schedule.critical_path(acts, spark.createDataFrame([*edges, ("n", "C", "A", "FS", 0)], kinds)).collect()
