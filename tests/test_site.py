"""Boxes of very unlike size, deviations from the first of a type, heads by period and obligations."""

import random

from pyspark.sql import functions as F

from girder.functions import mining
from girder.operators import spatial, works


def test_clashes_of_unlike_boxes(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        size = 10 ** rng.uniform(-2, 3)
        low = [rng.uniform(-200, 200) for _ in range(3)]
        rows.append((i, *(x for k in range(3) for x in (low[k], low[k] + size * rng.uniform(0.1, 1)))))
    rows += [(400, -5000.0, 5000.0, -5000.0, 5000.0, 0.0, 1.0), (401, 8.0, 8.0, 8.0, 8.0, 0.0, 1.0), (402, 8.0, 16.0, -8.0, 8.0, 0.0, 50.0)]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and all(min(a[2 * k], b[2 * k]) - max(a[2 * k - 1], b[2 * k - 1]) > 0.001 for k in (1, 2, 3)):
                want.add((a[0], b[0]))
    boxes = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double").repartition(3)
    for cell in (0.5, 8.0):
        got = [(r.a, r.b) for r in spatial.clashes(boxes, cell, 0.001).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 500 and spatial.clashes(boxes.limit(0), 1.0).count() == 0


def test_boxes_around_vertices(spark):
    rows = [(1, 0.0, 5.0, 1.0), (1, 2.0, -5.0, 1.0), (1, None, 9.0, 9.0), (2, 1.0, 1.0, 1.0)]
    got = sorted(tuple(r) for r in spatial.boxes_of(spark.createDataFrame(rows, "k long, x double, y double, z double"), "k").collect())
    assert got == [(1, 0.0, 2.0, -5.0, 5.0, 1.0, 1.0, 2), (2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]


def test_deviations_take_the_first_of_a_type(spark):
    design = spark.createDataFrame([("wall", 3.0, 2), ("wall", 2.0, 1), ("slab", 1.0, 5)], "type string, value double, seq int")
    built = spark.createDataFrame([("a", "wall", 2.004), ("b", "wall", 2.006), ("c", "wall", 1.98), ("d", "slab", 1.0), ("e", "roof", 9.0), ("f", "slab", None)], "element string, type string, value double")
    got = {r.element: (r.design_value, r.deviation, r.severity) for r in works.deviations(built, design, 5).collect()}
    assert got == {"b": (2.0, 0.006, "minor"), "c": (2.0, 0.02, "major")}


def test_heads_by_period(spark):
    spans = spark.createDataFrame([(1, 0, 5, "labour", 3), (1, 4, 11, "labour", 2), (1, 6, 6, "crane", 1), (2, 10, 10, "labour", 7)], "network int, start int, finish int, resource string, crew int")
    got = {(r.network, r.period): (r.heads, r.by_resource) for r in works.head_counts(spans, 5).collect()}
    assert got == {(1, 0): (5, {"labour": 5}), (1, 1): (3, {"crane": 1, "labour": 2}), (1, 2): (2, {"labour": 2}), (2, 2): (7, {"labour": 7})}
    assert {(r.network, r.period): r.heads for r in works.head_counts(spans, 5, ["labour"]).collect()}[1, 1] == 2


def test_obligations(spark):
    text = "Payment is due. The Contractor shall protect the works. The owner agrees to pay the invoice; each party must insure. Both parties must keep time. The engineer will decide."
    got = [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(mining.obligations(F.col("t")).alias("o")).first().o]
    assert got == [
        ("contractor_obligation", "Contractor shall protect the works.", "safety", "high"), ("mutual_obligation", "each party must insure.", "general", "high"),
        ("mutual_obligation", "Both parties must keep time.", "schedule", "high"), ("consultant_obligation", "engineer will decide.", "general", "medium"),
    ]
    assert spark.createDataFrame([(None,)], "t string").select(mining.obligations(F.col("t")).alias("o")).first().o == []


def test_parts_are_dealt_out_before_their_texts_are_read(spark):
    """One small file must not mean one task for all patterns."""
    from girder.plans.works import parts
    from girder.registry import Tables

    assert parts(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
