"""Schedule exports as networks, rooms, tables of dimensions and metrics."""

from pyspark.sql import functions as F

from girder.functions import drawings
from girder.operators import networks, works
from girder.sources import files

EXPORT = "\n".join(
    "\t".join(x)
    for x in (
        ["ERMHDR", "19.12"], ["%T", "CALENDAR"], ["%F", "clndr_id", "clndr_name", "day_hr_cnt"], ["%R", "1", "std", "8"], ["%R", "2", "long", "10"],
        ["%T", "TASK"], ["%F", "task_id", "clndr_id", "task_code", "target_drtn_hr_cnt"], ["%R", "100", "1", "A10", "40"], ["%R", "101", "2", "A20", "100"], ["%R", "102", "9", "A30", "16"],
        ["%T", "TASKPRED"], ["%F", "task_id", "pred_task_id", "pred_type", "lag_hr_cnt"], ["%R", "101", "100", "PR_FS", "16"], ["%R", "102", "100", "PR_SS", "0"], ["%R", "102", "999", "PR_FS", "0"],
        ["%T", "RSRC"], ["%F", "rsrc_id", "rsrc_short_name", "rsrc_type"], ["%R", "7", "mason", "RT_Labor"], ["%R", "8", "crane", "RT_Equip"],
        ["%T", "TASKRSRC"], ["%F", "task_id", "rsrc_id", "target_qty"], ["%R", "100", "7", "3"], ["%R", "101", "8", "1"], ["%R", "101", "7", "2"], ["%R", "998", "7", "2"], ["%E"],
    )
)


def test_export_becomes_a_network(spark, tmp_path):
    (tmp_path / "one.xer").write_text(EXPORT)
    (tmp_path / "two.xer").write_text(EXPORT.replace("A10", "B10"))
    activities, links, used = files.networks_of(files.schedule_tables(spark, str(tmp_path)))
    one = F.col("network").endswith("one.xer")
    assert sorted((r.activity, r.duration) for r in activities.where(one).collect()) == [("A10", 5), ("A20", 10), ("A30", 2)]
    assert sorted(tuple(r)[1:] for r in links.where(one).collect()) == [("A10", "A20", "FS", 2), ("A10", "A30", "SS", 0)]
    assert sorted(tuple(r)[1:] for r in used.where(one).collect()) == [("A10", "mason", True, 3.0), ("A20", "crane", False, 1.0), ("A20", "mason", True, 2.0)]
    dated = networks.critical_path(activities, links)
    assert {r.activity: (r.early_start, r.early_finish) for r in dated.where(one).collect()} == {"A10": (0, 5), "A20": (7, 17), "A30": (0, 2)}
    spans = dated.join(used.where("labour"), ["network", "activity"]).select("network", F.col("early_start").alias("start"), F.col("early_finish").alias("finish"), "resource", F.col("units").alias("crew"))
    assert {r.period: r.heads for r in works.head_counts(spans, 5).where(one).collect()} == {0: 3.0, 1: 2.0, 2: 2.0, 3: 2.0}


def test_rooms_of_a_sheet(spark):
    text = "BEDROOM 1\n 3.45 x 4.10 Bath-room & WC- 0.50X2.00 HALL 60.00 X 12.25 grid 61.00x2.00 Store 2 x 3 lobby"
    got = [tuple(r) for r in spark.createDataFrame([(text,)], "t string").select(drawings.rooms(F.col("t")).alias("r")).first().r]
    assert [(n, w, d) for n, w, d, *_ in got] == [("BEDROOM 1", 3.45, 4.1), ("HALL", 60.0, 12.25)] and got[1][3:] == (735.0, 144.5)
    assert spark.createDataFrame([(None,)], "t string").select(drawings.rooms(F.col("t")).alias("r")).first().r == []


def test_tables_of_dimensions(spark):
    rows = {
        "ITEM DESCRIPTION QTY\n1 | wall | 3 m\n2 | slab | 4 m": 4, "Item, description, rate, qty 3 m 4 m 5 m": 0, "pay USD 500 for item description qty": 0,
        "3 m 4 m 5 m and a great many words that follow here so that the density of numbers is low, as it is in most of all texts": 1, "3 mm 4 mm": 2, "plain words": 0, None: 0, "": 0,
    }
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", drawings.dimension_score(F.col("t")).alias("s")).collect()}
    assert got == rows
