"""Mentions in prose, title blocks, gates, summaries with guards, and heads of generated work."""

import re

from pyspark.sql import functions as F

from girder.functions import catalog, prose, works
from girder.operators import gates, registers, summaries
from girder.sources import files

TEXTS = [
    (1, "The load is < 3.5 % at 60 MW. Completion within 14 Months.\u2028RFS by Décembre 2026, chillers take\n9 weeks; UPS units need 5 days, 2 weeks"),
    (2, "Generator ordered \r then 12 days. LOAD-SHED in winter; load shed by the Indigenous council before EOY 2027"),
    (3, ""), (4, None), (5, "nothing of the kind"), (1, "TFO  weather"), (6, "x " * 40_000 + "11 kW " * 3_000),
]


def test_mentions_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("groups", F.lit("clash"))
    want = sorted(
        (i, k, place, m.start(), m.group(), x[max(0, m.start() - prose.AROUND[k]) : m.end() + prose.AROUND[k]].strip())
        for i, x in TEXTS for k, ps in prose.PATTERNS.items() for place, p in enumerate(ps) for m in re.finditer(p, x or "", re.IGNORECASE)
    )
    found = prose.mentions(docs)
    assert sorted(tuple(r)[:6] for r in found.select("doc_id", "kind", "place", "start", "raw", "context").collect()) == want and len(want) > 3_000
    dates = {(r.doc_id, r.raw[:10]): (r.month, r.year, r.duration_days) for r in prose.targets(found).collect()}
    assert dates == {(1, "Completion"): ("", "", 420), (1, "RFS by Déc"): ("Décembre", "2026", None), (2, "EOY 2027"): ("", "2027", None)}
    assert prose.mentions(docs.limit(0)).count() == 0


def test_risks_and_lead_times(spark):
    found = prose.mentions(spark.createDataFrame(TEXTS, "doc_id long, text string").where("doc_id <> 6"))
    risks = {(r.doc_id, r.type, r.keyword, r.severity) for r in prose.risks(found).collect()}
    # A hyphen keeps "load-shed" from the list of the medium ones.
    assert risks == {
        (1, "tight_constraint", "<3.5%", "high"), (1, "scale_constraint", "60.0 MW", "medium"), (1, "keyword_match", "TFO", "medium"), (1, "keyword_match", "weather", "medium"),
        (2, "keyword_match", "LOAD-SHED", "low"), (2, "keyword_match", "load shed", "medium"), (2, "keyword_match", "winter", "high"), (2, "keyword_match", "Indigenous", "medium"), (2, "schedule_dependency", "external_dependency", "high"),
    }
    leads = prose.lead_times(found).collect()
    assert sorted((r.doc_id, r.equipment, r.days) for r in leads if r.given) == [(1, "Ups", 5), (1, "Ups", 14), (2, "Generator", 12)]
    assert {r.equipment: r.days for r in leads if not r.given and r.doc_id == 2} == {k: v for k, v in prose.LEAD_TIMES.items() if k != "Generator"}


def test_violations_need_a_text_of_their_kind(spark):
    rows = [(1, "The drawings are APPROVED."), (2, "Leave is approved."), (3, "Design accepted, unapproved"), (4, None), (5, "approval\nof the Engineer"), (6, "disapprove the package")]
    assert sorted(r.doc_id for r in prose.violations(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 5]


def test_title_blocks_take_the_last_value_of_a_line(spark):
    text = "DRAWING NO: A-101\nREV B\nDRAWN BY:\nCHECKED BY: J. Smith\nScale: as shown\nDWG NO. st_2044\nREVISION 02\nTITLE: date\nSHEET 3 OF 12"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "SCALE 1 : 50 REV"), (4, "DRAWING NUMBER ZZ-900/1")], "i int, text string")
    got = {r.i: r for r in rows.select("i", *prose.title_fields(F.col("text"))).collect()}
    one = got[1]
    assert (one.drawing_number, one.discipline, one.revision, one.scale, one.sheet_number) == ("st_2044", "structural", "02", "as shown", "3 OF 12")
    assert one.drawn_by is None and one.checked_by == "J. Smith" and one.drawing_title is None and one.fields_found == 6
    assert got[2].fields_found == 0 and got[3].scale == "1 : 50" and got[3].revision is None and (got[4].drawing_number, got[4].discipline) == ("ZZ-900/1", None)


def test_gate_counts_what_is_missing(spark):
    entries = spark.createDataFrame(
        [(1, ["total"], ["sorry"], "boq"), (2, ["^a$"], None, None), (3, [], [], ""), (4, ["x"], None, None), (5, None, ["no"], "spec")], "id int, expect array<string>, reject array<string>, source string"
    )
    log = [(1, 1, "sorry", None, None), (1, 2, "The TOTAL", None, ["My BOQ.xlsx"]), (2, 1, "b\nA\nc", None, None), (3, 1, " ", "timeout", []), (5, 3, "fine, no", None, None), (9, 1, "x", None, None)]
    judged = gates.verdicts(entries, spark.createDataFrame(log, "id int, seq int, answer string, error string, sources array<string>"))
    assert {r.id: (r.verdict, r.n_reasons, r.retrieval_ok) for r in judged.collect()} == {1: ("PASS", 0, True), 2: ("PASS", 0, None), 3: ("FAIL", 2, None), 4: ("none", None, None), 5: ("FAIL", 2, False)}
    assert tuple(gates.gate(judged).first()) == (5, 2, 2, 1, 5, False) and tuple(gates.gate(judged.where("verdict = 'PASS'")).first())[-1]
    assert tuple(gates.gate(judged.limit(0)).first()) == (0, 0, 0, 0, 0, False)


def test_bills_tell_totals_or_are_guarded(spark):
    bills = spark.createDataFrame([(1, "North", "SAR", 0), (2, "South", None, 3), (3, None, "SAR", None), (4, "Bare", "SAR", 0), (5, "Nil", "", 0)], "bill int, name string, currency string, skipped int")
    lines = spark.createDataFrame(
        [(1, 1, "Civil", "Foul drain", 2.0, "m", "1.00", "2.00"), (1, 2, None, "Door", None, None, None, "4.00"), (2, 1, "Civil", None, 1.0, " ", "7.50", "7.50"), (3, 1, "Civil", "Sewer", 1.0, "m", None, None), (5, 1, "Civil", "Nothing", 0.0, "m", "0.00", "0.00"), (8, 1, "Civil", "Lost", 1.0, "m", "1.00", "1.00")],
        "bill int, position int, section string, description string, quantity double, unit string, rate string, amount string",
    )
    got = {(r.bill, r.kind, r.place): r.text for r in summaries.bill_chunks(bills, lines).collect()}
    assert {(b, k) for b, k, _ in got} == {(1, "total"), (1, "sections"), (1, "terms"), (1, "line"), (2, "partial"), (2, "sections"), (2, "line"), (3, "guard"), (3, "line"), (4, "guard"), (5, "total"), (5, "sections"), (5, "line")}
    assert got[1, "sections", 0].endswith("—  4.00 SAR (66.7%); Civil 2.00 SAR (33.3%)") and "INCOMPLETE, 3 pages not read: 7.50" in got[2, "partial", 0]
    assert got[1, "line", 1].endswith("Foul drain: total quantity 2.0 m, unit price (rate) 1.00, total price (amount) 2.00 SAR")


def test_lines_of_bills_are_moved_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    # A large bill, one whose positions repeat, one of a bill that no line has, lines of no bill.
    rows = [(1, i, [None, "A", "B"][i % 3], "Sewer" if i == 2999 else "Door", 1.0, "m", "0.01", None if i % 3 == 2 else "0.01") for i in range(3_000)]
    rows += [(2, 1, "A", f"d{i}", 1.0, "", None, "2.00") for i in range(3)] + [(None, 1, "A", "x", 1.0, "m", "1.00", "1.00")] * 5
    lines = spark.createDataFrame(rows, "bill int, position int, section string, description string, quantity double, unit string, rate string, amount string")
    bills = spark.createDataFrame([(1, "Big", "SAR", 0), (2, "Ties", None, 0), (3, "None", None, 0), (None, "Lost", None, 0)], "bill int, name string, currency string, skipped int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        chunks = summaries.bill_chunks(bills, lines.mapInArrow(counted, lines.schema))
        got = [tuple(r) for r in chunks.collect()]
        assert read.value == len(rows) and chunks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    whole = {(b, k): text for b, k, _, text in got if k != "line"}
    assert len(whole) == sum(k != "line" for _, k, _, _ in got) and set(whole) == {(1, "total"), (1, "sections"), (1, "terms"), (2, "total"), (2, "sections"), (3, "guard"), (None, "guard")}
    assert whole[1, "total"].endswith("20.00 SAR") and whole[1, "sections"].endswith("—  10.00 SAR (50.0%); A 10.00 SAR (50.0%)") and whole[2, "sections"].endswith("— A 6.00  (100.0%)")
    assert sorted((b, place) for b, k, place, _ in got if k == "line") == sorted((r[0], r[1]) for r in rows if r[0]) and len({text for b, k, _, text in got if (b, k) == (2, "line")}) == 3


def test_sheets_tell_tables_or_are_guarded(spark):
    sheets = spark.createDataFrame([(1, "S-1"), (2, "S-2"), (3, None)], "sheet int, name string")
    tables = spark.createDataFrame([(1, 0, 2, "door_schedule", ["Mark", "Size"], [["D1", None], ["D2", "900"]]), (1, 1, 2, "odd", None, [["a"]]), (2, 0, 1, "legend", [], None)], "sheet int, place int, page int, kind string, header array<string>, rows array<array<string>>")
    got = {(r.sheet, r.kind): r.text for r in summaries.table_chunks(sheets, tables).collect()}
    assert set(got) == {(1, "door_schedule"), (1, "unclassified"), (2, "guard"), (3, "guard")}
    assert got[1, "door_schedule"].endswith("Sheet page 2, 2 rows.\nMark | Size\nD1 | \nD2 | 900")


def test_heads_are_those_stated(spark):
    acts = spark.createDataFrame(
        [(1, "a", "A", "p", 5, ["x", "y"], None, None, 12.26, None), (1, "b", None, None, 3, ["x"], 7, None, None, 0.0), (1, "c", "C", "p", -2, None, 7, 2, 0.0, 9.0), (1, "d", "D", "p", None, [], 0, None, None, None)],
        "network int, activity string, name string, phase string, duration int, trades array<string>, crew_size int, manpower int, manhours double, cost double",
    )
    links = spark.createDataFrame([(1, "b", "c"), (1, "a", "c"), (1, "a", "c"), (2, "a", "b")], "network int, pred string, succ string")
    row = lambda r: (r.duration, r.manpower, r.man_days, r.manhours, r.cost, r.predecessors)
    got = {r.activity: row(r) for r in summaries.cost_loaded(acts, links).collect()}
    assert got == {"a": (5, 8, 40, 12.3, None, []), "b": (3, 7, 21, None, None, []), "c": (0, 2, 0, None, 9.0, ["a", "b"]), "d": (0, 1, 0, None, None, [])}
    priced = {r.activity: r.cost for r in summaries.cost_loaded(acts.drop("trades", "cost"), links, day_rate=10.0).collect()}
    assert priced == {"a": 50.0, "b": 210.0, "c": 0.0, "d": 0.0}


def test_base_items_by_name_then_part(spark):
    rows = [("Rebar", "uk", "industrial"), ("structural-steel", "Nowhere", "x"), ("Paving of asphalt", "US_NYC", None), ("plast", None, None), ("", "uk", None), (None, None, None), ("glass", "uk", None)]
    got = spark.createDataFrame(rows, "i string, l string, p string").select(works.benchmark_rate(F.col("i"), F.col("l"), F.col("p")).alias("r")).collect()
    assert [(r.r.item, r.r.adjusted, r.r.location_known) for r in got] == [
        ("rebar", 1.38, True), ("structural steel", 2.5, False), ("asphalt", 54.0, True), ("plaster", 18.0, False), (None, None, True), (None, None, False), (None, None, True),
    ]


def test_catalog_points(spark):
    groups = {"walls": ("material", ["block wall", "brick", "mortar"]), "crew": ("labour", ["mason", "bricklayer"]), "none": ("equipment", ["crane"])}
    rows = [("Block WALL of bricks",), ("Masonry",), ("an or ran",), ("the crane and mason",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(catalog.best_group(F.col("t"), groups, ["the", "and"]).alias("b")).collect()
    assert [r.b and (r.b.group, r.b.score, r.b.confidence, r.b.matched) for r in got] == [
        ("walls", 8, "high", ["block wall", "brick"]), ("crew", 2, "high", ["mason"]), ("none", 1, "high", ["crane"]), ("crew", 2, "high", ["mason"]), None, None,
    ]
    only = spark.createDataFrame([("Brick wall",)], "t string").select(catalog.best_group(F.col("t"), groups, kind="labour").alias("b")).first().b
    assert (only.group, only.score, only.confidence) == ("crew", 1, "medium")


def test_paraphrases_stop_at_what_is_lacking(spark):
    rows = [("a", "Check  the bill", 2), ("a", "please go", 1), ("a", "go", 3), ("a", None, 0), ("b", "x", 1), ("b", "y", 2), ("c", "", 1)]
    df = spark.createDataFrame(rows, "label string, text string, seq int")
    got = {}
    for r in registers.paraphrased(df, 20).collect():
        got.setdefault(r.label, set()).add(r.text)
    made = [p.format(x) for x in ("please go", "Check  the bill") for p in registers.PHRASES]
    made += ["verify the bill", "validate the bill", "audit the bill"] + ["how do I go"]
    assert got["a"] == set(made) and len(got["a"]) == 16 and len(got["b"]) == 12 and len(got["c"]) == 6
    assert registers.paraphrased(df, 2).where("label = 'b'").count() == 0 and registers.paraphrased(df.limit(0), 9).count() == 0


def test_xml_schedules(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        "<?xml version='1.0'?><Project><Name>Tower</Name><WBS><Activity><ID>A1</ID><Name>Dig &amp; fill</Name><Duration>5</Duration><Start>2024-01-01</Start></Activity>"
        "<Activity><ID>A2</ID><TotalFloat>2.5</TotalFloat><Duration>x</Duration><Odd>1</Odd></Activity></WBS><Activity/></Project>"
    )
    got = sorted(tuple(r)[1:] for r in files.xml_schedule(spark, str(tmp_path)).collect())
    assert got[-2:] == [("A1", "Dig & fill", "2024-01-01", "", 5.0, 0.0, 0.0), ("A2", "", "", "", 0.0, 2.5, 0.0)]


def test_texts_are_searched_only_for_what_they_can_hold(spark, monkeypatch):
    """Texts without what a pattern needs skip it, odd letters that match whatever their case don't; texts leave in bounded parts."""
    texts = ["EOY 2024 ſupply chain and Wınter", "Load-shed in May 2025 milestone", "MAY  2025 RFS by", "completed in 5 WeeKs", "generator  of 12 days", "nothing"]
    plain = [(n, k, i, m.start(), m.group()) for n, x in enumerate(texts) for k, ps in prose.PATTERNS.items() for i, p in enumerate(ps) for m in re.finditer(p, x, re.IGNORECASE)]
    monkeypatch.setattr(prose, "CHARS", 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = prose.mentions(docs).select("doc_id", "kind", "place", "start", "raw").collect()
    assert sorted(map(tuple, got)) == sorted(plain) and len(plain) >= 7
