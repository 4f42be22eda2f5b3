"""Limits and budgets on streams, incremental replacement, logs and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from girder.operators import retrieval
from girder.sources import stores
from girder.streaming import events as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_limited_stream_equals_static(spark, tmp_path):
    rows = spark.read.parquet(EVENTS)
    cuts = [r[0] for r in rows.select(F.percentile("event_id", F.array(F.lit(0.3), F.lit(0.7)))).collect()][0]
    parts = [rows.where(F.col("event_id") <= cuts[0]), rows.where((F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1])), rows.where(F.col("event_id") > cuts[1])]
    for i, part in enumerate(parts):  # events come in order of time over the batches
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.limited_stream(streams.read_events(spark, str(tmp_path / "in"), 1), "user_id", 3, 86_400)
        streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "user_id", "recent", "limited").collect()}
    want = {tuple(r) for r in streams.limited(rows, "user_id", 3, 86_400).select("event_id", "user_id", "recent", "limited").collect()}
    assert got == want and any(r[3] for r in want)


def test_denied_events_do_not_count():
    bucket = streams.Bucket(2, 60)
    told = [bucket.ask(s * 1_000_000)[1] for s in (0, 10, 20, 30, 61, 62, 71)]
    assert told == [False, False, True, True, False, True, False]


def test_replace_and_delete_by_document(spark, tmp_path):
    at = str(tmp_path / "chunks")
    chunks = lambda *rows: spark.createDataFrame(list(rows), "project string, doc_id long, chunk_index int, text string")
    stores.replace_chunks(chunks(("p", 1, 0, "a\0b"), ("p", 1, 1, "c"), ("p", 2, 0, "d"), ("q", 1, 0, "e")), at)
    stores.replace_chunks(chunks(("p", 1, 0, "new")), at)
    got = sorted((r.project, r.doc_id, r.chunk_index, r.text) for r in spark.read.parquet(at).collect())
    assert got == [("p", 1, 0, "new"), ("p", 2, 0, "d"), ("q", 1, 0, "e")]
    stores.delete_documents(spark.createDataFrame([("p", 2)], "project string, doc_id long"), at)
    assert sorted((r.project, r.doc_id) for r in spark.read.parquet(at).collect()) == [("p", 1), ("q", 1)]


def test_insert_absent_and_log(spark, tmp_path):
    at = str(tmp_path / "facts")
    facts = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    stores.insert_absent(facts((1, "a"), (2, "b")), at, ["k"])
    stores.insert_absent(facts((2, "other"), (3, "c"), (3, "c")), at, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    log = str(tmp_path / "log")
    stores.append_log(spark.createDataFrame([(i, "p" if i % 2 else "q", f"t{i}") for i in range(6)], "at long, project string, what string"), log)
    (tmp_path / "log" / "broken.json").write_text('{"at": 9, "project": "p", "wh\n' + json.dumps({"at": 10, "project": "p", "what": "last"}) + "\n")
    tail = stores.read_tail(spark, log, "at long, project string, what string", "at", 2, F.col("project") == "p")
    assert [r.what for r in tail.orderBy("at").collect()] == ["t5", "last"]


def test_index_changes_replaces_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "two", 1)], "doc_id long, text string, s long").withColumn("ts", F.timestamp_seconds("s"))
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    at = str(tmp_path / "index")
    put = lambda df: stores.replace_chunks(df.select(F.lit("p").alias("project"), "doc_id", F.lit(0).alias("chunk_index"), "text"), at)
    streams.index_changes(streams.read_events(spark, str(tmp_path / "in")), put, str(tmp_path / "state"))
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(at).collect()) == [(1, "new"), (2, "two")]


def test_boundary_chunks_cover_the_text(spark):
    texts = ["one sentence. " * 200, "A 1.2 first item\nB 2.3 second item\n" * 60, "x" * 2500, "short", "  ", None, "para one.\n\n" * 120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in retrieval.boundary_chunks(docs).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    assert 4 not in got and 5 not in got and got[3] == [(0, "short")]
    for i in (0, 1, 2, 6):
        chunks = [c for _, c in sorted(got[i])]
        assert all(len(c) <= 800 for c in chunks) and chunks[0][:20] == texts[i].strip()[:20] and texts[i].strip().endswith(chunks[-1][-20:])
        at = 0
        for c in chunks:  # each chunk begins within or right after the one before
            where = texts[i].find(c, max(0, at - 120))
            assert 0 <= where <= at + 60
            at = where + len(c)
    assert all(c.endswith((".", "item")) for _, c in sorted(got[0])[:-1])


def test_markdown_tables_stay_whole(spark):
    table = "| Book | Form |\n|---|---|\n| Silver | EPC |\n| Red | Build |"
    docs = spark.createDataFrame([(1, f"# Title\nSome prose here.\n\n## Forms\n{table}\nMore prose."), (2, "| no | rule |\n| a | b |")], "doc_id long, text string")
    got = [r.text for r in retrieval.markdown_chunks(docs).orderBy("doc_id", "chunk_index").collect()]
    assert got == ["# Title\nSome prose here.\n\n## Forms", f"## Forms\n{table}", "More prose.", "| no | rule |\n| a | b |"]
    rows = [(r.line, r.cells) for r in retrieval.markdown_rows(docs.where("doc_id = 1")).orderBy("line").collect()]
    assert [c for _, c in rows] == [["Book", "Form"], ["Silver", "EPC"], ["Red", "Build"]]


def test_bill_header_below_titles(spark, tmp_path):
    from girder.sources import files

    at = tmp_path / "bill.csv"
    at.write_text("Project X,,,\nBill no 3,,,\nItem No.,Description of Work,Qty.,Unit Rate (AED)\n1,Slab,3,2.5\n2,Wall,4,1\n")
    rows = [r.asDict() for r in files.bill(spark, str(at)).collect()]
    assert [(r["description"], r["quantity"], r["rate"]) for r in rows] == [("Slab", 3.0, 2.5), ("Wall", 4.0, 1.0)]
    assert files.resolved(["Unit Price SAR", "Extended Price", "UoM", "CSI Div"]) == {"rate": "Unit Price SAR", "total": "Extended Price", "unit": "UoM", "section": "CSI Div"}
    at.write_text('Bill no 3,,\nDescription,Qty,Rate\n"Slab, ""thick""\nof two lines",3,2\nDescription,Qty,Rate\nWall,x,"1,000.5"\nBill no 3,,\n')
    rows = [(r.description, r.quantity, r.rate) for r in files.bill(spark, str(at)).collect()]
    assert rows == [('Slab, "thick"\nof two lines', 3.0, 2.0), ("Description", 0.0, 0.0), ("Wall", 0.0, 1000.5), ("Bill no 3", 0.0, 0.0)]
    assert files.resolved(["Item", "Qty.", "Amount (SAR)", "Cost per unit"]) == {"description": "Item", "quantity": "Qty.", "total": "Amount (SAR)", "rate": "Cost per unit", "unit": "Cost per unit"}
    with pytest.raises(ValueError):
        at.write_text("a,b\n1,2\n")
        files.bill(spark, str(at))
