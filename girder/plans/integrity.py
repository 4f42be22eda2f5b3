"""Integrity and inventory of documents and what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relations
from ..registry import Tables, query


@query(
    "docs_chunk_counts",
    "SELECT o_orderkey AS order_id, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def docs_chunk_counts(t: Tables) -> DataFrame:
    parents, children = t.orders.select(F.col("o_orderkey").alias("order_id")), t.lineitem.select(F.col("l_orderkey").alias("order_id"))
    return relations.child_counts(parents, children, "order_id", "n_lines")


@query("dangling_labels", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_labels(t: Tables) -> DataFrame:
    """Documents that no label points to."""
    return relations.dangling(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("existing_customers", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existing_customers(t: Tables) -> DataFrame:
    return relations.existing(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "mismatched_nation",
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""",
)
def mismatched_nation(t: Tables) -> DataFrame:
    own = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    both = own.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    return both.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "c_nationkey", "s_nationkey")


@query(
    "mismatch_summary",
    """SELECT c_nationkey AS from_nation, s_nationkey AS to_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL""",
)
def mismatch_summary(t: Tables) -> DataFrame:
    return mismatched_nation(t).groupBy(F.col("c_nationkey").alias("from_nation"), F.col("s_nationkey").alias("to_nation")).agg(F.count("*").alias("n"))


@query(
    "corpus_counters",
    """SELECT count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS n_empty, count(*) - count(DISTINCT doc_id) AS n_repeated_ids,
    count(*) - count(DISTINCT sha256(text)) AS n_copies, count(*) FILTER (length(text) <> n_chars) AS n_wrong_length, count(DISTINCT lang) AS n_langs FROM documents""",
)
def corpus_counters(t: Tables) -> DataFrame:
    plain = t.documents.agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"), F.count_if(F.length("text") != F.col("n_chars")).alias("n_wrong_length")
    )
    # One aggregate for each distinct count: together they would multiply every row by their number.
    kinds = lambda column, name: t.documents.where(column.isNotNull()).select(column.alias("x")).distinct().agg(F.count("*").alias(name))
    both = plain.crossJoin(kinds(F.col("doc_id"), "ids")).crossJoin(kinds(F.sha2("text", 256), "texts")).crossJoin(kinds(F.col("lang"), "n_langs"))  # one row each
    return both.select("n", "n_empty", (F.col("n") - F.col("ids")).alias("n_repeated_ids"), (F.col("n") - F.col("texts")).alias("n_copies"), "n_wrong_length", "n_langs")


@query("inventory_by_source", "SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def inventory_by_source(t: Tables) -> DataFrame:
    return t.documents.rollup("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("dedupe_sha256", "SELECT source, sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY ALL")
def dedupe_sha256(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("union_ids", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").union(t.labels.select("doc_id")).distinct()


@query("gap_fill_events", "SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id * 12)")
def gap_fill_events(t: Tables) -> DataFrame:
    known = t.customer.select(F.col("c_custkey").alias("k"))
    return t.events.join(known, F.col("user_id") * 12 == F.col("k"), "left_anti").select("event_id", "user_id")


@query(
    "count_reconciliation",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS id, n_orders, n_events, n_orders IS NULL OR n_events IS NULL OR n_orders <> n_events AS mismatch FROM a FULL JOIN b ON a.k = b.k""",
)
def count_reconciliation(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    b = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"))
    wrong = F.col("n_orders").isNull() | F.col("n_events").isNull() | (F.col("n_orders") != F.col("n_events"))
    return a.join(b, "id", "full").withColumn("mismatch", wrong)


@query(
    "upsert_latest_fact",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
)
def upsert_latest_fact(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


SHARD = "list_reduce(list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', substr(sha256(doc_id::VARCHAR), i::INTEGER, 1)) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 7)"


@query("shard_assign", f"SELECT doc_id, ({SHARD} % 7)::BIGINT AS shard FROM documents")
def shard_assign(t: Tables) -> DataFrame:
    """The 256-bit hash of an id, modulo the number of shards, digit by digit."""
    digits = F.transform(F.split(F.sha2(F.col("doc_id").cast("string"), 256), ""), lambda c: F.conv(c, 16, 10).cast("long"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    return t.documents.select("doc_id", F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % 7).alias("shard"))
