"""Queries on event streams, boxes, rules, parsed figures and ranked passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import lexical, spatial
from ..registry import Tables, query
from ..streaming import events as streams


@query("window_metrics", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, sum(value::DECIMAL(38,6))::DOUBLE AS total FROM events GROUP BY 1, 2")
def window_metrics(t: Tables) -> DataFrame:
    return streams.windowed_metrics(t.events, "event_type")


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events),
    s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(t: Tables) -> DataFrame:
    return streams.sessions(t.events, "user_id")


@query(
    "rate_limited",
    """WITH RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, event_id, k, 0::BIGINT AS recent, false AS limited, [ts] AS kept FROM r WHERE k = 1 UNION ALL
      SELECT user_id, event_id, k, len(f), len(f) >= 5, CASE WHEN len(f) >= 5 THEN f ELSE list_append(f, ts) END FROM
      (SELECT r.*, list_filter(s.kept, lambda x: x >= r.ts - INTERVAL 1 DAY) AS f FROM s JOIN r ON s.user_id = r.user_id AND r.k = s.k + 1))
    SELECT event_id, user_id, recent, limited FROM s""",
)
def rate_limited(t: Tables) -> DataFrame:
    """Events beyond five a day of a user; those that are denied don't count against later ones."""
    return streams.limited(t.events, "user_id", 5, 86_400)


@query(
    "box_clashes",
    """WITH b AS (SELECT c_custkey AS id, c_custkey * 1.0::DOUBLE AS x0, c_custkey + 1.0::DOUBLE + c_nationkey % 3 AS x1, (c_custkey * 13 % 50)::DOUBLE AS y0,
      (c_custkey * 13 % 50)::DOUBLE + 20 AS y1, 0::DOUBLE AS z0, 3::DOUBLE AS z1 FROM customer)
    SELECT p.id AS a, q.id AS b, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) * 3 AS overlap FROM b p JOIN b q
      ON p.id < q.id AND q.x0 < p.x1 AND p.x0 < q.x1 AND q.y0 < p.y1 AND p.y0 < q.y1""",
)
def box_clashes(t: Tables) -> DataFrame:
    key, y = F.col("c_custkey").cast("double"), (F.col("c_custkey") * 13 % 50).cast("double")
    boxes = t.customer.select(
        F.col("c_custkey").alias("id"), key.alias("x0"), (key + 1 + F.col("c_nationkey") % 3).alias("x1"), y.alias("y0"), (y + 20).alias("y1"), F.lit(0.0).alias("z0"), F.lit(3.0).alias("z1")
    )
    return spatial.clashes(boxes, 10.0)


@query(
    "rule_cascade",
    """WITH RECURSIVE r AS (SELECT s_suppkey AS source, s_suppkey * 2 AS target FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 3 + 1 FROM supplier),
    c AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS level FROM supplier UNION SELECT start, target, level + 1 FROM c JOIN r ON node = source WHERE level < 3)
    SELECT start, node, min(level) AS level FROM c GROUP BY 1, 2""",
)
def rule_cascade(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    rules = t.supplier.select(key.alias("source"), F.explode(F.array(key * 2, key * 3 + 1)).alias("target"))
    return spatial.cascade(rules, t.supplier.select(key.alias("node")))


@query("money_parse", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS american, round(l_extendedprice, 2) AS european FROM lineitem")
def money_parse(t: Tables) -> DataFrame:
    """Prices written in both notations and read again."""
    american = F.concat(F.lit("USD "), F.format_number("l_extendedprice", 2))
    european = F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), F.lit(" EUR"))
    return t.lineitem.select("l_orderkey", "l_linenumber", parsing.money(american).alias("american"), parsing.money(european).alias("european"))


@query("polygon_areas", "SELECT l_orderkey, l_linenumber, l_quantity * l_linenumber / 2 AS area FROM lineitem")
def polygon_areas(t: Tables) -> DataFrame:
    """Right-angled triangles of the quantity and the line number."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(at(F.lit(0), F.lit(0)), at(F.col("l_quantity"), F.lit(0)), at(F.lit(0), F.col("l_linenumber")))
    return t.lineitem.select("l_orderkey", "l_linenumber", parsing.polygon_area(points).alias("area"))


@query("date_parse", "SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS slashed, o_orderdate::DATE AS named FROM orders")
def date_parse(t: Tables) -> DataFrame:
    written = {"iso": "yyyy-MM-dd", "slashed": "dd/MM/yyyy", "named": "dd-MMM-yyyy"}
    return t.orders.select("o_orderkey", *(parsing.date(F.date_format("o_orderdate", f)).alias(name) for name, f in written.items()))


@query("part_slugs", "SELECT p_partkey, substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) AS slug FROM part")
def part_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parsing.slug(F.col("p_name")).alias("slug"))


@query(
    "bm25_topk",
    """WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), g GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def bm25_topk(t: Tables) -> DataFrame:
    return lexical.bm25_top(t.documents, t.benchmark.withColumnRenamed("item_id", "query_id"), 10).withColumnRenamed("query_id", "item_id")
