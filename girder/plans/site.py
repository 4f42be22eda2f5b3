"""What is built against what was designed, heads on site, boxes around vertices, and what contracts oblige to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mining
from ..operators import networks as net
from ..operators import spatial, works
from ..registry import Tables, query
from .curation import CLAUSES, SAID
from .schedule import NETWORK, networks
from .works import PICK


@query(
    "as_built_deviations",
    """WITH d AS (SELECT p_brand AS type, arg_min(p_size, p_partkey)::DOUBLE AS design_value FROM part GROUP BY 1), b AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS type, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, type, value, design_value, round(abs(value - design_value), 3) AS deviation, CASE WHEN abs(value - design_value) > 20 THEN 'major' ELSE 'minor' END AS severity
    FROM b JOIN d USING (type) WHERE abs(value - design_value) > 10""",
)
def as_built_deviations(t: Tables) -> DataFrame:
    """Delivered quantities against the size of the first part of their brand, with a tolerance of ten."""
    built = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_brand").alias("type"), F.col("l_quantity").alias("value"))
    design = t.part.select(F.col("p_brand").alias("type"), F.col("p_size").alias("value"), F.col("p_partkey").alias("seq"))
    return works.deviations(built, design, 10_000)


RESOURCES = ("crew", "crane", "engineer")


@query(
    "head_counts",
    f"""WITH RECURSIVE {NETWORK}, who AS (SELECT l_orderkey AS network, l_linenumber AS activity, ['crew', 'crane', 'engineer'][max(l_suppkey) % 3 + 1] AS resource, count(*) + max(l_linenumber) AS crew FROM lineitem GROUP BY 1, 2),
    s AS (SELECT network, resource, crew, unnest(generate_series(early_start // 5, greatest(early_start, early_finish - 1) // 5)) AS period FROM cpm JOIN who USING (network, activity) WHERE resource <> 'crane'),
    g AS (SELECT network, period, resource, sum(crew) AS crew FROM s GROUP BY ALL)
    SELECT network, period, sum(crew)::BIGINT AS heads, string_agg(resource || ':' || crew, ',' ORDER BY resource) AS by_resource FROM g GROUP BY 1, 2""",
)
def head_counts(t: Tables) -> DataFrame:
    """Who works in each week of each order by early dates, labour only."""
    who = t.lineitem.groupBy(F.col("l_orderkey").alias("network"), F.col("l_linenumber").alias("activity")).agg(F.max("l_suppkey").alias("k"), (F.count("*") + F.max("l_linenumber")).alias("crew"))
    dated = net.critical_path(*networks(t)).join(who.withColumn("resource", PICK(RESOURCES, "k")), ["network", "activity"])
    heads = works.head_counts(dated.select("network", F.col("early_start").alias("start"), F.col("early_finish").alias("finish"), "resource", "crew"), 5, ["crew", "engineer"])
    told = F.array_join(F.transform(F.map_entries("by_resource"), lambda e: F.concat_ws(":", e.key, e.value.cast("string"))), ",")
    return heads.withColumn("by_resource", told)


@query(
    "vertex_clashes",
    """WITH v AS (SELECT l_orderkey AS id, l_orderkey + l_quantity / 25 + CASE WHEN l_orderkey % 997 = 0 THEN l_linenumber * 150 ELSE 0 END AS x, l_suppkey % 10 + l_linenumber AS y, l_quantity AS z FROM lineitem),
    b AS (SELECT id, min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1, min(z)::DOUBLE AS z0, max(z)::DOUBLE AS z1 FROM v GROUP BY 1)
    SELECT p.id AS a, q.id AS b, round((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) * (least(p.z1, q.z1) - greatest(p.z0, q.z0)), 6) AS overlap FROM b p JOIN b q
      ON p.id < q.id AND least(p.x1, q.x1) > greatest(p.x0, q.x0) AND least(p.y1, q.y1) > greatest(p.y0, q.y0) AND least(p.z1, q.z1) > greatest(p.z0, q.z0)""",
)
def vertex_clashes(t: Tables) -> DataFrame:
    """Boxes around the lines of orders as vertices, of very unlike size, and which of them clash."""
    far = F.when(F.col("l_orderkey") % 997 == 0, F.col("l_linenumber") * 150).otherwise(0)
    vertices = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") + F.col("l_quantity") / 25 + far).alias("x"), (F.col("l_suppkey") % 10 + F.col("l_linenumber")).alias("y"), F.col("l_quantity").alias("z"))
    return spatial.clashes(spatial.boxes_of(vertices, "id"), 1.0).withColumn("overlap", F.round("overlap", 6))


CASES = lambda table, x, otherwise: "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN '{name}'" for name, words in table.items()) + f" ELSE '{otherwise}' END"
EACH = " UNION ALL ".join(f"SELECT doc_id, {i} AS who, '{kind}' AS type, unnest(regexp_extract_all(text, '(?i){p}')) AS text, generate_subscripts(regexp_extract_all(text, '(?i){p}'), 1) AS k FROM said" for i, (p, kind) in enumerate(mining.OBLIGED))


@query(
    "obligation_mining",
    f"""WITH said AS {SAID}, o AS ({EACH}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY who, k) AS n FROM o)
    SELECT doc_id, n::INTEGER AS n, type, text, {CASES(mining.OBLIGATION_FIELDS, 'text', 'general')} AS category, {CASES(mining.OBLIGATION_WEIGHTS, 'text', 'low')} AS priority FROM r WHERE n <= 20""",
)
def obligation_mining(t: Tables) -> DataFrame:
    """Who owes what in each document, with two clauses of a contract put before its text."""
    said = F.concat_ws(" ", PICK(CLAUSES, "doc_id"), F.element_at(F.array(*map(F.lit, CLAUSES)), (F.col("doc_id") * 3 % len(CLAUSES) + 1).cast("int")), F.coalesce("text", F.lit("")))
    found = t.documents.select("doc_id", F.posexplode(mining.obligations(said)).alias("n", "o"))
    return found.select("doc_id", (F.col("n") + 1).alias("n"), "o.*")
