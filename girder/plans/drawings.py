"""Drawings: the lines of an order as a schedule on a sheet, its parts as rooms and as measured values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import drawings
from ..registry import Tables, query
from .works import LIST, PICK

#: Headers of schedules, by the order's priority; two of them are of costs.
HEADS = ("ITEM | DESCRIPTION | QTY", "Mark / description / quantity", "No | Description | Rate", "Drawing no, description", "Notes | payment")
LINED = f"""(SELECT l_orderkey AS sheet, {LIST(HEADS)}[l_orderkey % 5 + 1] || chr(10) || string_agg(l_linenumber || ' | ' || p_name || ' | ' || p_size || CASE WHEN l_returnflag = 'R' THEN ' mm' WHEN l_returnflag = 'A' THEN ' kg each' ELSE ' pieces' END, chr(10) ORDER BY l_linenumber, p_partkey) AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def sheets(t: Tables, line) -> DataFrame:
    """(sheet, text): the lines of each order, one below the other."""
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", line.alias("line"))))  # an order's lines are few
    return both.groupBy(F.col("l_orderkey").alias("sheet")).agg(F.array_join(F.transform(listed, lambda x: x.line), "\n").alias("text"))


SCORED = f"""(SELECT sheet, CASE WHEN {' OR '.join(f"regexp_matches(text, '(?i){p}')" for p in [*drawings.COST_WORDS, drawings.PRICED])} THEN 0 ELSE
  CASE WHEN {' OR '.join(f"regexp_matches(text, '(?i){p}')" for p in drawings.DIMENSION_HEADERS)} THEN 3 ELSE 0 END
  + CASE WHEN n / w > 0.15 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END + CASE WHEN bars >= 2 THEN 1 ELSE 0 END END AS score
  FROM (SELECT *, len(regexp_extract_all(text, '(?i){drawings.MEASURED}')) AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::DOUBLE AS w, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) AS bars FROM {LINED}))"""


@query("dimension_tables", f"SELECT sheet, score::INTEGER AS score, score >= 3 AS kept_out FROM {SCORED}")
def dimension_tables(t: Tables) -> DataFrame:
    """Which sheets are tables of dimensions, and so kept out of what prices are read from."""
    unit = F.when(F.col("l_returnflag") == "R", " mm").when(F.col("l_returnflag") == "A", " kg each").otherwise(" pieces")
    line = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), "p_name", F.concat(F.col("p_size").cast("string"), unit))
    text = F.concat(PICK(HEADS, "sheet"), F.lit("\n"), "text")
    score = drawings.dimension_score(text).cast("int")
    return sheets(t, line).select("sheet", score.alias("score"), (score >= drawings.LEAST_SCORE).alias("kept_out"))


@query(
    "room_finishes",
    rf"""WITH s AS (SELECT l_orderkey AS sheet, string_agg(p_name || ' ' || printf('%.2f', l_quantity * 1.37) || CASE WHEN l_linenumber % 2 = 0 THEN ' x ' ELSE 'X' END || printf('%.2f', p_size * 0.13), chr(10) ORDER BY l_linenumber, p_partkey) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    f AS (SELECT sheet, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM s),
    r AS (SELECT sheet, unnest(regexp_extract_all(t, '{drawings.ROOM}', 1)) AS name, unnest(regexp_extract_all(t, '{drawings.ROOM}', 2))::DECIMAL(6,2) AS w, unnest(regexp_extract_all(t, '{drawings.ROOM}', 3))::DECIMAL(6,2) AS d FROM f)
    SELECT sheet, count(*) AS n_rooms, sum(round(w * d, 2)::DECIMAL(18,2))::DOUBLE AS area, sum(round(2 * (w + d), 2)::DECIMAL(18,2))::DOUBLE AS perimeter FROM r WHERE w BETWEEN 0.6 AND 60 AND d BETWEEN 0.6 AND 60 GROUP BY 1""",
)
def room_finishes(t: Tables) -> DataFrame:
    """Floor areas for finishes and perimeters for skirtings of the rooms on each sheet."""
    by = F.when(F.col("l_linenumber") % 2 == 0, " x ").otherwise("X")
    line = F.concat("p_name", F.lit(" "), F.format_string("%.2f", F.col("l_quantity") * 1.37), by, F.format_string("%.2f", F.col("p_size") * 0.13))
    found = sheets(t, line).select("sheet", F.explode(drawings.rooms(F.col("text"))).alias("r"))
    total = lambda c: F.sum(F.col(f"r.{c}").cast("decimal(18,2)")).cast("double").alias(c)
    return found.groupBy("sheet").agg(F.count("*").alias("n_rooms"), total("area"), total("perimeter"))


UNITS = ("USD / m3", "usd/kg", "USD/m2", "kg", "m3", "m2", "m", "MPa", "°C", "%", "each", "")
MATERIALS = ("concrete", "Steel", "formwork", "rebar", "excavation", "glass", None)


@query(
    "metric_inference",
    f"""WITH x AS (SELECT p_partkey, {LIST(UNITS)}[(p_partkey % {len(UNITS)})::INTEGER + 1] AS unit, {LIST([m or '' for m in MATERIALS])}[p_size % {len(MATERIALS)} + 1] AS m0 FROM part), y AS (SELECT *, lower(m0) AS m, lower(unit) AS u FROM x)
    SELECT p_partkey, unit, CASE WHEN u = 'usd / m3' AND m IN ('concrete', 'excavation') THEN 'rate_usd_per_m3' WHEN u = 'usd/kg' AND m IN ('steel', 'rebar') THEN 'rate_usd_per_kg' WHEN u = 'usd/m2' AND m = 'formwork' THEN 'rate_usd_per_m2'
      WHEN u = 'kg' AND m IN ('steel', 'rebar') THEN 'weight_kg' WHEN u = 'm3' AND m IN ('concrete', 'excavation') THEN 'volume_m3' WHEN u = 'm2' AND m = 'formwork' THEN 'area_m2' WHEN u = 'm' AND m = 'rebar' THEN 'length_m'
      WHEN u = 'mpa' AND m = 'concrete' THEN 'compressive_mpa' WHEN u = '°c' THEN 'temperature_degc' WHEN u = '%' THEN 'percent' END AS metric FROM y""",
)
def metric_inference(t: Tables) -> DataFrame:
    """What the figures of parts are, by unit and material."""
    unit, material = PICK(UNITS, "p_partkey"), PICK(MATERIALS, "p_size")
    return t.part.select("p_partkey", unit.alias("unit"), drawings.metric(unit, material).alias("metric"))
