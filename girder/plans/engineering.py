"""Calculators over a grid: quantity, price and line number of each line as loads, spans and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import engineering as eng
from ..registry import Tables, query
from .commercial import measures
from .works import PICK

GRID = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice AS p, l_linenumber::DOUBLE AS s FROM lineitem)"
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
SUPPORTS = tuple(eng.RATIOS)


@query(
    "calculators_loads",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, power(q, 2) * 613 * 85 / 1e5 AS wind, power(q, 2) * 5 / 8 AS wind_euro, p / 8 AS shear, p * 0.3 * 1.2 * 2.5 * 0.85 / 3.9 AS shear_euro,
    CASE WHEN 2 * q < 37.2 THEN s ELSE s * greatest(0.5, 0.25 + 4.57 / sqrt(2 * q)) END AS live, 613 * power(s, 2) * q * s / 2e6 AS overturning FROM {GRID}""",
)
def calculators_loads(t: Tables) -> DataFrame:
    q, p, s = measures()
    return t.lineitem.select(
        *KEYS, eng.wind_pressure(q).alias("wind"), eng.wind_pressure(q, True).alias("wind_euro"), eng.base_shear(p).alias("shear"), eng.base_shear(p, True).alias("shear_euro"),
        eng.live_load(s, q).alias("live"), eng.formwork_wind_moment(s, q, s).alias("overturning"),
    )


@query(
    "calculators_members",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, 0.9 * 100 * q * 420 * (500 - 50 * q * 420 / (0.85 * 30 * 300)) / 1e6 AS moment, (100 * q * 500 / 1.15) * (500 - 2 * (100 * q * 500 / 1.15) / (5 * 300 * 20)) / 1e6 AS moment_euro,
    0.75 * 0.17 * sqrt(30) * 300 * (q * 10) / 1000 AS shear, 0.12 * least(2, 1 + sqrt(20 / q)) * power(30, 1 / 3.0::DOUBLE) * 300 * (q * 10) / 1000 AS shear_euro,
    p / CASE l_linenumber % 4 WHEN 0 THEN 20 WHEN 1 THEN 24 WHEN 2 THEN 28 ELSE 10 END AS slab, p / CASE l_linenumber % 4 WHEN 0 THEN 20 WHEN 1 THEN 26 WHEN 2 THEN 30 ELSE 8 END AS slab_euro,
    q * 1.3 * 420 / (1.1 * sqrt(30) * 1.5) AS lap, q * 1.5 * (500 / 1.15) / (9 * (0.21 * power(30, 2 / 3.0::DOUBLE) / 1.5)) AS lap_euro, least(p * 310.5, p * 0.9 * 337.5) / 1000 AS tension, least(p * 345, p * 0.9 * 324) / 1000 AS tension_euro,
    279 * q * s / 1000 AS bolt, 178.56 * q * s / 1000 AS bolt_euro, 0.707 * s * 220.5 * q / 1000 AS weld, 0.707 * s * q * 490 / sqrt(3) / 1.125 / 1000 AS weld_euro,
    (25.5 * (p - q) + 420 * q) * CASE WHEN l_linenumber % 2 = 0 THEN 0.6375 ELSE 0.52 END / 1000 AS axial,
    2.5 * p * CASE WHEN 3000 * sqrt(12) / (q * 10) <= 99 THEN 1 - (3000 * sqrt(12) / (q * 10) / 140) * (3000 * sqrt(12) / (q * 10) / 140) ELSE (70 / (3000 * sqrt(12) / (q * 10))) * (70 / (3000 * sqrt(12) / (q * 10))) END / 1000 AS wall FROM {GRID} WHERE q > 0""",
)
def calculators_members(t: Tables) -> DataFrame:
    q, p, s = measures()
    support = PICK(SUPPORTS, "l_linenumber")
    return t.lineitem.where("l_quantity > 0").select(
        *KEYS, eng.beam_moment(q * 100, 420.0, 300.0, 500.0, 30.0).alias("moment"), eng.beam_moment(q * 100, 500.0, 300.0, 500.0, 37.5, True).alias("moment_euro"),
        eng.beam_shear(F.lit(300.0), q * 10, 30.0).alias("shear"), eng.beam_shear(F.lit(300.0), q * 10, 30.0, True).alias("shear_euro"),
        eng.slab_thickness(p, support).alias("slab"), eng.slab_thickness(p, support, True).alias("slab_euro"), eng.lap_length(q, 420.0, 30.0).alias("lap"), eng.lap_length(q, 500.0, 30.0, True).alias("lap_euro"),
        eng.steel_tension(p, p * 0.9).alias("tension"), eng.steel_tension(p, p * 0.9, euro=True).alias("tension_euro"), eng.bolt_shear(q, s).alias("bolt"), eng.bolt_shear(q, s, euro=True).alias("bolt_euro"),
        eng.weld(s, q).alias("weld"), eng.weld(s, q, euro=True).alias("weld_euro"), eng.column_axial(p, q, 30.0, 420.0, F.col("l_linenumber") % 2 == 0).alias("axial"),
        eng.masonry_axial(10.0, p, F.lit(3000.0), q * 10).alias("wall"),
    )


@query(
    "calculators_materials",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, sqrt(q * 2.25e9) AS elasticity, sqrt(q * 0.576) AS rupture, 1e3 / ((0.3 + s / 20) + 0.317460317460317460 + 0.749063670411985 + 1.574803149606299) AS cement,
    greatest(0, q + 10) * s + (20.0 + 10) * 2 AS maturity, (3 * q + 2 * s + 10) / 100 AS fineness, q + 40 > 70 OR q + 40 - s * 5 > 20 AS cracking, 2.5 * (1 + s * 0.3) / nullif(q, 0) AS uplift,
    greatest(0, ceil((q * 1.25 - 2.5) / 0.75))::BIGINT AS floors, CASE WHEN q > 40 THEN 1.5 WHEN q > 20 THEN 1.2 WHEN q > 5 THEN 0.9 ELSE 0.6 END::DOUBLE AS wells FROM {GRID}""",
)
def calculators_materials(t: Tables) -> DataFrame:
    q, _, s = measures()
    permeability = F.when(q > 40, 0.01).when(q > 20, 0.0005).when(q > 5, 0.00005).otherwise(0.000001)
    return t.lineitem.select(
        *KEYS, eng.elasticity(q).alias("elasticity"), eng.rupture_modulus(q).alias("rupture"), eng.cement_content(0.3 + s / 20).alias("cement"), eng.maturity(F.array(q, F.lit(20.0)), F.array(s, F.lit(2.0))).alias("maturity"),
        eng.fineness_modulus(F.array(q, s, F.lit(10.0))).alias("fineness"), eng.cracking_risk(q + 40, s * 5).alias("cracking"), eng.uplift_safety(q, F.lit(1.0), s).alias("uplift"),
        eng.floors_to_stop(q, F.lit(1.0)).alias("floors"), eng.well_spacing(permeability).alias("wells"),
    )


@query(
    "calculators_lifting",
    f"""WITH c AS (SELECT *, [25, 30, 50, 100, 200, 300, 500] AS sizes, [8000, 10000, 18000, 30000, 70000, 120000, 200000] AS rates FROM {GRID}), d AS (SELECT *, list_transform(sizes, lambda c: abs(q * 12 - c)) AS offs FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, (q + 0.5) * 125 / nullif(s * 10, 0) AS erection, ceil(p / (q * 0.65 * 1482))::BIGINT AS cranes, rates[list_position(offs, list_min(offs))]::INTEGER AS hire,
    CASE WHEN q > s THEN p * 100 / (q - s) END AS lift, CASE WHEN p / (q * s) - 18 > 0 THEN 500 / (p / (q * s) - 18) END AS bearing, 25 * 0.75 / 1.2 * power(s, 2) AS prestress, CASE l_linenumber % 3 WHEN 0 THEN 4.8 WHEN 1 THEN 9.6 ELSE 14.4 END * q AS scaffold,
    q / 5 AS scan, CASE (l_linenumber % 3 + 2) * 100 WHEN 200 THEN 50 WHEN 300 THEN 25 ELSE 6 END::DOUBLE AS clash, tan(radians(30)) / tan(radians(q + 1)) AS slope FROM d WHERE q > 0""",
)
def calculators_lifting(t: Tables) -> DataFrame:
    q, p, s = measures()
    return t.lineitem.where("l_quantity > 0").select(
        *KEYS, eng.erection_use(q, s * 10).alias("erection"), eng.cranes_needed(p, q).alias("cranes"), eng.crane_hire(q * 12).alias("hire"), eng.lift_use(q, s, p).alias("lift"),
        eng.bearing_safety(p, q, s, 500.0, 1.0).alias("bearing"), eng.prestress(s, F.lit(0.3)).alias("prestress"), eng.scaffold_capacity(q, PICK(tuple(eng.DUTIES), "l_linenumber")).alias("scaffold"),
        eng.scan_accuracy(q).alias("scan"), eng.clash_tolerance((F.col("l_linenumber") % 3 + 2) * 100).alias("clash"), eng.slope_safety(F.lit(30.0), q + 1).alias("slope"),
    )


GRADES = ("C20", "c25", "C30", "C35", "c40", "C99")


@query(
    "calculators_quantities",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, 1.05 * s * (q + q / 2) / 2 * 2 AS trench, q * 2000 / 150 * 7850 * 3.141592653589793 * power(s + 5, 2) / 4e6 AS mesh, greatest(0, q * 3 - s * 1.89) AS paint, q / 10 * s * 1.2 + q * 7 AS cost,
    q * CASE l_linenumber % 6 WHEN 0 THEN 260 WHEN 1 THEN 290 WHEN 2 THEN 320 WHEN 3 THEN 350 WHEN 4 THEN 390 ELSE 320 END AS carbon, CASE WHEN q * 2 >= 80 THEN 'Platinum' WHEN q * 2 >= 60 THEN 'Gold' WHEN q * 2 >= 50 THEN 'Silver' WHEN q * 2 >= 40 THEN 'Certified' ELSE 'Not certified' END AS level,
    abs(p - 1000 * q) * 1.25 AS haul, p * ((2600 * 1.1 + 369 + 269.2) * 1.18 / 0.85) AS rebar, (9.1666666666666667 + 2.15 * s + 36.9 + 134.6 / 30) * 1.18 / 0.85 AS formwork,
    (ceil(p / 35000) + ceil(q / 2500) + ceil(p / 20000))::BIGINT AS staff FROM {GRID} WHERE q > 0 AND p > 0""",
)
def calculators_quantities(t: Tables) -> DataFrame:
    q, p, s = measures()
    return t.lineitem.where("l_quantity > 0 AND l_extendedprice > 0").select(
        *KEYS, eng.trapezoid_volume(s, q, q / 2, F.lit(2.0)).alias("trench"), eng.mesh_mass(q, F.lit(150.0), s + 5).alias("mesh"), eng.wall_paint(q, F.lit(3.0), s).alias("paint"),
        eng.line_cost(q, F.lit(10.0), s, F.lit(7.0), 0.2).alias("cost"), eng.carbon_by_grade(q, PICK(GRADES, "l_linenumber")).alias("carbon"), eng.certificate(q * 2).alias("level"),
        eng.haul(p, q * 1000).alias("haul"), (p * eng.rebar_price()).alias("rebar"), eng.formwork_price(s).alias("formwork"), eng.supervisors(p, q, p).alias("staff"),
    )
