"""Engineering and commercial calculators as columns: each takes and returns columns, so that they run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steel and water, the share of live load that is never taken off, and embodied carbon by grade.
STEEL_KG_M3 = 7850.0
GRAVITY = 9.81
PI = 3.141592653589793


def beam_moment_udl(w: Column, span: Column) -> Column:
    """Largest moment of a simple beam under an even load."""
    return w * span * span / 8


def beam_moment_point(load: Column, span: Column, left: Column) -> Column:
    return F.try_divide(load * left * (span - left), span)


def beam_shear(w: Column, span: Column, point: Column) -> Column:
    return w * span / 2 + point / 2


def fixed_beam_support_moment(w: Column, span: Column) -> Column:
    return w * span * span / 12


def fixed_beam_middle_moment(w: Column, span: Column) -> Column:
    return w * span * span / 24


def deflection_simple(w: Column, span_mm: Column, modulus: Column, inertia: Column) -> Column:
    return F.try_divide(5 * w * span_mm * span_mm * span_mm * span_mm, 384 * modulus * inertia)


def deflection_cantilever(w: Column, span_mm: Column, modulus: Column, inertia: Column) -> Column:
    return F.try_divide(w * span_mm * span_mm * span_mm * span_mm, 8 * modulus * inertia)


def shear_stress(force_kn: Column, breadth_mm: Column, depth_mm: Column) -> Column:
    return F.try_divide(force_kn * 1000, breadth_mm * depth_mm)


def rc_beam_moment(steel_mm2: Column, fy: Column, width_mm: Column, depth_mm: Column, fc: Column) -> Column:
    """Nominal moment in kNm: steel force times the lever arm above half the stress block."""
    block = F.try_divide(steel_mm2 * fy, 0.85 * fc * width_mm)
    return steel_mm2 * fy * (depth_mm - block / 2) / 1e6


def bearing_pressure(load_kn: Column, width_m: Column, length_m: Column) -> Column:
    return F.try_divide(load_kn, width_m * length_m)


def cylinder_strength(load_kn: Column, diameter_mm: Column) -> Column:
    return F.try_divide(load_kn * 1000, PI * diameter_mm * diameter_mm / 4)


def shrinkage_at(days: Column, ultimate: Column, constant: Column) -> Column:
    return F.try_divide(days, constant + days) * ultimate


def curing_days(fraction: Column, a: Column, b: Column) -> Column:
    """When strength reaches ``fraction``: the inverse of t / (a + b t); null where it never does."""
    return F.when(fraction * b < 1, a * fraction / (1 - b * fraction))


def fall_arrest_force(mass_kg: Column, fall_m: Column, stop_m: Column) -> Column:
    return mass_kg * GRAVITY * (1 + F.try_divide(fall_m, stop_m)) / 1000


def rebar_weight(diameter_mm: Column, length_m: Column, bars: Column) -> Column:
    return PI / 4 * (diameter_mm / 1000) * (diameter_mm / 1000) * STEEL_KG_M3 * length_m * bars


def excavation_volume(length: Column, width: Column, depth: Column, bulking: Column) -> Column:
    return length * width * depth * bulking


def backfill_volume(excavated: Column, structure: Column, swell: Column) -> Column:
    return (excavated - structure) * swell


def compaction_percent(field: Column, most: Column) -> Column:
    return F.try_divide(field * 100, most)


def roi(gain: Column, cost: Column) -> Column:
    return F.try_divide(gain - cost, cost)


def cost_per_area(cost: Column, area: Column) -> Column:
    return F.try_divide(cost, area)


def productivity(output: Column, hours: Column) -> Column:
    return F.try_divide(output, hours)


def duration_days(man_hours: Column, crew: Column, hours: Column) -> Column:
    """Whole days for the man-hours, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.try_divide(man_hours, crew * hours)))


def risk_band(probability: Column, impact: Column) -> Column:
    score = probability * impact
    return F.when(score <= 4, "green").when(score <= 9, "amber").otherwise("red")


def price_score(price: Column, least: Column, mean: Column) -> Column:
    """100 for the lowest price, 80 up to the mean, 60 up to a tenth above it, else 40."""
    return F.when(price <= least, 100).when(price <= mean, 80).when(price <= mean * 1.1, 60).otherwise(40)
