"""More calculators as columns: loads, members, mixes, lifting, takeoffs and prices. ``euro`` tells a European code from an American one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .works import lookup

# Span-to-depth ratios by support, scaffold duties, embodied carbon by grade, clash tolerances by level of detail, hire a month by crane capacity.
RATIOS = {"simply_supported": 20.0, "one_end_continuous": 24.0, "both_ends_continuous": 28.0, "cantilever": 10.0}
EURO_RATIOS = {"simply_supported": 20.0, "one_end_continuous": 26.0, "both_ends_continuous": 30.0, "cantilever": 8.0}
DUTIES = {"light": 1.2, "medium": 2.4, "heavy": 3.6}
CARBON = {"c20": 260.0, "c25": 290.0, "c30": 320.0, "c35": 350.0, "c40": 390.0}
CLASH_MM = {200: 50.0, 300: 25.0, 350: 12.0, 400: 6.0, 500: 3.0}
CRANES = {25: 8000, 30: 10000, 50: 18000, 100: 30000, 200: 70000, 300: 120000, 500: 200000}


def wind_pressure(speed: Column, euro: bool = False) -> Column:
    """Velocity pressure in Pa, with a directionality of 0.85 in the American code and air of 1.25 kg/m3 in the European."""
    return speed * speed * (0.625 if euro else 0.613 * 0.85)


def base_shear(weight: Column, euro: bool = False) -> Column:
    return weight * (0.3 * 1.2 * 2.5 / 3.9 * 0.85 if euro else 1.0 / 8.0)


def live_load(load: Column, area: Column, kll: float = 2.0, least: float = 0.5) -> Column:
    """Live load reduced by the area of influence from 37.2 m2 on, to ``least`` of it at most."""
    influence = area * kll
    return load * F.when(influence < 37.2, 1.0).otherwise(F.greatest(F.lit(least), 0.25 + 4.57 / F.sqrt(influence)))


def beam_moment(steel: Column, fy: float, width: float, depth: float, fc: float, euro: bool = False) -> Column:
    """Design moment in kNm."""
    force = steel * (fy / 1.15 if euro else fy)
    block = force / ((0.8 * fc / 1.5 if euro else 0.85 * fc) * width)
    return force * (depth - block * (0.4 if euro else 0.5)) * (1.0 if euro else 0.9) / 1e6


def beam_shear(width: Column, depth: Column, fc: float, euro: bool = False, rho: float = 0.01) -> Column:
    """Shear that concrete takes in kN."""
    if euro:
        return F.least(1 + F.sqrt(200 / depth), F.lit(2.0)) * width * depth * (0.12 * (100 * min(rho, 0.02) * fc) ** (1 / 3)) / 1000
    return width * depth * (0.1275 * math.sqrt(fc)) / 1000


def slab_thickness(span: Column, support: Column, euro: bool = False, fy: float = 420.0) -> Column:
    return span / F.coalesce(lookup(EURO_RATIOS if euro else RATIOS, support), F.lit(20.0)) * (1.0 if euro else 0.4 + fy / 700)


def lap_length(bar: Column, fy: float, fc: float, euro: bool = False, confinement: float = 1.5) -> Column:
    if euro:
        return bar * (1.5 * (fy / 1.15) / (4 * 2.25 * 0.7 * 0.3 * fc ** (2 / 3) / 1.5))
    return bar * (1.3 * fy / (1.1 * math.sqrt(fc) * min(confinement, 2.5)))


def steel_tension(gross: Column, net: Column, fy: float = 345.0, fu: float = 450.0, euro: bool = False) -> Column:
    """The lesser of yield and rupture in kN."""
    return F.least(gross * (fy if euro else 0.9 * fy), net * (0.72 * fu if euro else 0.75 * fu)) / 1000


def bolt_shear(area: Column, planes: Column, strength: float = 372.0, euro: bool = False) -> Column:
    return area * planes * (0.6 * strength / 1.25 if euro else 0.75 * strength) / 1000


def weld(leg: Column, length: Column, strength: float = 490.0, euro: bool = False) -> Column:
    return leg * length * (0.707 * (strength / (math.sqrt(3) * 0.9 * 1.25) if euro else 0.45 * strength)) / 1000


def column_axial(gross: Column, steel: Column, fc: float, fy: float, spiral: Column) -> Column:
    """Design load of a short column in kN."""
    squash = 0.85 * fc * (gross - steel) + fy * steel
    return squash * F.when(spiral, 0.75 * 0.85).otherwise(0.65 * 0.80) / 1000


def masonry_axial(strength: float, area: Column, height: Column, thickness: Column) -> Column:
    """Allowed load of an unreinforced wall in kN, by two branches of slenderness."""
    slender = height * math.sqrt(12) / thickness
    return 0.25 * strength * area * F.when(slender <= 99, 1 - (slender / 140) * (slender / 140)).otherwise((70 / slender) * (70 / slender)) / 1000


def elasticity(fck: Column) -> Column:
    return 15000 * F.sqrt(fck * 10)


def rupture_modulus(fck: Column) -> Column:
    return 0.24 * F.sqrt(fck * 10)


def cement_content(water_cement: Column, fine: float = 2.0, coarse: float = 4.0) -> Column:
    """kg of cement in a cubic metre by absolute volumes."""
    return 1000 / (water_cement + 1 / 3.15 + fine / 2.67 + coarse / 2.54)


def maturity(temperatures: Column, hours: Column, datum: float = -10.0) -> Column:
    """Degree hours above the datum."""
    return F.aggregate(F.zip_with(temperatures, hours, lambda t, h: F.greatest(F.lit(0.0), t - datum) * h), F.lit(0.0), lambda a, x: a + x)


def fineness_modulus(retained: Column) -> Column:
    """Cumulative percentages retained, summed, over a hundred."""
    n = F.size(retained)
    return F.aggregate(F.transform(retained, lambda x, i: x * (n - i)), F.lit(0.0), lambda a, x: a + x) / 100


def cracking_risk(core: Column, surface: Column) -> Column:
    return (core > 70) | (core - surface > 20)


def uplift_safety(water: Column, raft: Column, floors: Column, floor: float = 0.3, unit_weight: float = 2.5) -> Column:
    return F.try_divide(unit_weight * (raft + floors * floor), water)


def floors_to_stop(water: Column, raft: Column, floor: float = 0.3, unit_weight: float = 2.5, safety: float = 1.25) -> Column:
    return F.greatest(F.lit(0), F.ceil((water * safety - raft * unit_weight) / (floor * unit_weight))).cast("long")


def well_spacing(permeability: Column) -> Column:
    return F.when(permeability > 0.001, 1.5).when(permeability > 0.0001, 1.2).when(permeability > 0.00001, 0.9).otherwise(0.6)


def formwork_wind_moment(speed: Column, area: Column, height: Column) -> Column:
    """Overturning moment in kNm."""
    return 0.613 * speed * speed * area * height / 2000


def bearing_safety(load: Column, width: Column, length: Column, capacity: float, depth: float = 0.0) -> Column:
    net = load / (width * length) - depth * 18
    return F.when(net > 0, capacity / net)


def erection_use(beam: Column, crane: Column, rigging: float = 0.5, dynamic: float = 1.25) -> Column:
    return F.try_divide((beam + rigging) * dynamic * 100, crane)


def cranes_needed(demand: Column, capacity: Column, use: float = 65.0, shifts: int = 2, hours: float = 9.5, minutes: float = 20.0, days: int = 26) -> Column:
    return F.ceil(demand / (capacity * (use / 100) * (60 / minutes * hours * shifts * days))).cast("long")


def crane_hire(capacity: Column) -> Column:
    """Hire a month of the crane whose capacity is nearest; of two as near the smaller."""
    near = F.array_min(F.array(*(F.struct(F.abs(capacity - c).alias("off"), F.lit(c).alias("c"), F.lit(rate).alias("rate")) for c, rate in CRANES.items())))
    return near["rate"]


def rebar_price(material: float = 2600, labour: float = 90 * 4.1, crane: float = 2 * 134.6, waste: float = 0.1, indirect: float = 0.18, markup: float = 0.15) -> float:
    """Selling price a tonne."""
    return (material * (1 + waste) + labour + crane) * (1 + indirect) / (1 - markup)


def formwork_price(cycle_days: Column, indirect: float = 0.18, markup: float = 0.15) -> Column:
    """Selling price a square metre."""
    return (55 / 6 + 2.15 * cycle_days + 9 * 4.1 + 134.6 / 30) * ((1 + indirect) / (1 - markup))


def supervisors(concrete: Column, steel: Column, area: Column) -> Column:
    parts = ((concrete, 35000), (steel, 2500), (area, 20000))
    return sum((F.when(q > 0, F.ceil(q / of)).otherwise(0) for q, of in parts), F.lit(0)).cast("long")


def prestress(span: Column, thickness: Column, eccentricity: float = 0.15) -> Column:
    """Tendon force in kN that balances three quarters of a slab's own weight."""
    return thickness * 25 * 0.75 * span * span / (8 * eccentricity * thickness)


def trapezoid_volume(length: Column, top: Column, bottom: Column, depth: Column, waste: float = 0.05) -> Column:
    return (top + bottom) / 2 * depth * length * (1 + waste)


def mesh_mass(area: Column, spacing: Column, bar: Column, ways: int = 2) -> Column:
    """kg of bars ``spacing`` mm apart over an area."""
    return area * (1000 / spacing) * ways * (math.pi / 4 * 7850 / 1e6) * bar * bar


def wall_paint(perimeter: Column, height: Column, doors: Column, door: float = 2.1 * 0.9, windows: float = 0.0) -> Column:
    return F.greatest(perimeter * height - doors * door - windows, F.lit(0.0))


def line_cost(quantity: Column, output: Column, day_rate: Column, material: Column, plant: float = 0.0) -> Column:
    """Labour by output a day, plant as a part of it, and material."""
    return quantity / output * day_rate * (1 + plant) + quantity * material


def carbon_by_grade(volume: Column, grade: Column) -> Column:
    return volume * F.coalesce(lookup(CARBON, F.lower(grade)), F.lit(320.0))


def certificate(points: Column) -> Column:
    return F.when(points >= 80, "Platinum").when(points >= 60, "Gold").when(points >= 50, "Silver").when(points >= 40, "Certified").otherwise("Not certified")


def scan_accuracy(distance: Column, at_ten: float = 2.0) -> Column:
    return at_ten * distance / 10


def scaffold_capacity(area: Column, duty: Column, safety: float = 4.0) -> Column:
    return F.coalesce(lookup(DUTIES, F.lower(duty)), F.lit(2.4)) * area * safety


def lift_use(chart: Column, deductions: Column, load: Column) -> Column:
    return F.when(chart > deductions, load * 100 / (chart - deductions))


def slope_safety(friction: Column, slope: Column, cohesion: float = 0.0, unit_weight: float = 18.0, depth: float = 0.0) -> Column:
    b = F.radians(slope)
    cohesive = cohesion / (unit_weight * depth * F.sin(b) * F.cos(b)) if cohesion > 0 and depth > 0 else F.lit(0.0)
    return F.tan(F.radians(friction)) / F.tan(b) + cohesive


def haul(cut: Column, fill: Column, bulking: float = 0.25) -> Column:
    return F.abs(cut - fill) * (1 + bulking)


def clash_tolerance(level: Column) -> Column:
    return lookup(CLASH_MM, level.cast("int"))
