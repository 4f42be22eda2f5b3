"""What the text of a drawing tells: tables of dimensions, rooms, and the ranges that values are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers of tables of dimensions, words and currencies of tables of costs, and numbers with units of length, area, volume or count.
DIMENSION_HEADERS = [
    r"\bitem\b.*\bdescription\b.*\bqty\b|\bquantity\b",
    r"\bitem\b.*\bdescription\b.*\bunit\b",
    r"\bno\.?\b.*\bdescription\b.*\bqty\b|\bquantity\b",
    r"\bmark\b.*\bdescription\b.*\bqty\b|\bquantity\b",
    r"\bdrawing\s+no\b.*\bdescription\b",
    r"\bitem\s+no\b.*\bsize\b.*\bunit\b",
    r"\bdescription\b.*\bnumber\b.*\blength\b",
    r"\bmaterial\b.*\bsize\b.*\bqty\b|\bquantity\b",
]
COST_WORDS = [
    r"\brate\b", r"\bprice\b", r"\bcost\b", r"\bamount\b", r"\btotal\b.*\bprice\b|\bprice\b.*\btotal\b", r"\bunit\s+rate\b", r"\bsum\b", r"\bvalue\b",
    r"\bBOQ\b", r"\bbill\s+of\s+quantities\b", r"\bpayment\b", r"\binterim\b.*\bcertificate\b",
]
MEASURED = r"\b\d+(?:\.\d+)?\s*(?:mm|cm|m|km|m2|m3|kg|t|ton|nos?|ea|lm)\b"
PRICED = r"(?:SAR|USD|EUR|AED|QAR|BHD|OMR|KWD|\$)\s*\d+"
#: From this score on a text is a table of dimensions.
LEAST_SCORE = 3


def dimension_score(text: Column) -> Column:
    """How much a text looks like a table of dimensions; 0 where it speaks of costs.

    A header counts 3, numbers with units 2 where they are more than 15 % of the words and 1 from three on, and two lines
    with bars 1.
    """
    text = F.coalesce(text, F.lit(""))
    any_of = lambda patterns: reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in patterns))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    measured = F.regexp_count(text, F.lit(f"(?i){MEASURED}"))
    density = F.when(F.try_divide(measured, words) > 0.15, 2).when(measured >= 3, 1).otherwise(0)
    bars = F.when(F.size(F.filter(F.split(text, "\n"), lambda x: x.contains("|"))) >= 2, 1).otherwise(0)
    score = F.when(any_of(DIMENSION_HEADERS), 3).otherwise(0) + density + bars
    return F.when(any_of([*COST_WORDS, PRICED]), 0).otherwise(score)


# How a room is written, name and two sides in metres, and how short and long its sides can be.
ROOM = r"([A-Za-z][A-Za-z0-9 &/.\-]{1,30}?)\s*(\d{1,2}\.\d{2})\s*[Xx]\s*(\d{1,2}\.\d{2})"
LEAST_M, MOST_M = 0.6, 60.0


def rooms(text: Column) -> Column:
    """(name, width, depth, area, perimeter) of the rooms that a drawing's text names; sides out of bounds are no rooms."""
    flat = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    part = lambda i: F.regexp_extract_all(flat, F.lit(ROOM), F.lit(i))
    read = F.transform(
        F.arrays_zip(part(1).alias("name"), part(2).alias("w"), part(3).alias("d")),
        lambda r: F.struct(F.regexp_replace(r["name"], r"^[ \-.&/]+|[ \-.&/]+$", "").alias("name"), r.w.cast("decimal(6,2)").alias("width"), r.d.cast("decimal(6,2)").alias("depth")),
    )
    kept = F.filter(read, lambda r: (r["name"] != "") & r.width.between(LEAST_M, MOST_M) & r.depth.between(LEAST_M, MOST_M))
    # Sides have two digits, so products are exact as decimals.
    of = lambda x: F.round(x, 2).cast("double")
    return F.transform(kept, lambda r: F.struct(r["name"].alias("name"), of(r.width).alias("width"), of(r.depth).alias("depth"), of(r.width * r.depth).alias("area"), of(2 * (r.width + r.depth)).alias("perimeter")))


def metric(unit: Column, material: Column) -> Column:
    """The range that a value with this unit of this material is held against; null where none is known."""
    u, m = F.lower(F.trim(unit)), F.coalesce(F.lower(F.trim(material)), F.lit(""))
    tight = F.replace(u, F.lit(" "), F.lit(""))
    per = lambda *ends: reduce(lambda a, b: a | b, (tight.endswith(e) for e in ends))
    metal, mass = m.isin("steel", "rebar"), m.isin("concrete", "excavation")
    known = [
        (per("/m3", "/m**3", "/cubicmeter") & mass, "rate_usd_per_m3"),
        (per("/kg") & metal, "rate_usd_per_kg"),
        (per("/m2", "/m**2") & (m == "formwork"), "rate_usd_per_m2"),
        (u.isin("kg", "kilogram", "kilograms") & metal, "weight_kg"),
        (u.isin("m3", "m**3", "cubicmeter", "cubic_meter", "cubic meters") & mass, "volume_m3"),
        (u.isin("m2", "m**2", "squaremeter", "square_meter", "square meters") & (m == "formwork"), "area_m2"),
        (u.isin("m", "meter", "meters") & (m == "rebar"), "length_m"),
        (u.isin("mpa", "megapascal") & (m == "concrete"), "compressive_mpa"),
        (u.isin("celsius", "deg c", "°c") | u.endswith("degc"), "temperature_degc"),
        (u.isin("%", "percent", "pct"), "percent"),
    ]
    return F.coalesce(*(F.when(holds, name) for holds, name in known))
