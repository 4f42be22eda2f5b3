"""Bills of work into programmes, cash and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import works
from .schedule import cut

CREW, HOURS = 4, 8.0


def programme(lines: DataFrame, norms: dict[str, float], crew: int = CREW, hours: float = HOURS) -> DataFrame:
    """Activities of each bill: (bill, activity, name, category, stage, quantity, n_lines, manhours, days, predecessor).

    ``lines`` has bill, line, description and quantity. Lines of equal description (blanks and case aside) are one activity;
    those without a quantity above zero are left out. Packages are a stage, a place among the trades and a category,
    below ground first; an activity follows the one before it in its package, and a package's first one the last of
    the package before. ``norms`` are man-hours a unit by category; missing_norms() tells which are needed.
    """
    same = F.trim(F.regexp_replace(F.lower(F.trim("description")), r"\s+", " "))
    # Each distinct description is classified once, however many lines have it.
    texts = lines.select("description").distinct().withColumn("category", works.category(same))
    texts = texts.withColumn("stage", works.stage(F.col("description"), F.col("category"))).withColumn("place", works.site_rank(F.col("description"), F.col("category")))
    classes = cut(texts.withColumnRenamed("description", "name"))
    merged = lines.groupBy("bill", same.alias("work")).agg(F.min_by("description", "line").alias("name"), F.min("line").alias("line"), F.sum("quantity").alias("quantity"), F.count("*").alias("n_lines"))
    placed = merged.where("quantity > 0").join(classes, "name")
    package = ["stage", "place", "category"]  # substructure sorts before superstructure
    of_bill, of_package = Window.partitionBy("bill"), Window.partitionBy("bill", *package)
    number = F.concat_ws(".", F.dense_rank().over(of_bill.orderBy(*package)).cast("string"), F.row_number().over(of_package.orderBy("line")).cast("string"))
    numbered = placed.withColumn("activity", number)
    manhours = F.col("quantity") * works.lookup(norms, F.col("category"))
    return numbered.select(
        "bill", "activity", "name", "category", "stage", "quantity", "n_lines",
        manhours.alias("manhours"),
        F.greatest(F.lit(1), F.ceil(manhours / (crew * hours))).cast("long").alias("days"),
        F.lag("activity").over(of_bill.orderBy(*package, "line")).alias("predecessor"),
    )


def missing_norms(lines: DataFrame, norms: dict[str, float]) -> DataFrame:
    """(category, unit, n) of the lines whose category has no norm: what has to be asked for."""
    texts = lines.where("quantity > 0").groupBy("description").agg(F.min("unit").alias("unit"), F.count("*").alias("n"))
    placed = texts.withColumn("category", works.category(F.col("description")))
    return placed.where(~F.col("category").isin(*norms)).groupBy("category").agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))


def planned_share(t: Column) -> Column:
    """The share of the work that is planned to be done at a share of the time."""
    return F.when(t <= 0.25, t * 0.8).when(t <= 0.5, 0.2 + (t - 0.25) * 1.2).when(t <= 0.75, 0.5 + (t - 0.5) * 1.2).otherwise(F.least(F.lit(0.95), 0.8 + (t - 0.75) * 0.6))


def cash_flow(contracts: DataFrame, advance: float = 0.1, retention: float = 0.1) -> DataFrame:
    """(contract, month, progress, value, recovery, held, released, cash) of each month of (contract, amount, months).

    The advance is paid in the first month and recovered in equal parts over the first four fifths of the months.
    Retention is held of each month's value and released once, where progress first reaches 0.95.
    """
    t = lambda m: planned_share(m / F.col("months"))
    monthly = contracts.where("months > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("months").cast("int"))).alias("month"))
    window = F.greatest(F.lit(1), F.floor(F.col("months") * 0.8)).cast("int")
    before = F.when(F.col("month") == 1, 0.0).otherwise(t(F.col("month") - 1))
    full = (t(F.col("month")) >= 0.95) & (before < 0.95)
    value = (t(F.col("month")) - before) * F.col("amount")
    recovery = F.when(F.col("month") <= window, F.col("amount") * advance / window).otherwise(0.0)
    released = F.when(full, t(F.col("month")) * F.col("amount") * retention).otherwise(0.0)
    paid = F.when(F.col("month") == 1, F.col("amount") * advance).otherwise(0.0)
    return monthly.select(
        "contract", "month",
        t(F.col("month")).alias("progress"),
        value.alias("value"),
        recovery.alias("recovery"),
        (value * retention).alias("held"),
        released.alias("released"),
        (value * (1 - retention) + paid - recovery + released).alias("cash"),
    )


# How a prolongation claim is made up.
PROLONGATION = {"site_staff": 0.30, "site_accommodation": 0.20, "plant_standing": 0.25, "insurances_bonds": 0.10, "overheads_profit": 0.15}


def prolongation(events: DataFrame, daily_rate: float) -> DataFrame:
    """(claim, days, mode, total, and its parts) of (claim, days, cost): the costs given, or a rate a day where a claim gives none."""
    sums = events.groupBy("claim").agg(F.sum("days").alias("days"), F.sum("cost").alias("given"))
    total = F.coalesce(F.col("given"), F.col("days") * F.lit(daily_rate))
    parts = [(total * share).alias(name) for name, share in PROLONGATION.items()]
    return sums.select("claim", "days", F.when(F.col("given").isNull(), "daily_rate").otherwise("event_sum").alias("mode"), total.alias("total"), *parts)


def variation_price(direct: Column, kind: Column, overhead: float = 0.10, profit: float = 0.08, prelims: float = 0.15) -> Column:
    """Price of a variation; an omission takes overhead and profit off and has no preliminaries."""
    off = kind == "omission"
    with_prelims = direct * F.when(off, 1.0).otherwise(1 + prelims)
    return with_prelims + with_prelims * F.when(off, -(overhead + profit)).otherwise(overhead + profit)


# The words of each kind of change order, and the allowance for risk by complexity.
CHANGES = {
    "scope_addition": ["add", "extra", "additional", "new work", "extra work"],
    "scope_omission": ["delete", "remove", "omit", "deduct"],
    "design_change": ["redesign", "change spec", "substitution"],
    "site_condition": [" differing site", "unforeseen", "latent", "ground condition"],
    "delay_claim": ["delay", "acceleration", "time extension", "EOT"],
}


def change_kind(text: Column) -> Column:
    """The kind with the most of its words in the text; of equal ones the first, general where there is none."""
    low = F.lower(text)
    hits = [F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(CHANGES.items())]
    best = F.greatest(*hits)
    return F.when(best["n"] > 0, best["kind"]).otherwise("general")


def change_impact(direct: Column, kind: Column, text: Column) -> Column:
    """Direct cost with overhead, profit for additions only, and an allowance by how long the description is."""
    risk = F.when(F.length(text) > 500, 0.20).when(F.length(text) > 200, 0.10).otherwise(0.05)
    return direct * (1.20 + F.when(kind == "scope_addition", 0.10).otherwise(0.0) + risk)


def weighted_tender(bids: DataFrame, weights: dict[str, float], other: float = 0.1) -> DataFrame:
    """``bids`` (tender, bidder, price, days and scores) with price and schedule scores, weighted score, risk and rank.

    A tender's lowest, mean and the like are added up before they are joined, so that a large tender isn't held in one task.
    """
    sums = bids.groupBy("tender").agg(*(f(c).alias(f"{n}_{c}") for c in ("price", "days") for n, f in (("low", F.min), ("sum", F.sum))), F.count("*").alias("bids"))
    both = bids.join(sums, "tender")

    def score(c: str) -> Column:
        mean = F.col(f"sum_{c}").cast("double") / F.col("bids")
        return F.when(F.col(c) <= 0, 50).when(F.col(c) == F.col(f"low_{c}"), 100).when(F.col(c) <= mean, 80).when(F.col(c) <= mean * 1.1, 60).otherwise(40)

    both = both.withColumn("price_score", score("price")).withColumn("schedule_score", score("days"))
    names = {"price": "price_score", "schedule": "schedule_score", "experience": "experience", "financial": "financial", "safety": "safety", "quality": "quality"}
    total = sum((F.col(c) * weights.get(n, other) for n, c in names.items()), F.lit(0.0))
    faults = (F.col("financial") < 60).cast("int") + (F.col("safety") < 70).cast("int") + (F.col("experience") < 50).cast("int")
    risk = F.when(faults >= 2, "high").when(faults == 1, "medium").otherwise("low")
    return both.select("tender", "bidder", "price_score", "schedule_score", F.round(total, 2).alias("score"), risk.alias("risk"))


def measured_quantities(measures: DataFrame, slab: float = 0.15, rebar: float = 120.0) -> DataFrame:
    """(project, floor_area, concrete, steel, concrete_co2, steel_co2) of (project, kind, value): areas and volumes summed and capped, the rest by ratios."""
    area = F.least(F.coalesce(F.sum(F.when(F.col("kind").isin("area", "floor_area"), F.col("value"))), F.lit(0)).cast("double"), F.lit(500_000.0))
    volume = F.coalesce(F.sum(F.when(F.col("kind") == "volume", F.col("value"))), F.lit(0)).cast("double")
    sums = measures.groupBy("project").agg(area.alias("floor_area"), volume.alias("volume"))
    concrete = F.least(F.when(F.col("volume") > 0, F.col("volume")).otherwise(F.col("floor_area") * slab), F.lit(750_000.0))
    return sums.select("project", "floor_area", concrete.alias("concrete"), (concrete * rebar).alias("steel"), (concrete * 250).alias("concrete_co2"), (concrete * rebar * 2.3).alias("steel_co2"))


def deviations(built: DataFrame, design: DataFrame, tolerance: float) -> DataFrame:
    """``built`` (with type and value) with design_value, deviation and severity where it is off by more than ``tolerance`` thousandths.

    Each is held against the first of the design's rows (type, value, seq) of its type; off by over twice that is major.
    First rows are partial minima, so that no window has all rows of a type.
    """
    first = design.groupBy("type").agg(F.min_by("value", "seq").cast("double").alias("design_value"))
    off = F.abs(F.col("value").cast("double") - F.col("design_value"))
    found = built.join(first, "type").where(off > tolerance / 1000)
    return found.withColumn("deviation", F.round(off, 3)).withColumn("severity", F.when(off > tolerance / 500, "major").otherwise("minor"))


def head_counts(spans: DataFrame, length: int, labour: list[str] | None = None) -> DataFrame:
    """(network, period, heads, by_resource): who works in each period of ``length`` days, by the early dates of (network, start, finish, resource, crew).

    An activity's crew counts in each period that it touches; with ``labour`` only these resources do. Crews are
    summed for each resource before the map of a period is made of the sums.
    """
    kept = spans.where(F.col("resource").isin(*labour)) if labour else spans
    last = F.greatest(F.col("start"), F.col("finish") - 1)
    each = kept.withColumn("period", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor(last / length))))
    sums = each.groupBy("network", "period", "resource").agg(F.sum("crew").alias("crew"))
    entries = F.array_sort(F.collect_list(F.struct("resource", "crew")))
    return sums.groupBy("network", "period").agg(F.sum("crew").alias("heads"), F.map_from_entries(entries).alias("by_resource"))
