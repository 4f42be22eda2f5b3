"""Bills of quantities: lines, totals, checks, rates and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schedule import cut

def section_totals(lines: DataFrame, section: str = "section", total: str = "total_cost") -> DataFrame:
    """(section, n_lines, section_total, share_pct) of each section; share_pct is null where all totals are 0."""
    sums = lines.groupBy(section).agg(F.count("*").alias("n_lines"), F.sum(total).alias("section_total"))
    everything = F.sum("section_total").over(Window.partitionBy())  # one row per section
    return sums.withColumn("share_pct", F.try_divide(F.col("section_total") * 100, everything))


def row_filter(lines: DataFrame, description: str, quantity: str) -> DataFrame:
    """Lines with a description and a quantity other than zero."""
    return lines.where((F.trim(F.coalesce(F.col(description), F.lit(""))) != "") & (F.coalesce(F.col(quantity), F.lit(0)) != 0))


def work_key(description: str) -> Column:
    """Description in lower case with runs of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.col(description)), "[^a-z0-9]+", " "))


def merge_lines(lines: DataFrame, description: str, quantity: str, total: str, order: list[str]) -> DataFrame:
    """One line for each work key: quantities and totals summed, the first line's unit cost kept."""
    first = F.min_by("unit_cost", F.struct(*order))
    return lines.groupBy(work_key(description).alias("work")).agg(
        F.count("*").alias("n_lines"), F.sum(quantity).alias("quantity"), F.sum(total).alias("total_cost"), first.alias("unit_cost")
    )


#: Approximate quantiles are off by one in ACCURACY of a group's rows at most; exact ones are sought NEAR of these steps around.
ACCURACY, NEAR = 2000, 4


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], count: str | None = None, least: int = 1, places: dict[str, float] | None = None) -> DataFrame:
    """Interpolated quantiles of each group, exactly, and n; ``shares`` tells which by name. Null values don't count but in ``count="*"``.

    ``places`` names values at the index floor(share * n), the last at most, which are not interpolated; all are found at once.

    Approximate quantiles bracket each place in a first pass, whatever the values. The second counts what lies below
    each bracket, and each value inside one: everything else is added up where it is read. Only the values inside, less
    than a hundredth of a large group, are put in order.
    """
    groups = [f"__{c}" for c in by]
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]
    plain = rows.select(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.col(value).alias("__v"))
    interpolated, shares = set(shares), shares | (places or {})
    near = NEAR / ACCURACY
    around = [x for s in shares.values() for x in (max(0.0, s - near), min(1.0, s + near))]
    sizes = plain.groupBy(*groups).agg(F.count("__v").alias("__n"), F.count("*").alias("__all"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.percentile_approx("__v", around, ACCURACY).alias("__cuts"))
    n = F.col("__all") if count == "*" else F.col("__n")
    sizes = cut(sizes.where(n >= least))
    names = list(shares)
    # Of a small group all values are inside.
    edge = lambda end, at: F.when(F.col("__n") <= ACCURACY, F.col(end)).otherwise(F.col("__cuts")[at])
    low, high = ({s: edge(end, 2 * i + k) for i, s in enumerate(names)} for k, end in enumerate(("__low", "__high")))
    inside = F.greatest(*((F.col("__v") >= low[s]) & (F.col("__v") <= high[s]) for s in names), F.lit(False))
    met = plain.where("__v IS NOT NULL").alias("c").join(sizes.alias("s"), same("c", "s")).select("c.*", "s.__n", "s.__cuts", "s.__low", "s.__high").withColumn("__in", F.when(inside, F.col("__v")))
    below = [F.sum((F.col("__v") < low[s]).cast("long")).alias(f"__b{i}") for i, s in enumerate(names)]
    # Numbers only, so that rows are added up as they are read: with an array among the sums Spark would sort all of them.
    counted = met.groupBy(*groups, "__in").agg(F.count("*").alias("__k"), *below)
    counted = counted.alias("c").join(F.broadcast(sizes).alias("s"), same("c", "s")).select("c.*", "s.__n", "s.__cuts", "s.__low", "s.__high")
    whole = Window.partitionBy(*groups)
    picks = []
    ranked = counted
    for i, s in enumerate(names):
        running = F.sum(F.when(F.col("__in") >= low[s], F.col("__k"))).over(whole.orderBy("__in"))
        ranked = ranked.withColumn(f"__u{i}", running + F.sum(f"__b{i}").over(whole)).withColumn(f"__w{i}", F.sum(f"__b{i}").over(whole))
        at = (F.col("__n") - 1) * F.lit(float(shares[s])) if s in interpolated else F.least(F.floor(F.col("__n") * F.lit(float(shares[s]))), F.col("__n") - 1)
        upto = F.when((F.col("__in") >= low[s]) & (F.col(f"__w{i}") <= F.floor(at)), F.col(f"__u{i}"))
        pick = lambda where, upto=upto: F.min(F.when(upto > where, F.col("__in")))
        first, second = pick(F.floor(at)), pick(F.ceil(at))
        weight = F.max(at - F.floor(at))
        exact = F.when(weight == 0, first).otherwise(first * (1 - weight) + second * weight) if s in interpolated else first
        picks.append(F.when(second.isNull(), F.raise_error(F.lit("a bracket of approximate quantiles misses its place"))).otherwise(exact).alias(s))
    found = ranked.where("__in IS NOT NULL").groupBy(*groups).agg(*picks)
    joined = sizes.alias("s").join(found.alias("f"), same("s", "f"), "left")
    out = joined.select(*(F.col(f"s.{g}").alias(c) for g, c in zip(groups, by, strict=True)), n.alias("n"), *(F.col(f"f.{s}") for s in names), F.col("s.__low").alias("low"), F.col("s.__high").alias("high"))
    return out if count is None else out.drop("low", "high")


def rate_cards(lines: DataFrame, cards: dict[tuple[str, ...], int], rate: str) -> list[DataFrame]:
    """The median ``rate`` by each tuple of columns, of groups with so many lines; the lines are read once for all."""
    kept = cut(lines.select(*dict.fromkeys(c for by in cards for c in by), rate))
    return [exact_quantiles(kept, list(by), rate, {"rate": 0.5}, count="*", least=least).drop("n") for by, least in cards.items()]


def unit_rates(lines: DataFrame, by: list[str], rate: str, least: int = 2) -> DataFrame:
    """n, median, quartiles, lowest and highest rate of each group with ``least`` rates or more."""
    return exact_quantiles(lines, by, rate, {"p25": 0.25, "median": 0.5, "p75": 0.75}, least=least)


def tiered_price(lines: DataFrame, exact: DataFrame, by_category: DataFrame, by_section: DataFrame) -> DataFrame:
    """Rate of each line: its section and category's, else its category's, else its section's, else none; and which."""
    priced = (
        lines.join(exact.withColumnRenamed("rate", "rate_1"), ["section", "category"], "left")
        .join(by_category.withColumnRenamed("rate", "rate_2"), "category", "left")
        .join(by_section.withColumnRenamed("rate", "rate_3"), "section", "left")
    )
    source = F.when(F.col("rate_1").isNotNull(), "exact").when(F.col("rate_2").isNotNull(), "category").when(F.col("rate_3").isNotNull(), "section").otherwise("no rate")
    return priced.withColumn("rate", F.coalesce("rate_1", "rate_2", "rate_3")).withColumn("rate_source", source).drop("rate_1", "rate_2", "rate_3")


def line_flags(lines: DataFrame, quantity: str, rate: str, total: str, share: float = 0.001, absolute: float = 0.5) -> DataFrame:
    """``lines`` with ``flag``: 'zero' for suspicious zeros, 'mismatch' where quantity times rate is not the total, else 'ok'."""
    product = F.col(quantity) * F.col(rate)
    off = F.abs(product - F.col(total))
    wrong = (off > absolute) & (F.try_divide(off, F.greatest(F.abs(product), F.abs(F.col(total)))) > share)
    zero = (F.col(quantity) == 0) | (F.col(rate) == 0)
    return lines.withColumn("flag", F.when(zero, "zero").when(wrong, "mismatch").otherwise("ok"))


def variance(actual: Column, expected: Column) -> Column:
    """Difference in percent of what was expected; null where that is 0."""
    return F.try_divide((actual - expected) * 100, expected)


def severity(percent: Column, threshold: float) -> Column:
    return F.when(F.abs(percent) > 2 * threshold, "high").when(F.abs(percent) > threshold, "medium").otherwise("low")
