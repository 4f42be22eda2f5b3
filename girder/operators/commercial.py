"""Commercial control: earned value, payment, cash flow, tenders, risk and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earned_value(budget: Column, planned: Column, earned: Column, actual: Column) -> list[Column]:
    """CPI, SPI, EAC, ETC, VAC, CV, SV and a traffic light; nothing is rounded on the way, nulls where a divisor is 0."""
    cpi, spi = F.try_divide(earned, actual), F.try_divide(earned, planned)
    eac = F.try_divide(budget, cpi)
    least = F.least(cpi, spi)
    light = F.when(least.isNull(), "unknown").when(least >= 0.95, "green").when(least >= 0.85, "amber").otherwise("red")
    named = {"cpi": cpi, "spi": spi, "eac": eac, "etc": eac - actual, "vac": budget - eac, "cv": earned - actual, "sv": earned - planned, "light": light}
    return [column.alias(name) for name, column in named.items()]


def payments(claims: DataFrame, contract: str, order: list[str], gross: str, retention: float, recovery: float, advance: Column) -> DataFrame:
    """``claims`` with the retention, the advance recovered and the net sum of each contract's claims in order.

    Recovery is a share of the running gross claim until the advance is paid back; each claim bears its rise.
    Running sums are taken of ``gross`` as it is, so give it as a decimal.
    """
    w = Window.partitionBy(contract).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own, run = F.col(gross), F.sum(gross).over(w)
    back = lambda total: F.least(total.cast("double") * recovery, advance)
    out = claims.withColumn("retained", own.cast("double") * retention).withColumn("recovered", back(run) - back(run - own))
    return out.withColumn("net", own.cast("double") - F.col("retained") - F.col("recovered"))


def tender_statistics(bids: DataFrame, package: str, price: str) -> DataFrame:
    """n, lowest, mean and highest bid of each package, with the spread in percent of the lowest."""
    low, high = F.min(price), F.max(price)
    return bids.groupBy(package).agg(F.count(price).alias("n"), low.alias("low"), F.avg(price).alias("mean"), high.alias("high"), F.try_divide((high - low) * 100, low).alias("spread_pct"))


def correction_fit(pairs: DataFrame, by: str, computed: str, actual: str) -> DataFrame:
    """Scale and bias of the straight line from computed to actual values of each group, its mean error in percent of the mean, and a tier.

    Two aggregations: the line, then the errors around it. Groups without two different computed values get a scale of 1.
    """
    line = pairs.groupBy(by).agg(F.regr_slope(actual, computed).alias("slope"), F.avg(computed).alias("x"), F.avg(actual).alias("y"))
    line = line.withColumn("scale", F.coalesce("slope", F.lit(1.0))).withColumn("bias", F.col("y") - F.col("scale") * F.col("x"))
    error = F.abs(F.col(actual) - F.col(computed) * F.col("scale") - F.col("bias"))
    fitted = pairs.join(line, by).groupBy(by, "scale", "bias", "y").agg(F.count("*").alias("n"), F.avg(error).alias("error"))
    share = F.try_divide("error", F.abs("y"))
    tier = F.when((F.col("n") >= 50) & (share <= 0.1), "trusted").when(F.col("n") >= 10, "provisional").otherwise("unproven")
    return fitted.select(by, "n", "scale", "bias", share.alias("error_share"), tier.alias("tier"))
