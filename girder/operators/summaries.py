"""Bills and tables of drawings as retrievable texts, with guards where no figure may be stated; work breakdowns loaded with heads and cost."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of one and the same network of pipes.
SEWERS = ["sewer", "foul", "waste water", "wastewater", "sanitary"]
# What tables on drawings are, in the words of those who ask for them.
TABLES = {
    "rebar_schedule": "reinforcement bar schedule / bar bending schedule (BBS) — bar mark, diameter, length, shape code, quantity",
    "door_schedule": "door schedule — door reference, type, size, fire rating, quantity",
    "window_schedule": "window schedule — window reference, type, size, quantity",
    "finishes_schedule": "room finishes schedule — floor, wall and ceiling finishes",
    "revision_history": "drawing revision history — revision, date, description",
    "legend": "drawing legend / key — symbols and their meanings",
    "general_notes": "drawing general notes",
    "quantities": "quantities table — item, unit, quantity",
    "unclassified": "table",
}
#: Heads for each trade on an activity that states none.
CREW_PER_TRADE = 4
MONEY = "decimal(38,2)"


def words(*parts: Column | str) -> Column:
    """Parts one after the other, nulls as nothing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def bill_chunks(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """(bill, kind, place, text): what a search over bills should find.

    ``bills`` has bill, name, currency and skipped (pages that could not be read; null: none), one row each; ``lines``
    bill, position, section, description, quantity, unit, rate and amount. Kinds: ``total`` (``partial`` where pages
    were skipped, and said to be incomplete), ``sections`` with sums and shares, largest first, ``terms`` where the
    bill has sewers, ``line`` for each line, and ``guard`` for a bill of which no line has an amount: no total may be
    stated. Lines of unknown bills are left out. Lines are moved once, by bill, and summed where they are told: sums
    that were moved by themselves, by bill and section, would be nearly as many as the lines. A bill's lines meet in
    one task, in order, and go to disk beyond its memory.
    """
    sewer = reduce(or_, (F.contains(F.lower("description"), F.lit(w)) for w in SEWERS))
    of_bill = Window.partitionBy("bill").orderBy("section", "position")
    of_section = Window.partitionBy("bill", "section").orderBy("position")
    every = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    amount = F.col("amount").cast(MONEY)
    dealt = lines.select("bill", "position", F.coalesce("section", F.lit("")).alias("section"), "description", "quantity", "unit", "rate", "amount").repartition("bill")
    by_section = dealt.withColumns({"in_section": F.row_number().over(of_section), "sum": F.sum(amount).over(every(of_section))})
    listed = F.when((F.col("in_section") == 1) & F.col("sum").isNotNull(), F.struct((-F.col("sum")).alias("less"), "section", F.col("sum").alias("amount")))
    summed = by_section.withColumns({
        "nth": F.row_number().over(of_bill), "total": F.sum(amount).over(every(of_bill)), "sewer": F.max(F.coalesce(sewer, F.lit(False))).over(every(of_bill)),
        "sections": F.collect_list(listed).over(every(of_bill)),  # a bill's sections are few
    })
    # The first line of a bill also tells the whole of it; so does a bill without lines.
    each = bills.join(summed.drop("in_section", "sum", "section").withColumn("sections", F.when(F.col("nth") == 1, F.col("sections"))), "bill", "left")
    first, there = F.coalesce("nth", F.lit(1)) == 1, F.col("nth").isNotNull()
    cash, named = F.coalesce("currency", F.lit("")), F.coalesce("name", F.lit(""))
    # As decimals of 20 digits, so that a quotient keeps 14 places and isn't rounded twice.
    share = lambda s: F.round(s.amount.cast("decimal(20,2)") * 100 / F.nullif(F.col("total").cast("decimal(20,2)"), F.lit(0)), 1).cast("decimal(38,1)")
    parts = F.transform(F.array_sort("sections"), lambda s: words(s.section, " ", s.amount, " ", cash, " (", share(s), "%)"))
    partial = F.coalesce(F.col("skipped"), F.lit(0)) > 0
    chunk = lambda when, kind, text, place=F.lit(0): F.when(when, F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"), text.alias("text")))
    priced = F.col("total").isNotNull()
    unit = F.when(F.trim("unit") != "", F.concat(F.lit(" "), F.trim("unit")))
    told = F.array(
        chunk(first & priced & ~partial, "total", words("BOQ total [", named, "] — total package value, total contract value, total cost: ", F.col("total"), " ", cash)),
        chunk(first & priced & partial, "partial", words("BOQ partial total [", named, "] — total package value, INCOMPLETE, ", F.col("skipped"), " pages not read: ", F.col("total"), " ", cash)),
        chunk(first & priced, "sections", words("BOQ cost by section [", named, "] — ", F.array_join(parts, "; "))),
        chunk(first & priced & F.col("sewer"), "terms", words("BOQ terms [", named, "]: sewer, foul and sanitary drainage and waste water are one network; storm and surface water is another")),
        chunk(first & ~priced, "guard", words("GUARD [", named, "]: a bill of quantities without a verified total. Do NOT state a total value from it")),
        chunk(there, "line", words("BOQ line item [", named, "] — ", F.trim("description"), ": total quantity ", F.col("quantity"), unit, ", unit price (rate) ", F.col("rate"), ", total price (amount) ", F.col("amount"), " ", cash), F.col("position")),
    )
    # Made before it is taken apart, as explode() would interpret all of it for the few functions that aren't compiled.
    return each.select("bill", told.alias("told")).select("bill", F.explode("told").alias("c")).where("c IS NOT NULL").select("bill", "c.kind", "c.place", "c.text")


def table_chunks(sheets: DataFrame, tables: DataFrame) -> DataFrame:
    """(sheet, kind, place, text) of the tables found on drawings, and a guard for each sheet that has none.

    ``sheets`` has sheet and name; ``tables`` sheet, place, page, kind, header and rows (arrays of cells, and of rows of
    them). Unknown kinds are plain tables; tables with neither header nor rows are none.
    """
    named = F.coalesce("name", F.lit(""))
    kind = F.when(F.col("kind").isin(*TABLES), F.col("kind")).otherwise("unclassified")
    label = F.element_at(F.create_map(*(F.lit(x) for pair in TABLES.items() for x in pair)), F.col("kind"))
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    header = F.coalesce("header", F.array().cast("array<string>"))
    real = tables.select("sheet", "place", "page", kind.alias("kind"), header.alias("header"), rows.alias("rows")).where((F.size("rows") > 0) | (F.size("header") > 0))
    joined = lambda cells: F.array_join(cells, " | ", "")
    grid = F.concat(F.when(F.size("header") > 0, F.array(joined(F.col("header")))).otherwise(F.array().cast("array<string>")), F.transform("rows", joined))
    text = words("DRAWING TABLE [", named, "] — ", label, ". Sheet page ", F.col("page"), ", ", F.size("rows"), " rows.\n", F.array_join(grid, "\n"))
    told = real.join(sheets, "sheet").select("sheet", "kind", F.col("place").cast("long").alias("place"), text.alias("text"))
    bare = sheets.join(real.select("sheet"), "sheet", "left_anti")
    guard = words("GUARD [", named, "]: a drawing without a readable schedule. Do NOT state marks, sizes, quantities or references from it")
    return told.unionByName(bare.select("sheet", F.lit("guard").alias("kind"), F.lit(0).cast("long").alias("place"), guard.alias("text")))


def cost_loaded(activities: DataFrame, links: DataFrame, crew_per_trade: int = CREW_PER_TRADE, day_rate: float | None = None) -> DataFrame:
    """(network, activity, name, wbs, duration, predecessors, manpower, manhours, man_days, cost) of generated activities.

    ``activities`` has network, activity, name, phase, duration, and may have trades (a list), crew_size, manpower,
    manhours and cost. Heads are those stated (manpower, then crew_size, where above 0), else so many a trade, one at
    least. Cost is what is stated and not 0; with ``day_rate`` the rest is heads x days x rate, without it null: a
    breakdown has no estimate behind it. ``links`` has network, pred and succ; predecessors are in order.
    """
    kinds = {"trades": "array<string>", "crew_size": "int", "manpower": "int", "manhours": "double", "cost": "double"}
    for name, kind in kinds.items():
        if name not in activities.columns:
            activities = activities.withColumn(name, F.lit(None).cast(kind))
    before = links.groupBy("network", F.col("succ").alias("activity")).agg(F.array_sort(F.collect_set("pred")).alias("predecessors"))
    stated = lambda c: F.when(F.col(c) > 0, F.col(c))
    days = F.greatest(F.coalesce("duration", F.lit(0)), F.lit(0)).cast("long")
    guess = F.greatest(F.lit(1), F.coalesce(F.size("trades"), F.lit(0)) * crew_per_trade)
    heads = F.coalesce(stated("manpower"), stated("crew_size"), guess).cast("int")
    cost = F.nullif(F.col("cost"), F.lit(0.0))
    if day_rate:
        cost = F.coalesce(cost, F.round(F.col("heads") * F.col("days") * F.lit(day_rate), 2))
    full = activities.withColumns({"heads": heads, "days": days}).join(before, ["network", "activity"], "left")
    return full.select(
        "network", "activity", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("phase", F.lit("")).alias("wbs"), F.col("days").alias("duration"),
        F.coalesce("predecessors", F.array().cast("array<string>")).alias("predecessors"), F.col("heads").alias("manpower"), F.round(stated("manhours"), 1).alias("manhours"),
        (F.col("heads") * F.col("days")).alias("man_days"), cost.alias("cost"),
    )
