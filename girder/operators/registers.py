"""Registers, matches, scenarios and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import networks


def compressed(activities: DataFrame, edges: DataFrame, reduced: Column) -> DataFrame:
    """(network, before, after, saved): the days that a network takes before and after durations are ``reduced``.

    Both scenarios are networks of their own in one pass.
    """
    scenario = F.explode(F.array(F.lit("before"), F.lit("after"))).alias("scenario")
    both = F.struct("network", "scenario").alias("network")
    duration = F.when(F.col("scenario") == "after", reduced).otherwise(F.col("duration"))
    acts = activities.select("*", scenario).select(both, "activity", duration.alias("duration"))
    arcs = edges.select("*", scenario).select(both, "pred", "succ", "kind", "lag")
    ends = networks.critical_path(acts, arcs).groupBy("network").agg(F.max("early_finish").alias("finish"))
    wide = ends.groupBy(F.col("network.network").alias("network")).agg(*(F.max(F.when(F.col("network.scenario") == s, F.col("finish"))).alias(s) for s in ("before", "after")))
    return wide.withColumn("saved", F.col("before") - F.col("after"))


def rendered(template: str, names: list[str]) -> Column:
    """A template with {name} in the place of columns; null ones leave nothing."""
    text = F.lit(template)
    for name in names:
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return text


def numbered(rows: DataFrame, by: str, order: list[str], prefix: str) -> DataFrame:
    """``rows`` with a number of their own in each ``by``: PREFIX-001 and on."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("number", F.concat(F.lit(prefix + "-"), F.lpad(n.cast("string"), 3, "0")))


def capable(items: DataFrame, suppliers: DataFrame, k: int) -> DataFrame:
    """(item, supplier, rank): the ``k`` best suppliers of an item's material, those with an empty list of capabilities among them.

    Suppliers are ranked for each material once, and items take the ranks: no item meets all suppliers. Of those with
    an empty list only the ``k`` best of all can be among the best for a material, so each material meets k rows of them.
    """
    materials = items.select("material").distinct()
    named = suppliers.select("supplier", "score", F.explode("can").alias("material")).join(materials, "material", "left_semi")
    best_open = suppliers.where(F.size("can") == 0).select("supplier", "score").orderBy(F.desc("score"), "supplier").limit(k)
    open_ones = materials.join(F.broadcast(best_open))
    order = Window.partitionBy("material").orderBy(F.desc("score"), "supplier")
    best = named.unionByName(open_ones.select("supplier", "score", "material")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return items.join(best, "material").select("item", "supplier", "rank")


def strongest(seen: DataFrame) -> DataFrame:
    """(photo, class, confidence, tier): the strongest sight of each class in a photo; what is under 0.05 is dropped."""
    tier = F.when(F.col("confidence") >= 0.30, "detected").otherwise("low")
    return seen.where("confidence >= 0.05").groupBy("photo", "class").agg(F.max("confidence").alias("confidence")).withColumn("tier", tier)


def scenarios(changes: DataFrame, by: str) -> DataFrame:
    """(by, conservative, aggressive, carbon): half and all of what alternatives save, and the carbon that they save."""
    saving = F.coalesce(F.sum(F.when(F.col("cost") < 0, -F.col("cost"))), F.lit(0))
    carbon = F.coalesce(F.sum(F.when(F.col("carbon") < 0, -F.col("carbon"))), F.lit(0))
    sums = changes.groupBy(by).agg(saving.cast("double").alias("aggressive"), carbon.cast("double").alias("carbon_saved"))
    return sums.select(by, (F.col("aggressive") * 0.5).alias("conservative"), "aggressive", "carbon_saved")


def augmented(rows: DataFrame, label: str, text: str, templates: list[str], target: int) -> DataFrame:
    """New texts for each label with fewer than ``target``: templates around its texts in order, none that exists, no more than are lacking."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") < target)
    made = rows.join(counts, label).select(label, "__n", F.col(text).alias("__seed"), F.posexplode(F.array(*map(F.lit, templates))).alias("__k", "__t"))
    made = made.withColumn(text, F.replace("__t", F.lit("{}"), F.col("__seed")))
    first = made.groupBy(label, text).agg(F.min(F.struct("__k", "__seed")).alias("__at"), F.first("__n").alias("__n")).join(rows.select(label, text), [label, text], "left_anti")
    place = F.row_number().over(Window.partitionBy(label).orderBy("__at", text))
    return first.withColumn("__p", place).where(F.col("__p") <= target - F.col("__n")).select(label, text, F.lit(0.3).alias("weight"))


def first_failure(stages: dict[str, Column]) -> Column:
    """The name of the first stage that a row fails; null where it passes all, and a stage that can't be judged is passed."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in stages.items()))


# Phrases around a text, and other verbs for the one that it begins with.
PHRASES = ["how do I {}", "can you {}", "please {}", "I need to {}", "{} please", "help me {}"]
SYNONYMS = {
    "extract": ["pull", "get", "grab", "retrieve"], "estimate": ["calculate", "compute", "work out"], "analyze": ["review", "check", "examine"], "process": ["handle", "deal with", "work on"],
    "generate": ["create", "produce", "make"], "optimize": ["improve", "tune", "refine"], "schedule": ["plan", "timetable", "sequence"], "check": ["verify", "validate", "audit"],
}


def paraphrased(rows: DataFrame, target: int, weight: float = 0.3) -> DataFrame:
    """(label, text, weight) of new texts for each label with fewer than ``target`` rows (label, text, seq).

    Texts are taken by ``seq``; of each come the phrases around it, then its leading verb's synonyms, with its words
    one blank apart. What the label has already, and what was made before, is left out; a label gets what it lacks
    and no more. Null texts count as rows and make nothing. Labels with enough rows are dropped before any text is
    made, so that a label has fewer than ``target`` of them.
    """
    short = rows.groupBy("label").agg(F.count("*").alias("__n")).where(F.col("__n") < target)
    few = rows.join(short, "label").where("text IS NOT NULL")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    verbs = F.element_at(F.create_map(*(x for verb, others in SYNONYMS.items() for x in (F.lit(verb), F.array(*map(F.lit, others))))), F.lower(F.get("__w", F.lit(0))))
    around = [F.concat(F.lit(a), F.col("text"), F.lit(b)) for a, b in (p.split("{}") for p in PHRASES)]
    swapped = F.transform(F.coalesce(verbs, F.array().cast("array<string>")), lambda v: F.array_join(F.concat(F.array(v), F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(1)))), " "))
    made = few.withColumn("__w", words).select("label", "__n", "seq", F.posexplode(F.concat(F.array(*around), swapped)).alias("__k", "text"))
    first = made.groupBy("label", "text").agg(F.min(F.struct("seq", "__k")).alias("__at"), F.first("__n").alias("__n"))
    new = first.join(few.select("label", "text"), ["label", "text"], "left_anti")
    place = F.row_number().over(Window.partitionBy("label").orderBy("__at", "text"))
    return new.withColumn("__p", place).where(F.col("__p") <= target - F.col("__n")).select("label", "text", F.lit(weight).alias("weight"))
