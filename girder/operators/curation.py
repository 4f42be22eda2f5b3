"""Checks and reports on a corpus and what is said of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contradictions(rows: DataFrame, topic: list[str], against: Column, for_it: Column) -> DataFrame:
    """Topics with verdicts both ways, and how many rows they have."""
    return rows.groupBy(*topic).agg(F.bool_or(against).alias("against"), F.bool_or(for_it).alias("for_it"), F.count("*").alias("n")).where("against AND for_it")


def coverage(rows: DataFrame, known: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, n, unknown): rows of each ``by`` and how many of them have keys that ``known`` has not."""
    both = rows.join(known.select(*keys).distinct().withColumn("__known", F.lit(1)), keys, "left")
    return both.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("__known").isNull()).alias("unknown"))


def audit(docs: DataFrame, children: DataFrame, key: str, by: str, text: str) -> DataFrame:
    """(by, n, without, repeated): documents of each ``by``, those without children and those whose text repeats there. Hashes are counted before they meet."""
    counts = children.groupBy(key).agg(F.count("*").alias("__n"))
    hashed = docs.select(key, by, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__sha"))
    own = hashed.join(counts, key, "left").groupBy(by, "__sha").agg(F.count("*").alias("__k"), F.count_if(F.col("__n").isNull()).alias("__without"))
    return own.groupBy(by).agg(F.sum("__k").alias("n"), F.sum("__without").alias("without"), F.sum(F.when(F.col("__k") > 1, F.col("__k")).otherwise(0)).alias("repeated"))


def sample_covering(rows: DataFrame, kind: str, order: str, k: int) -> DataFrame:
    """(order, kind, place) of ``k`` rows: the first of each kind, then others. Only ``k`` + kinds rows reach one task."""
    first = rows.groupBy(kind).agg(F.min(order).alias(order)).withColumn("__more", F.lit(0))
    rest = rows.join(first.select(kind, order), [kind, order], "left_anti").select(kind, order).orderBy(order).limit(k).withColumn("__more", F.lit(1))
    place = F.row_number().over(Window.orderBy("__more", order))
    return first.unionByName(rest).withColumn("place", place.cast("long")).where(F.col("place") <= k).select(order, kind, "place")


def near_strings(strings: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b, distance) of distinct strings within ``most`` edits, each pair once.

    Of two such strings cut into most + 1 pieces one piece is the same and moved by ``most`` places at most, so that pieces at
    places meet and not all strings; strings of up to ``most`` characters have no piece and meet by length.
    """
    s, n = F.col(column), F.length(column)
    piece = lambda i: F.struct((F.floor(n * i / (most + 1)) + 1).cast("int").alias("at"), (F.floor(n * (i + 1) / (most + 1)) - F.floor(n * i / (most + 1))).cast("int").alias("size"))
    cut = strings.select(s.alias("a"), n.alias("n"), F.explode(F.array(*map(piece, range(most + 1)))).alias("p")).where("p.size > 0")
    keyed = cut.select("a", F.col("n"), F.substring("a", F.col("p.at"), F.col("p.size")).alias("piece"), F.col("p.at").alias("at"), F.col("p.size").alias("size"))
    shapes = keyed.select("n", "at", "size").distinct()
    moves = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    other = strings.select(s.alias("b"), n.alias("m"))
    near = other.withColumn("n", F.explode(F.sequence(F.col("m") - most, F.col("m") + most))).join(shapes, "n")  # a few rows for each length of strings
    probes = near.select("b", "n", "size", F.col("at"), moves.alias("move")).select("b", "n", "at", F.substring("b", F.greatest(F.lit(1), F.col("at") + F.col("move")), F.col("size")).alias("piece")).distinct()
    met = keyed.join(probes, ["n", "at", "piece"]).select("a", "b")
    short = strings.where(n <= most).select(s.alias("a"), F.explode(F.sequence(F.greatest(F.lit(0), n - most), n + most)).alias("m")).join(other, "m").select("a", "b")
    pairs = met.unionByName(short).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most).cast("long")).where("distance >= 0")


def rules_met(rules: list[tuple]) -> Column:
    """How many rules (column, operator, value) a row meets; null meets none, and a value that can't be compared neither."""
    total = F.lit(0)
    for column, operator, value in rules:
        c = F.col(column)
        met = {
            "eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v,
            "between": lambda c, v: c.between(*v), "contains": lambda c, v: F.lower(c).contains(str(v).lower()),
        }[operator](c, value)
        total = total + F.coalesce(met, F.lit(False)).cast("int")
    return total


def expired(rows: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    return rows.where(F.col(column) < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))
