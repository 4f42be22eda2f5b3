"""Boxes that clash, and effects that cascade through rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = "xyz"


def boxes_of(vertices: DataFrame, by: str) -> DataFrame:
    """(id, x0, x1, y0, y1, z0, z1, n_vertices) around the vertices (x, y, z) of each ``by``; vertices with a null coordinate don't count."""
    whole = vertices.where(" AND ".join(f"{k} IS NOT NULL" for k in AXES))
    ends = [f(k).cast("double").alias(f"{k}{i}") for k in AXES for i, f in enumerate((F.min, F.max))]
    return whole.groupBy(F.col(by).alias("id")).agg(*ends, F.count("*").alias("n_vertices"))


def clashes(boxes: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """(a, b, overlap) of boxes (id, x0, x1, y0, y1, z0, z1) that share more than ``tolerance`` along each axis, a < b.

    Boxes stand on grids of several levels, each with cells twice as wide as the one before, from ``cell`` up: a box
    has the level whose cells are as large as it in plan, so it touches four of them at most, however large it is. It
    meets the boxes of its own and of higher levels in their cells, of which it touches four at most, too. A pair
    counts in the first cell that both touch, so that none is found twice.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(cell))
    leveled = boxes.withColumn("level", F.ceil(F.log2(size / cell)).cast("int"))
    levels = sorted(r[0] for r in leveled.select("level").distinct().collect())  # one number for each doubling of size
    names = ("id", "x0", "x1", "y0", "y1", "z0", "z1")

    def in_cells(df: DataFrame, side: str) -> DataFrame:
        step = lambda c: F.floor(F.col(c) / (cell * F.pow(F.lit(2.0), F.col("at"))))
        placed = df.withColumn("gx", F.explode(F.sequence(step("x0"), step("x1")))).withColumn("gy", F.explode(F.sequence(step("y0"), step("y1"))))
        return placed.select("at", "gx", "gy", F.col("level").alias(f"{side}_level"), *(F.col(c).alias(f"{side}_{c}") for c in names))

    higher = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("level"))
    own, other = in_cells(leveled.withColumn("at", F.explode(higher)), "p"), in_cells(leveled.withColumn("at", F.col("level")), "q")
    # Of two boxes of one level, one meets the other from both sides: the smaller id asks.
    pairs = own.join(other, ["at", "gx", "gy"]).where("(p_level < q_level AND p_id <> q_id) OR (p_level = q_level AND p_id < q_id)")
    shared = {k: F.least(f"p_{k}1", f"q_{k}1") - F.greatest(f"p_{k}0", f"q_{k}0") for k in AXES}
    meet = pairs.where((shared["x"] > tolerance) & (shared["y"] > tolerance) & (shared["z"] > tolerance))
    width = cell * F.pow(F.lit(2.0), F.col("at"))
    first = (F.col("gx") == F.floor(F.greatest("p_x0", "q_x0") / width)) & (F.col("gy") == F.floor(F.greatest("p_y0", "q_y0") / width))
    return meet.where(first).select(F.least("p_id", "q_id").alias("a"), F.greatest("p_id", "q_id").alias("b"), (shared["x"] * shared["y"] * shared["z"]).alias("overlap"))


def cascade(rules: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, level): what rules (source, target) reach from each start within ``depth`` steps, at its least level."""
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("level")).distinct()
    reached = front
    for level in range(1, depth + 1):
        front = front.join(rules, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), F.lit(level).alias("level")).distinct()
        front = front.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        reached = reached.unionByName(front)
    return reached
