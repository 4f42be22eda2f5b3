"""Near-duplicates by direction: in order of id, each vector stays unless one that stayed before it is near.

That is a fold over all vectors, which is made in three steps, each exact:

- equal vectors count once, by their smallest id;
- the first PREFIX ids are folded by themselves, as nothing later bears on them; they are few whatever the input, and
  what is near one of them that stayed goes in one scan. A direction that many vectors share is nearly always
  among them, so no cell below has to hold a hot group;
- the rest is dealt to cells around pivots, a vector to its own cell and to every other in which a near one
  could live. A cell sees, in order of id, all that can decide its own vectors. One is kept for certain if no near
  one before it is undecided, and gone if near one that is kept; what hangs on a vector of another cell waits for the
  next round. Each round decides the smallest id that is left, and mostly whole chains.

No pair is ever written. Where vectors have no clusters (all far from each other in many dimensions), no pivot can
rule a cell out. Then every vector has to meet all that stay before it, which is what exactness costs there: the next
PANEL ids are folded by themselves, and one scan takes from the rest what is near one of them that stayed. Nothing is
shuffled, and there are as many rounds as panels, whatever hangs on what.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schedule import cut

#: Vectors folded first, vectors from which pivots are chosen, and vectors of a cell, about.
PREFIX, SAMPLE, CELL = 4096, 4096, 4096
#: Undecided vectors that a cell compares in one round; later ones wait for the next.
WAITING = 16_384
BLOCK = 256
#: Ids that are folded by themselves where no cell can be ruled out, and the share of cells that a vector goes to from which that is done.
PANEL, SPREAD = 16_384, 0.25
UNIT = "vec_id long, unit binary"
DEALT = "cell int, vec_id long, home boolean, stays boolean, unit binary"
#: Cosines that differ by less are taken for equal to the threshold.
EXACT = 1e-12


def rows_of(units: pa.Array) -> np.ndarray:
    raw = units.to_pylist()
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in names.split(", ")])


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def near_any(rows: np.ndarray, kept: np.ndarray, kept32: np.ndarray, least: float) -> np.ndarray:
    """Which of ``rows`` have a cosine of ``least`` with one of ``kept``: single precision where that decides it, double for the others."""
    if not len(kept):
        return np.zeros(len(rows), bool)
    off = 1.2e-7 * (rows.shape[1] + 8)  # more than what units lose by single precision
    found = np.zeros(len(rows), bool)
    for lo in range(0, len(rows), BLOCK):
        top = (rows[lo : lo + BLOCK].astype(np.float32) @ kept32.T).max(axis=1).astype(np.float64)
        found[lo : lo + BLOCK] = top >= least + off
        open_ = lo + np.flatnonzero((top >= least - off) & (top < least + off))
        if len(open_):
            found[open_] = (rows[open_] @ kept.T >= least).any(axis=1)
    return found


def fold(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows, in order, stay: those with no row before that stays and is near."""
    stays, single = np.zeros(len(rows), bool), rows.astype(np.float32)
    for lo in range(0, len(rows), BLOCK):
        block, before = rows[lo : lo + BLOCK], np.flatnonzero(stays[:lo])
        free = ~near_any(block, rows[before], single[before], threshold - EXACT)
        near = block @ block.T >= threshold - EXACT
        for i in np.flatnonzero(free).tolist():
            stays[lo + i] = not near[i, :i][stays[lo : lo + i]].any()
    return stays


class Undecided:
    """The vectors of one cell, in order of id: which of its own are kept, and which have to wait."""

    def __init__(self, width: int, threshold: float):
        self.kept, self.waiting, self.least = np.zeros((0, width)), np.zeros((0, width)), threshold - EXACT
        self.full = False

    def take(self, rows: np.ndarray, home: np.ndarray, stays: np.ndarray) -> np.ndarray:
        """0: near a kept one; 1: kept; 2: waits, or belongs to another cell."""
        self.kept = np.concatenate([self.kept, rows[stays]])
        gone, waits = (rows @ self.kept.T >= self.least).any(axis=1), (rows @ self.waiting.T >= self.least).any(axis=1)
        near = np.tril(rows @ rows.T >= self.least, -1) & ~stays
        # What is near nothing before it in the block hangs on no other row of it; only the others go one by one.
        hangs = near.any(axis=1)
        state = np.where(stays | (~hangs & ~gone & ~waits & home & (not self.full)), 1, 2)
        for i in np.flatnonzero(hangs & ~gone & ~stays).tolist():
            before = near[i, :i]
            if (before & (state[:i] == 1)).any():
                gone[i] = True
            elif home[i] and not self.full and not waits[i] and not (before & (state[:i] == 2) & ~gone[:i]).any():
                state[i] = 1
        state[gone & ~stays] = 0
        self.kept = np.concatenate([self.kept, rows[(state == 1) & ~stays]])
        self.waiting = np.concatenate([self.waiting, rows[state == 2]]) if not self.full else self.waiting
        self.full |= len(self.waiting) >= WAITING
        return state


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """UNIT of each distinct vector that isn't null or zero, by its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array(batch.column(1).to_pylist(), np.float64)
            norm = np.sqrt((rows * rows).sum(axis=1))
            some = norm > 0
            yield batch_of(UNIT, batch.column(0).filter(pa.array(some)), packed(rows[some] / norm[some, None]))

    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return whole.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding").mapInArrow(run, UNIT)


def away_from(units: DataFrame, kept: np.ndarray, threshold: float) -> DataFrame:
    """The vectors that are near none of ``kept``, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept32 = kept.astype(np.float32)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~near_any(rows_of(batch.column(1)), kept, kept32, threshold - EXACT)))

    return units.mapInArrow(run, UNIT)


def cells_of(rows: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, for each pivot whether a near vector could have it as its own) of each row.

    A near vector is at most so far from the row that it could be nearer to the pivot than to the row's own one only
    if the row's distance from the plane between the two is no more.
    """
    dots = rows @ pivots.T
    own = dots.argmax(axis=1)
    ahead = dots - dots[np.arange(len(rows)), own][:, None]
    apart = np.maximum(0, 2 - 2 * (pivots @ pivots.T)[own])
    reach = threshold * ahead + math.sqrt(1 - threshold * threshold) * np.sqrt(np.maximum(0, apart - ahead * ahead))
    return own, (reach >= -1e-9) & (dots >= -1 - 1e-9)


def chosen_pivots(sample: np.ndarray, n: int, threshold: float, least: int) -> np.ndarray:
    """As many of ``sample`` as make the cells' comparisons fewest: copies sent times the size of a cell."""
    best, cost, size = sample[:1], math.inf, max(1, min(len(sample), max(least, -(-n // CELL))))
    tried = sample[-512:]
    while size <= len(sample):
        _, sent = cells_of(tried, sample[:size], threshold)
        if (now := sent.sum(axis=1).mean() / size) < 0.9 * cost:
            best, cost = sample[:size], now
        size *= 4
    return best


def near_duplicates(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(vec_id, kept) of each row of (vec_id, embedding): whether it stays when rows are taken in order of id.

    A row goes if its cosine with a row that stays, of a smaller id, is at least ``threshold`` (above 0). Of rows with
    equal vectors only those with the smallest id stay. Null and zero vectors are near nothing and stay; rows without
    id are left out; no rows give no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    units = cut(unit_vectors(vectors))
    kept, left = first_folded(units, PREFIX, threshold)
    if left is not None:
        kept = kept.unionByName(in_panels(left, threshold) if spread_out(left, threshold) else in_cells(left, threshold))
    plain = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    pointless = F.col("embedding").isNull() | ~F.exists("embedding", lambda x: x != 0)
    return plain.join(kept.withColumn("found", F.lit(True)), "vec_id", "left").select("vec_id", (pointless | F.coalesce("found", F.lit(False))).alias("kept"))


def first_folded(units: DataFrame, most: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(vec_id) of those that stay of the ``most`` smallest ids, and all later vectors that are near none of them; None where there are none."""
    first = units.orderBy("vec_id").limit(most).toArrow().sort_by("vec_id")
    rows, ids = rows_of(first.column("unit")) if first.num_rows else np.zeros((0, 1)), first.column("vec_id").to_numpy()
    stays = fold(rows, threshold)
    kept = units.sparkSession.createDataFrame([(int(i),) for i in ids[stays]], "vec_id long")
    if len(ids) < most:
        return kept, None
    left = cut(away_from(units.where(F.col("vec_id") > int(ids[-1])), rows[stays], threshold))
    return kept, None if left.isEmpty() else left


def spread_out(units: DataFrame, threshold: float) -> bool:
    """Whether a vector would go to so many cells that meeting all that stay costs no more."""
    sample = rows_of(units.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow().column("unit"))
    pivots = chosen_pivots(sample, units.count(), threshold, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells_of(sample[-512:], pivots, threshold)[1].mean() > SPREAD


def in_panels(units: DataFrame, threshold: float) -> DataFrame:
    """(vec_id) of the vectors that stay, by rounds over the next PANEL ids."""
    kept, left = first_folded(units, PANEL, threshold)
    while left is not None:
        more, left = first_folded(left, PANEL, threshold)
        kept = kept.unionByName(more)
    return kept


def in_cells(units: DataFrame, threshold: float) -> DataFrame:
    """(vec_id) of the vectors that stay, by rounds over cells."""
    spark = units.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = units.select("vec_id", "unit", F.lit(False).alias("stays"))
    kept: DataFrame | None = None
    while n := left.where("NOT stays").count():
        picked = left.where("NOT stays").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
        pivots = chosen_pivots(rows_of(picked.column("unit")), n, threshold, parts)

        def deal(batches: Iterator[pa.RecordBatch], pivots=pivots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(lo, BLOCK)
                    own, sent = cells_of(rows_of(part.column(1)), pivots, threshold)
                    row, cell = np.nonzero(sent)
                    at = pa.array(row)
                    yield batch_of(DEALT, pa.array(cell.astype(np.int32)), part.column(0).take(at), pa.array(own[row] == cell), part.column(2).take(at), part.column(1).take(at))

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, state = None, None
            for batch in batches:
                cells = batch.column(0).to_numpy()
                starts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, np.arange(0, len(cells), BLOCK)])) if len(cells) else []
                for lo, hi in zip(starts, [*starts[1:], len(cells)], strict=True):
                    part = batch.slice(lo, hi - lo)
                    rows = rows_of(part.column(4))
                    if cells[lo] != cell:
                        cell, state = cells[lo], Undecided(rows.shape[1], threshold)
                    home, stays = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                    told = state.take(rows, home, stays)
                    mine = home & ~stays & (told > 0)
                    own = part.filter(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([own.column(1), own.column(4), pa.array(told[mine] == 1)], names=["vec_id", "unit", "stays"])

        dealt = left.select("vec_id", "unit", "stays").mapInArrow(deal, DEALT).repartition(max(parts, min(len(pivots), 16 * parts)), "cell").sortWithinPartitions("cell", F.col("stays").desc(), "vec_id")
        left = cut(dealt.mapInArrow(decide, "vec_id long, unit binary, stays boolean"))
        new = left.where("stays").select("vec_id")
        kept = new if kept is None else kept.unionByName(new)
    return kept if kept is not None else units.select("vec_id").limit(0)
