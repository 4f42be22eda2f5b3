"""Corrections of formulas that are fitted anew as observations arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, x double, y double, xx double, xy double"


class Line:
    """A straight line through observations, from their number, means and centred sums; nothing of the observations is kept."""

    def __init__(self, n: int = 0, x: float = 0.0, y: float = 0.0, xx: float = 0.0, xy: float = 0.0):
        self.n, self.x, self.y, self.xx, self.xy = n, x, y, xx, xy

    def add(self, x: float, y: float) -> None:
        self.n += 1
        off = x - self.x
        self.x += off / self.n
        self.xx += off * (x - self.x)
        self.y += (y - self.y) / self.n
        self.xy += off * (y - self.y)

    def fit(self) -> tuple[float, float]:
        """(scale, bias); the scale is 1 where all x are equal."""
        scale = self.xy / self.xx if self.xx > 0 else 1.0
        return scale, self.y - scale * self.x


def fits(stream: DataFrame, by: str, computed: str, actual: str, least: int = 5) -> DataFrame:
    """(by, n, scale, bias) of each ``by`` after each micro-batch that brings it observations, once it has ``least`` of them.

    The state is five numbers for each ``by``. Observations without both values don't count. The last row of each
    ``by`` is the line that correction_fit draws through all its observations so far.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = Line(*state.get) if state.exists else Line()
        for frame in frames:
            for x, y in zip(frame["x"].tolist(), frame["y"].tolist(), strict=True):
                if not (math.isnan(x) or math.isnan(y)):
                    line.add(x, y)
        state.update((line.n, line.x, line.y, line.xx, line.xy))
        if line.n >= least:
            scale, bias = line.fit()
            yield pd.DataFrame({by: [key[0]], "n": [line.n], "scale": [scale], "bias": [bias]})

    rows = stream.select(F.col(by).cast("string").alias(by), F.col(computed).cast("double").alias("x"), F.col(actual).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy(by).applyInPandasWithState(run, f"{by} string, n long, scale double, bias double", STATE, "append", GroupStateTimeout.NoTimeout)
