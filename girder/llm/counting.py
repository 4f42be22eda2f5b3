"""Counts of hashed features over all documents, in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .hashing import mix

SLICES = 64
SCHEMA = "part int, counts binary"


def hashed_counts(df: DataFrame, features: Callable[[pa.RecordBatch], Iterator], size: int) -> np.ndarray:
    """How often each number below ``size`` (a multiple of 64) occurs among the features of all rows.

    ``features`` yields arrays of numbers, or pairs of numbers and how often each is there.

    Each task adds up its own counts and sends them in slices, which are added up without being gathered; the
    driver gets ``size`` numbers, whatever the input.
    """

    def rows(total: np.ndarray) -> pa.RecordBatch:
        parts = [(k, part.tobytes()) for k, part in enumerate(total.reshape(SLICES, -1)) if part.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(size, np.uint32), 0
        for batch in batches:
            for x in features(batch):
                x, times = x if isinstance(x, tuple) else (x, None)
                # As floating-point numbers, which count a group's features exactly.
                total += np.bincount(x, times, minlength=size).astype(np.uint32)
                most += len(x) if times is None else int(times.sum())
            if most > 1 << 30:
                yield rows(total)
                total, most = np.zeros(size, np.uint32), 0
        yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((SLICES, size // SLICES), np.int64)
    for row in map_batches(map_batches(df, count, SCHEMA).repartition(SLICES, "part"), add, SCHEMA).collect():
        out[row.part] = np.frombuffer(row.counts, np.int64)
    return out.reshape(-1)


def hashed_marks(df: DataFrame, size: int) -> np.ndarray:
    """Whether each number below ``size`` is the place of an id of ``df``, a column of whole numbers; null counts as 0.

    Tasks send their marks in slices, as hashed_counts does; the driver gets ``size`` bits, whatever the input.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, bool)
        for batch in batches:
            total[places(batch.column(0), size)] = True
        parts = [(k, np.packbits(part).tobytes()) for k, part in enumerate(total.reshape(SLICES, -1)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["part", "counts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint8)
                marks[k] = marks[k] | part if k in marks else part
        yield pa.RecordBatch.from_arrays([pa.array(marks.keys(), pa.int32()), pa.array([m.tobytes() for m in marks.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((SLICES, size // SLICES), bool)
    for row in map_batches(map_batches(df, mark, SCHEMA).repartition(SLICES, "part"), join, SCHEMA).collect():
        out[row.part] = np.unpackbits(np.frombuffer(row.counts, np.uint8)).astype(bool)
    return out.reshape(-1)


def places(ids: pa.Array, size: int) -> np.ndarray:
    """The places of ids among ``size`` marks."""
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)
