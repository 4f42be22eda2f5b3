"""Near-duplicates by direction against the fold that they are defined by."""

import numpy as np
import pytest

from girder.operators import semantic


def vectors(seed, n, dims):
    """Clusters of every tightness, chains of small turns, copies and lone vectors."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.normal(size=dims)
        kind = rng.integers(5)
        for k in range(rng.integers(1, 30)):
            if kind == 0:
                base = base + rng.normal(size=dims) * 0.25
                out.append(base)
            elif kind == 1:
                out.append(base * rng.uniform(0.5, 2))
            elif kind < 4:
                out.append(base + rng.normal(size=dims) * rng.uniform(0.05, 0.8))
            else:
                out.append(rng.normal(size=dims))
    out = np.array(out[:n])
    return out[rng.permutation(n)]


def folded(rows, threshold):
    kept, stays = [], []
    for v in rows:
        norm = np.sqrt((v * v).sum())
        unit = v / norm if norm else v
        stays.append(not norm or not any(float(unit @ k) >= threshold - semantic.EXACT for k in kept))
        if stays[-1] and norm:
            kept.append(unit)
    return stays


@pytest.mark.parametrize("seed,n,dims,threshold", [(1, 900, 8, 0.85), (2, 700, 32, 0.85), (3, 600, 4, 0.97), (4, 500, 16, 0.4)])
def test_near_duplicates_equal_the_fold(spark, monkeypatch, seed, n, dims, threshold):
    rows = vectors(seed, n, dims)
    rows[5] = 0
    table = spark.createDataFrame([(i * 3, r.tolist(), "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, unit string").repartition(5)
    want = {i * 3: k for i, k in enumerate(folded(rows, threshold))}
    assert 0.02 < sum(want.values()) / n < 0.98
    for prefix, cell, waiting in ((4096, 4096, 1 << 14), (20, 40, 1 << 14), (20, 4096, 3)):
        monkeypatch.setattr(semantic, "PREFIX", prefix)
        monkeypatch.setattr(semantic, "CELL", cell)
        monkeypatch.setattr(semantic, "WAITING", waiting)
        assert {r.vec_id: r.kept for r in semantic.near_duplicates(table, threshold).collect()} == want, (prefix, cell, waiting)


def test_near_duplicates_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    table = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (6, None)], schema)
    assert {r.vec_id: r.kept for r in semantic.near_duplicates(table).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert semantic.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pivots_rule_cells_out_where_there_are_clusters():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    rows = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 32)) * 0.02
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    pivots = semantic.chosen_pivots(rows[rng.permutation(2000)], 2000, 0.97, 8)
    _, sent = semantic.cells_of(rows, pivots, 0.97)
    assert sent.sum(axis=1).mean() < 0.5 * len(pivots)


def test_vectors_without_clusters_go_by_panels(spark, monkeypatch):
    """Where a vector would go to every cell, none is dealt out; before, rounds over cells sent each vector to all of them."""
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(700, 48))
    rows[300:500] = rows[:200] + rng.normal(size=(200, 48)) * 0.3
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(semantic, "PREFIX", 20)
    monkeypatch.setattr(semantic, "PANEL", 90)
    monkeypatch.setattr(semantic, "CELL", 40)
    monkeypatch.setattr(semantic, "in_cells", lambda *_: pytest.fail("dealt to cells"))
    want = dict(enumerate(folded(rows, 0.85)))
    assert 0.5 < sum(want.values()) / 700 < 0.9
    assert {r.vec_id: r.kept for r in semantic.near_duplicates(table, 0.85).collect()} == want


def test_single_precision_never_decides_a_close_call():
    least, kept = 0.85 - semantic.EXACT, np.array([[1.0, 0.0]])
    cosines = 0.85 + np.array([-1e-3, -1e-8, -2e-12, 0, 1e-8, 1e-3])
    rows = np.stack([cosines, np.sqrt(1 - cosines**2)], axis=1)
    assert semantic.near_any(rows, kept, kept.astype(np.float32), least).tolist() == [False, False, False, True, True, True]


def test_cells_equal_the_fold(spark, monkeypatch):
    """Clusters by cells, in blocks in which only some rows hang on others."""
    rows = vectors(21, 500, 6)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    for name, value in (("PREFIX", 20), ("CELL", 40), ("SPREAD", 2), ("WAITING", 40)):
        monkeypatch.setattr(semantic, name, value)
    monkeypatch.setattr(semantic, "in_panels", lambda *_: pytest.fail("went by panels"))
    assert {r.vec_id: r.kept for r in semantic.near_duplicates(table, 0.9).collect()} == dict(enumerate(folded(rows, 0.9)))
