"""Nearest neighbours where windows are a part of the table, against brute force."""

import numpy as np
import pytest

from tidemark.llm import hilbert_ann


def exact(x, asked, k):
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    return [set(r) for r in np.argsort(-s, axis=1)[:, :k].tolist()]


@pytest.mark.parametrize("rows,clusters", [(3000, 0), (5000, 40)])
def test_recall_with_windows(spark, rows, clusters, monkeypatch):
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, 24))
    if clusters:
        x += 3 * rng.standard_normal((clusters, 24))[rng.integers(0, clusters, rows)]
    x *= rng.choice([0.8, 1, 1.2], (rows, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = np.arange(0, rows, 50)
    want = exact(x, asked, 20)
    monkeypatch.setattr(hilbert_ann, "QUERY_ROWS", 3)  # slabs in parts
    got = hilbert_ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    found = {q: set() for q in asked.tolist()}
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-9)
    assert all(len(f) == 20 for f in found.values())
    assert sum(len(f & w) for f, w in zip(found.values(), want)) >= 0.9 * 20 * len(asked)


def test_a_window_is_the_same_share_at_every_size():
    """A curve's window holds SHARE of the rows, and all windows together leave rows out: the search is not exhaustive."""
    for rows in (600, 4000):
        rng = np.random.default_rng(1)
        x = rng.standard_normal((rows, 24))
        curves = hilbert_ann.Curves(x, np.linalg.norm(x, axis=1).max(), hilbert_ann.SLABS)
        tie = rng.integers(0, 1 << 31, rows)
        placed, seen = curves.lift(x), np.zeros(rows, bool)
        for c in range(hilbert_ann.CURVES):
            slab = curves.slab(c, placed, tie)
            at = int(np.clip(curves.slab(c, curves.aim(x[:1]), tie[:1])[0] - 1, 0, hilbert_ann.SLABS - 3))
            window = (slab >= at) & (slab <= at + 2)
            assert abs(window.mean() - hilbert_ann.SHARE) < 0.01
            seen |= window
        assert seen.mean() < 0.9


def test_ids_that_repeat(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hilbert_ann.nearest(df, df, 5).collect())
    assert got == [(1, 1, 3, 2.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 0.2), (3, 1, 1, 2.0), (3, 2, 2, 0.2)]
