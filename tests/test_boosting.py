"""Boosted trees against a plain loop over rows for one fit, and many fits against the same fits alone."""

import numpy as np
import pytest

from quillmark.operators import boosting as bo

P = {"learning_rate": 0.5, "gamma": 0.2, "reg_alpha": 0.3, "reg_lambda": 0.7, "subsample": 1.0, "colsample_bytree": 1.0}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    bins = rng.choice([0, 0, 1, 2], (150, 8)).astype(int)
    y = np.where(bins[:, 2] == 2, 2, np.where(bins[:, 5] >= 1, 1, 0))
    y[::11] = 0
    fold = np.arange(150) % 3
    docs = spark.createDataFrame([(i, int(a), int(f)) for i, (a, f) in enumerate(zip(y, fold))], "doc_id long, y int, fold int")
    cells = spark.createDataFrame([(int(i), int(j), int(bins[i, j])) for i, j in zip(*np.nonzero(bins))], "doc_id long, feature int, bin int")
    return bins, y, fold, bo.blocks(docs, cells, 8, rows=60, copies=2)


def plain(bins, y, train, p, k, rounds, depth):
    """Margins of one fit, tree by tree and node by node."""
    margin = np.zeros((len(y), k))

    def T(g):
        return np.sign(g) * max(abs(g) - p["reg_alpha"], 0)

    def score(g, h):
        return T(g) ** 2 / (h + p["reg_lambda"])

    def grow(rows, g, h, left, add):
        value = -T(g[rows].sum()) / (h[rows].sum() + p["reg_lambda"]) * p["learning_rate"]
        best = None
        for f in range(bins.shape[1]) if left else []:
            for c in (1, 2):
                r = bins[:, f] >= c
                a, b = rows & ~r, rows & r
                if h[a].sum() < 1 or h[b].sum() < 1:
                    continue
                gain = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[rows].sum(), h[rows].sum())
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, c)
        if best and best[0] > p["gamma"]:
            r = bins[:, best[1]] >= best[2]
            for side in (~r, r):
                grow_side(rows & side, side, g, h, left - 1, add)
        else:
            add.append((None, value))

    where = [np.ones(len(y), dtype=bool)]

    def grow_side(rows, side, g, h, left, add):
        where.append(where[-1] & side)
        got = []
        grow(rows, g, h, left, got)
        for mask, v in got:
            add.append((where[-1] if mask is None else mask, v))
        where.pop()

    for _ in range(rounds):
        e = np.exp(margin - margin.max(1, keepdims=True))
        q = e / e.sum(1, keepdims=True)
        step = np.zeros_like(margin)
        for c in range(k):
            got = []
            grow(train, (q[:, c] - (y == c)) * train, np.maximum(2 * q[:, c] * (1 - q[:, c]), 1e-16) * train, depth, got)
            for mask, v in got:
                step[mask if mask is not None else slice(None), c] += v
        margin += step
    return margin


def test_equals_a_plain_loop(data):
    bins, y, fold, work = data
    fits = bo.fits_of([P, {**P, "learning_rate": 0.1, "gamma": 3.0, "reg_alpha": 2.0}], [0, 1, bo.NO_FOLD])
    model = bo.train(work, fits, 3, 8, rounds=3, depth=2, chunk=2)
    for i in range(6):
        p = P if i < 3 else {**P, "learning_rate": 0.1, "gamma": 3.0, "reg_alpha": 2.0}
        train = fold != fits.fold[i]
        got = model.some(i, i + 1).margins(bins.astype(np.uint8), 3)
        assert np.allclose(got, plain(bins, y, train, p, 3, 3, 2)), i
    one = bo.predict(work, model.some(2, 3)).orderBy("doc_id").toPandas()
    assert len(one) == 150 and (one["p"] == y).mean() > 0.85


def test_samples_and_counts(data):
    bins, y, fold, work = data
    fits = bo.fits_of([{**P, "subsample": 0.5, "colsample_bytree": 0.5}], [0, 1, 2])
    model = bo.train(work, fits, 3, 8, rounds=2, depth=1)
    used = {int(f) for r in range(2) for f in model.feature[r].ravel() if f >= 0}
    assert all(bo.columns_of(fits, 8, r)[:8].sum(axis=0).tolist() == [4, 4, 4] for r in range(2))
    assert used <= {int(f) for r in range(2) for f in np.flatnonzero(bo.columns_of(fits, 8, r)[:8, 0])}
    cells = bo.held_out_counts(work, model).toPandas()
    assert cells.groupby("fit")["n"].sum().tolist() == [50, 50, 50]
    assert len(bo.points({"a": [1, 2], "b": [3, 4, 5]})) == 6
