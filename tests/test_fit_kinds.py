"""Fits that have grown the same trees on the same rows are summed once."""

import numpy as np

from quillmark.operators import boosting as bo
from quillmark.plans.boosting import FIRST, GRID


def test_kinds_of_the_first_round_and_after():
    fits = bo.fits_of(bo.points(GRID), list(range(5)))
    model = bo.Model(fits, 4, 10, 2)
    model.grow()
    first, kind = model.distinct()
    assert len(first) == 15 and len(kind) == 7290  # folds x row samples
    model.value[0][kind[0]] = 1.0
    assert len(model.distinct()[0]) == 16
    assert (model.fits.fold[first][kind[5:]] == model.fits.fold[5:]).all()


def test_nodes_follow_the_splits():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 3, (40, 6)).astype(np.uint8)
    model = bo.Model(bo.fits_of([FIRST], [0, 1]), 2, 6, 2)
    model.grow()
    model.feature[0][:], model.cut[0][:] = rng.integers(-1, 6, (4, 3)), rng.integers(1, 3, (4, 3))
    model.value[0][:] = rng.random((4, 7))
    want = np.zeros((40, 4), dtype=int)
    for d in range(40):
        for u in range(4):
            node = 0
            while node < 3 and model.feature[0][u, node] >= 0:
                node = 2 * node + 1 + int(bins[d, model.feature[0][u, node]] >= model.cut[0][u, node])
            want[d, u] = node
    assert (model.nodes(bins, 0) == want).all()
    assert np.allclose(model.margins(bins, 1), model.value[0][np.arange(4), want])


def test_a_round_does_not_depend_on_its_own_values():
    fits = bo.fits_of([{**FIRST, "reg_lambda": x} for x in (0.1, 0.5)], [0])
    model = bo.Model(fits, 2, 6, 2)
    model.grow()
    model.value[0][:2, 0], model.value[0][2:, 0] = 0.1, 0.2
    assert len(model.distinct(0)[0]) == 1 and len(model.distinct(1)[0]) == len(model.distinct()[0]) == 2


def test_blocks_lie_once_and_tasks_send_one_row_a_chunk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, int(i % 2), int(i % 3)) for i in range(200)], "doc_id long, y int, fold int")
    bins = rng.integers(0, 3, (200, 4))
    cells = spark.createDataFrame([(int(i), int(j), int(bins[i, j])) for i, j in zip(*np.nonzero(bins))], "doc_id long, feature int, bin int")
    work = bo.blocks(docs, cells, 4, rows=10, copies=4)
    assert work.count() == 20
    monkeypatch.setattr(bo, "TASKS_A_COPY", 1)
    for held, groups in ((10 ** 9, 1), (1, 3)):
        monkeypatch.setattr(bo, "HELD_BYTES", held)
        model = bo.Model(bo.fits_of([FIRST], [0, 1, 2]), 2, 4, 1)
        model.grow()
        assert bo._parts(work, groups) == -(-4 // groups)
        got = {r.chunk: np.frombuffer(bytes(r.sums)) for r in bo.level_sums(work, model, 0, 0, 1).collect()}
        assert sorted(got) == [0, 1, 2]
        for c, sums in got.items():  # the last of the cut x feature rows is the total: half of the rows of each class, less the own fold
            total = sums.reshape(1, 2, 2 * 4 + 1, 2)[0, 1, -1]
            assert np.allclose(total, 0.5 * (200 - np.sum(np.arange(200) % 3 == c)))
