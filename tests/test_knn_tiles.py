import tracemalloc

import numpy as np
import pytest

from keelson.operators import knn


def _brute(q, t, k):
    d = ((q[:, None, :] - t[None, :, :]) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, k - 1]


@pytest.mark.parametrize("d, scale, off", [(20, 1.0, 0.0), (3, 1.0, 1e7), (5, 1e5, -1e3)])
def test_search_in_tiles_equals_brute_force_with_and_without_bounds(d, scale, off):
    """each tile is compared with the k-th distance so far."""
    rng = np.random.default_rng(8)
    t, q = rng.normal(size=(3 * knn.TILE_COLUMNS + 7, d)) * scale + off, rng.normal(size=(60, d)) * scale + off
    t[100], t[2000] = t[50], t[50]
    q[0] = t[50]
    ids = np.arange(len(t))
    want, kth = _brute(q, t, 4)
    held = knn._Train(ids, t, 4)
    loose = _brute(q, t[:900], 4)[1]
    for bound in (None, kth * (1 + 1e-9), loose, np.full(60, np.inf)):
        rows, members, _ = knn._nearest(q, ids, held, 4, None, bound)
        assert members.reshape(60, 4).tolist() == want.tolist() and rows.tolist() == np.repeat(np.arange(60), 4).tolist()
    t[7], t[9], q[1] = np.nan, 1e149, 1e149  # a query near a row that is too large for the product
    with np.errstate(all="ignore"):
        want = _brute(np.nan_to_num(q, nan=0.0), np.where(np.isnan(t), 1e153, t), 4)[0]
    rows, members, _ = knn._nearest(q, ids, knn._Train(ids, t, 4), 4, None)
    assert members.reshape(60, 4)[[0, 2, 3]].tolist() == want[[0, 2, 3]].tolist() and members.reshape(60, 4)[1, 0] == 9


@pytest.mark.parametrize("d, scale, off", [(20, 1.0, 0.0), (3, 1.0, 1e7), (5, 1e5, -1e3)])
def test_search_in_tiles_equals_brute_force_with_and_without_bounds(d, scale, off):
    """each tile is compared with the k-th distance so far."""
    rng = np.random.default_rng(8)
    t, q = rng.normal(size=(3 * knn.TILE_COLUMNS + 7, d)) * scale + off, rng.normal(size=(60, d)) * scale + off
    t[100], t[2000] = t[50], t[50]
    q[0] = t[50]
    ids = np.arange(len(t))
    want, kth = _brute(q, t, 4)
    held = knn._Train(ids, t, 4)
    loose = _brute(q, t[:900], 4)[1]
    for bound in (None, kth * (1 + 1e-9), loose, np.full(60, np.inf)):
        rows, members, _ = knn._nearest(q, ids, held, 4, None, bound)
        assert members.reshape(60, 4).tolist() == want.tolist() and rows.tolist() == np.repeat(np.arange(60), 4).tolist()
    t[7], t[9], q[1] = np.nan, 1e149, 1e149  # a query near a row that is too large for the product
    with np.errstate(all="ignore"):
        want = _brute(np.nan_to_num(q, nan=0.0), np.where(np.isnan(t), 1e153, t), 4)[0]
    rows, members, _ = knn._nearest(q, ids, knn._Train(ids, t, 4), 4, None)
    assert members.reshape(60, 4)[[0, 2, 3]].tolist() == want[[0, 2, 3]].tolist() and members.reshape(60, 4)[1, 0] == 9
