import numpy as np
import pyarrow as pa

from keelson.operators import linear


def _batches(n, d):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(n, d)), rng.integers(0, 2, n).astype(float)
    x[3, 1] = np.nan
    out = []
    for s in range(0, n, 700):
        vec = [[None if np.isnan(v) else v for v in r] for r in x[s:s + 700].tolist()]
        out.append(pa.RecordBatch.from_arrays([pa.array(vec, pa.list_(pa.float64())), pa.array(y[s:s + 700]), pa.array([i % 5 == 0 for i in range(len(vec))])], ["f", "l", "v"]))
    return out, x, y


def test_training_rows_beyond_the_bound_are_in_a_file(monkeypatch):
    """a task's memory is bounded, the sums are of all its rows."""
    batches, x, y = _batches(4_000, 6)
    w, b = np.linspace(-1, 1, 6), 0.25
    whole = linear._local_stats(linear._TaskRows(iter(batches), 6), w, b)
    monkeypatch.setattr(linear, "HELD_BYTES", 50_000)
    monkeypatch.setattr(linear, "SLICE_BYTES", 10_000)
    rows = linear._TaskRows(iter(batches), 6)
    assert sum(c.nbytes for c, _, _ in rows.slices if c is not None) <= 50_000 < sum(n * 56 for _, n, _ in rows.slices)
    for _ in range(2):
        got = linear._local_stats(rows, w, b)
        assert np.allclose(got, whole, rtol=1e-12, atol=1e-12)
    v = np.concatenate([t.column(2).to_numpy(zero_copy_only=False) for t in batches])
    known = np.isfinite(x).all(axis=1)
    p = 1 / (1 + np.exp(-(np.nan_to_num(x) @ w + b)))
    fit = known & ~v
    assert np.allclose(got[:6], (p - y)[fit] @ x[fit]) and np.isclose(got[6], (p - y)[fit].sum()) and got[8] == (~v).sum()
    assert got[9] == ((p > 0.5) == (y == 1))[v & known].sum() and got[10] == (v & known).sum()
