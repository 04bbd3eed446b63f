import math

import numpy as np
import pytest

from keelson.llm import whitening


def ints(rows):
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows]


def check(spark, rows, schema="vec_id long, embedding array<double>, n string, x string", components=8):
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    out = whitening.whiten(spark.createDataFrame([(i, v, "?", "?") for i, v in rows], schema).repartition(3), components=components).collect()
    assert len(out) == len(good)
    x = np.array(ints([v for _, v in good]), np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    of = dict(zip([i for i, _ in good], x))
    for r in out:
        assert r.n == n and int(r.deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(of[r.id], sums))
        for k, w in enumerate(r.whitened):
            assert abs(r.explained[k] - max(values[k], 0) / values.sum()) < 1e-9
            if values[k] < 1e-9 * values[0]:
                assert w is None
            elif min(abs(values[k] - v) for j, v in enumerate(values) if j != k) > 1e-6 * values[0]:
                want = (of[r.id] - sums / n) @ vectors[:, k] / math.sqrt(values[k])
                assert abs(abs(w) - abs(want)) < 1e-6
        assert r.identity_error < 1e-9
    return out


def test_vectors(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((12, 12))
    rows = [(i, (rng.standard_normal(12) @ mix).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [None] + [0.5] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, [])]
    check(spark, rows)


def test_few_dimensions_equal_rows_and_ranks(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, rng.standard_normal(3).tolist()) for i in range(50)])
    low = rng.integers(-3, 4, (60, 2))
    check(spark, [(i, (low[i] @ np.array([[1, 2, 0, -1, 3, 5], [0, 1, 4, 2, -2, 1]])).astype(float).tolist()) for i in range(60)])  # rank 2
    same = whitening.whiten(spark.createDataFrame([(i, [0.25, -1.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 5 and all(r.whitened == [None, None] and r.explained == [0.0, 0.0] and r.identity_error == 0 and r.deviation == 0 for r in same)
    hot = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, rng.standard_normal(3).tolist()) for i in range(100)]
    check(spark, hot)


def test_close_eigenvalues(spark):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((16, 16)))[0]
    rows = np.vstack([q, -q]) * 40  # nearly a multiple of the identity
    out = check(spark, [(i, v.tolist()) for i, v in enumerate(rows)])
    assert out[0].identity_error < 1e-9


def test_large_deviations_are_exact():
    rng = np.random.default_rng(5)
    for big, n in ((1 << 20, 1000), (1 << 24, 1 << 28), (1 << 34, 1 << 26)):
        x = rng.integers(-big, big, (20, 7))
        sums = [int(s) * n // 4 for s in rng.integers(-big, big, 7)]
        got = whitening.deviations(x, sums, n).to_pylist()
        assert [int(v) for v in got] == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(np.array([[1 << 40], [0]]), [0], 1 << 40).to_pylist() == [None, 0]


@pytest.mark.parametrize("kind", ["random", "graded", "identity", "rank", "one"])
def test_solver(kind):
    rng = np.random.default_rng(6)
    a = {"random": lambda: rng.standard_normal((90, 30)), "one": lambda: rng.standard_normal((4, 1)), "identity": lambda: np.vstack([np.eye(12)] * 3),
         "graded": lambda: np.linalg.qr(rng.standard_normal((60, 20)))[0] * (10.0 ** -np.arange(20)) @ np.linalg.qr(rng.standard_normal((20, 20)))[0],
         "rank": lambda: rng.standard_normal((50, 3)) @ rng.standard_normal((3, 10))}[kind]()
    r = np.linalg.qr(a, mode="r")
    v, squares, trace = whitening.principal_directions(r, 8)
    want = np.linalg.svd(r)[1]
    assert np.allclose(np.sqrt(squares), want[:8], rtol=1e-12, atol=1e-13 * want[0]) and math.isclose(trace, (want ** 2).sum(), rel_tol=1e-12)
    real = squares > 0
    assert np.abs(v[:, real].T @ v[:, real] - np.eye(real.sum())).max() < 1e-10
    assert np.abs(r.T @ (r @ v) - v * squares).max() < 1e-12 * want[0] ** 2
    diagonal, upper, q = whitening.bidiagonal(r)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(b.T @ b, q.T @ r.T @ r @ q, atol=1e-12 * want[0] ** 2)


def test_empty_and_uneven(spark, none):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(empty.limit(0)).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
