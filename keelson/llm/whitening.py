"""Embedding whitening by a bidiagonal qd solver.

1. Tasks sum the integer vectors; the exact sums S and the number of vectors n give the centre S / n.
2. Blockwise QR: a task reduces its centred rows block by block to one triangle, triangles are reduced in groups, level
   by level, until one d x d triangle R is left. Rows never meet in one place; the cross product of the data, which would
   square its condition, is never formed.
3. The driver works on R alone (its size is that of the dimensions, whatever the number of rows): Householder
   reflections bidiagonalise R; dqds finds the squared singular values to high relative accuracy, each step shifted by a
   lower bound of the least one (of the trace of the inverse, which the zero-shift step yields); twisted factorisations
   (stationary from the top, progressive from the bottom, joined where the twist is least) give the bidiagonal's
   right singular vectors, those of close values are made orthogonal; reflections carry them back.
4. Tasks project their centred rows on the leading directions, divide by the root of the eigenvalue, and compute the
   exact deviations in integers; a last pass sums the whitened rows' covariance.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out; repeated rows
count each; a null id is kept; a table without vectors gives an empty result; vectors of different lengths are refused;
entries must be below 2^42 in size; a direction without variance (an eigenvalue of rounding size, as with equal
vectors) is explained 0 and whitened null; eigenvalues that tie get some orthogonal directions of their space; other
columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_only, materialize, ship

COMPONENTS = 8
#: Rows reduced together, and triangles' bytes reduced by one task.
BLOCK_ROWS, GROUP_BYTES = 4096, 64 << 20
EPS = np.finfo(np.float64).eps
#: Neighbouring eigenvalues closer than this share have their vectors made orthogonal.
CLOSE = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder bidiagonalisation: (diagonal, superdiagonal, V) with r = U B V^T."""
    b, d = r.astype(np.float64).copy(), r.shape[0]
    v = np.eye(d)

    def reflector(x):
        x = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return None
        x[0] += math.copysign(size, x[0])
        return x / np.linalg.norm(x)

    for k in range(d):
        h = reflector(b[k:, k])
        if h is not None:
            b[k:, k:] -= 2 * np.outer(h, h @ b[k:, k:])
        if k < d - 2:
            h = reflector(b[k, k + 1:])
            if h is not None:
                b[k:, k + 1:] -= 2 * np.outer(b[k:, k + 1:] @ h, h)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ h, h)
    return np.diagonal(b).copy(), np.diagonal(b, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One dqds transform: (q, e, least d, sum of 1 / d); a d below 0 says that the shift was too large."""
    n = len(q)
    d, least, inverse = q[0] - shift, math.inf, 0.0
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        least = min(least, d)
        if d <= 0:
            return new_q, new_e, -1.0, math.inf
        inverse += 1 / d
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    new_q[-1] = d
    return new_q, new_e, min(least, d), inverse + (1 / d if d > 0 else math.inf)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling."""
    scale = max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(upper), initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    floor = 1e-200
    q = [max(x, floor) for x in np.square(diagonal / scale).tolist()]
    e = np.square(upper / scale).tolist()
    found, blocks = [], [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            small = [i for i in range(n - 1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] < floor]
            if n - 2 in small:
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if small:
                i = small[-1]
                blocks.append((q[:i + 1], e[:i], moved))
                q, e = q[i + 1:], e[i + 1:]
                continue
            # the zero-shift step brings the least value down and bounds it from below: 1 / trace of the inverse
            q, e, least, inverse = _step(q, e, 0.0)
            shift = (1 / inverse) * (1 - 8 * EPS * n) if least > 0 and inverse < math.inf else 0.0
            if shift > 0 and moved + shift > moved:
                new_q, new_e, least, _ = _step(q, e, shift)
                if least >= 0:
                    q, e, moved = [max(x, floor) for x in new_q], new_e, moved + shift
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> tuple[np.ndarray, tuple]:
    """The unit vector z of B^T B for an eigenvalue, by the twisted factorisation of B^T B - value, and its top-down
    factors (pivots, multipliers)."""
    n = len(diagonal)
    tiny = EPS * EPS * max(value, np.max(diagonal * diagonal, initial=0.0), 1e-290)
    diagonal = np.where(np.abs(diagonal) < 1e-150, 1e-150, diagonal)
    dd, low = diagonal * diagonal, upper / diagonal[:-1]
    pivots, factors, top = np.empty(n), np.empty(max(0, n - 1)), np.empty(n)
    top[0] = -value
    for i in range(n - 1):
        pivots[i] = top[i] + dd[i]
        if abs(pivots[i]) < tiny:
            pivots[i] = -tiny
        factors[i] = dd[i] * low[i] / pivots[i]
        top[i + 1] = factors[i] * low[i] * top[i] - value
    pivots[-1] = top[-1] + dd[-1] if abs(top[-1] + dd[-1]) >= tiny else -tiny
    back, under = np.empty(max(0, n - 1)), np.empty(n)
    under[-1] = dd[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = dd[i] * low[i] * low[i] + under[i + 1]
        if abs(pivot) < tiny:
            pivot = -tiny
        t = dd[i] / pivot
        back[i] = low[i] * t
        under[i] = under[i + 1] * t - value
    r = int(np.argmin(np.abs(top + under + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -factors[i] * z[i + 1]
        if abs(z[i]) < 1e-150:
            break
    for i in range(r, n - 1):
        z[i + 1] = -back[i] * z[i]
        if abs(z[i + 1]) < 1e-150:
            break
    size = np.linalg.norm(z)
    return (z / size if np.isfinite(size) and size > 0 else np.zeros(n)), (pivots, factors)


def _solve(factors: tuple, x: np.ndarray) -> np.ndarray:
    """x -> (B^T B - value)^-1 x by the top-down factors."""
    pivots, low = factors
    y = x.copy()
    for i in range(len(low)):
        y[i + 1] -= low[i] * y[i]
    y /= pivots
    for i in range(len(low) - 1, -1, -1):
        y[i] -= low[i] * y[i + 1]
    return y / np.max(np.abs(y))


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of B^T B, a column for each of the falling ``values``."""
    scale = max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(upper), initial=0.0), 1e-300)
    diagonal, upper, values = diagonal / scale, upper / scale, values / (scale * scale)
    out = np.zeros((len(diagonal), len(values)))
    rng, begin = np.random.default_rng(7), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * values[k - 1]:
            begin = k
        z, factors = twisted(diagonal, upper, value)
        near = out[:, begin:k]
        for attempt in range(8):
            z -= near @ (near.T @ z)
            size = np.linalg.norm(z)
            if size > 0.1:  # little was in the others' space
                z /= size
                z -= near @ (near.T @ z)
                break
            z = _solve(factors, rng.standard_normal(len(z)) if attempt % 2 == 0 or size == 0 else z / size)
            z /= np.linalg.norm(z)
        out[:, k] = z / np.linalg.norm(z)
    return out


def principal_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions as columns, squared singular values, sum of all squared singular values) of a triangle; values of
    rounding size count as 0, with a direction of zeros."""
    diagonal, upper, v = bidiagonal(r)
    values = dqds(diagonal, upper)
    values[values <= values[0] * (len(values) * EPS) ** 2] = 0.0
    out = np.zeros((len(values), min(most, len(values))))
    real = int(np.count_nonzero(values[:most]))
    if real:
        out[:, :real] = v @ right_vectors(diagonal, upper, values[:real])
    return out, values[:most], float(values.sum())


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off in integers, so nothing cancels."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def deviations(x: np.ndarray, sums: list[int], n: int) -> pa.Array:
    """Exact sums of (n x - S)^2 by row, as decimals of 38 digits (null beyond)."""
    d, most = x.shape[1], n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 54:
        y = np.abs(np.int64(n) * x - np.array(sums, np.int64))
        if most * most * d < 1 << 63:
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        high, low = y >> 27, y & ((1 << 27) - 1)
        parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))] if d < 512 else None
        if parts:
            return pa.array([Decimal((a << 54) + (b << 28) + c) for a, b, c in zip(*parts)], pa.decimal128(38, 0))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def integer_vectors(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(1024 c) + 100000 of each entry, rows with bad entries left out."""
    v = F.col(vector_col)

    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf))

    good = docs.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: bad(c.cast("double"))))
    return good.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * 1024).cast("bigint") + 100_000).alias("x"))


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, S): tasks add up their batches, the driver gets a row per dimension."""

    def run(batches):
        keep_only("whitening")
        for b in batches:
            if b.num_rows:
                lengths = np.diff(b.column(1).offsets.to_numpy())
                if (lengths != lengths[0]).any():
                    raise ValueError("vectors of different lengths")
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([_matrix(b.column(1)).sum(axis=0)], pa.list_(pa.int64()))], ["n", "s"])

    rows = vectors.mapInArrow(run, "n bigint, s array<bigint>").select("n", F.posexplode("s").alias("pos", "s"))
    rows = rows.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


def triangle(vectors: DataFrame, sums: list[int], n: int) -> np.ndarray:
    """R of the centred rows' QR factorisation."""
    d = len(sums)

    def packed(k, r):
        full = np.zeros((d, d))
        full[:r.shape[0]] = r
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([full.tobytes()], pa.binary())], ["k", "r"])

    def run(batches):
        keep_only("whitening")
        r = np.zeros((0, d))
        for b in batches:
            for begin in range(0, b.num_rows, BLOCK_ROWS):
                rows = _centred(_matrix(b.column(1).slice(begin, BLOCK_ROWS)), sums, n)
                r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        yield packed(TaskContext.get().partitionId(), r)

    def reduce(key, table):
        r = np.zeros((0, d))
        for part in table.column("r").to_pylist():
            r = np.linalg.qr(np.vstack([r, np.frombuffer(part).reshape(d, d)]), mode="r")
        return pa.Table.from_batches([packed(key[0].as_py(), r)])

    fan = max(2, GROUP_BYTES // (8 * d * d))
    parts = materialize(vectors.mapInArrow(run, "k bigint, r binary"), "white-triangles")
    count = parts.count()
    while count > 1:
        groups = math.ceil(count / fan)
        parts = materialize(parts.withColumn("g", F.pmod(F.col("k"), F.lit(groups))).groupBy("g").applyInArrow(
            reduce, "k bigint, r binary"), "white-triangles")
        count = parts.count()
    return np.frombuffer(parts.first().r).reshape(d, d)


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector: (id, n, deviation decimal(38,0), whitened array, explained array, identity_error)."""
    spark = docs.sparkSession
    ship(spark)
    vectors = integer_vectors(docs, id_col, vector_col)
    n, sums = exact_sums(vectors)
    ids = vectors.schema["id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"id {ids}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    directions, squares, trace = principal_directions(triangle(vectors, sums, n), min(components, len(sums)))
    real = squares > 0
    scale = np.where(real, np.sqrt(np.where(real, squares, 1.0) / n), np.nan)

    def project(batches):
        keep_only("whitening")
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                w = _centred(x, sums, n) @ directions / scale
                flat = pa.array(w.reshape(-1), mask=np.isnan(w).reshape(-1))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), deviations(x, sums, n), rows], ["id", "deviation", "whitened"])

    out = materialize(vectors.mapInArrow(project, f"id {ids}, deviation decimal(38,0), whitened array<double>"), "white-rows")

    def products(batches):
        keep_only("whitening")
        for b in batches:
            if b.num_rows:
                w = _matrix(b.column(0))[:, real]
                both = np.vstack([w.T @ w, w.sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array([both.reshape(-1)], pa.list_(pa.float64()))], ["p"])

    error = 0.0
    if real.any():
        rows = out.select("whitened").mapInArrow(products, "p array<double>").select(F.posexplode("p").alias("pos", "p"))
        total = np.array([r.p for r in rows.groupBy("pos").agg(F.sum("p").alias("p")).orderBy("pos").collect()]).reshape(-1, int(real.sum())) / n
        error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(int(real.sum()))).max())
    explained = np.where(real, squares, 0.0) / trace if trace > 0 else np.zeros(len(squares))
    return out.select("id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(float(x)) for x in explained]).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """A row per vector and component; ``deviation`` is null where it passes 64 bits (the operator's decimal has it)."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = out.select(F.col("id").alias("vec_id"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error",
                     F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                      F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
