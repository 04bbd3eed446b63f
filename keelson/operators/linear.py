"""Logistic regression: scoring (M3), full-batch training by gradient descent
(M1) and Adam (M2), fixed-point scoring drift (M9).

Training keeps the data on the executors. Where the rows fit the tasks that the
cluster runs at a time (TASK_BYTES each), all epochs are one barrier stage: each
task keeps its rows in slices, HELD_BYTES of them in memory and the rest in a
file of its own; the tasks hand each other d + 3 sums per epoch
and apply the same update (:func:`_fit_in_stage`). Where they do not fit, each
epoch is ONE aggregate that returns d + 1 gradient sums, the loss and the count;
only those numbers reach the driver, where the update rule runs, and weights go
back as literals in the next epoch's expression, so the plan never grows. Both
sum the same terms. The input is cut from its lineage once (reliable
checkpoint), so a lost executor recomputes a partition from the checkpoint, not
from the whole feature pipeline.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot_literal, fixed_point
from ..functions.scalar import sigmoid, threshold_label
from ..session import cut_packed, release, scratch_path, ship_package
from .allreduce import SharedSum


# Target in-memory size of one partition of the training table.
TRAIN_PARTITION_BYTES = 128 * 1024 * 1024


# Terms of a logit that are summed in one chain.
TERMS = 64


@dataclass
class LinearModel:
    weights: list[float]
    bias: float
    history: list[dict] = field(default_factory=list)


def linear_logit(features: str, weights: Sequence[float], bias: float) -> Column:
    return dot_literal(features, weights) + F.lit(float(bias))


def linear_score(df: DataFrame, features: str, weights: Sequence[float], bias: float, out: str = "p") -> DataFrame:
    """M3 + F9: ``sigmoid(w . x + b)``, a native expression (codegen, no Python)."""
    return df.withColumn(out, sigmoid(linear_logit(features, weights, bias)))


def predict(df: DataFrame, features: str, model: LinearModel, p: str = "p", pred: str = "pred") -> DataFrame:
    return linear_score(df, features, model.weights, model.bias, p).withColumn(pred, threshold_label(p))


class _EpochRunner:
    """Runs the per-epoch aggregate over the prepared training table.

    The table is registered as a global temp view and queried from a child
    session (same context and cache, own SQL conf) with adaptive execution off:
    a one-row global aggregate gains nothing from re-planning, and with it off
    the new generated code of each epoch (weights are literals) is compiled
    once instead of per query stage. The caller's session is not touched."""

    def __init__(self, data: DataFrame, cols: list[str]):
        self.cols = cols
        self.view = f"keelson_train_{uuid.uuid4().hex}"
        data.createOrReplaceGlobalTempView(self.view)
        self.session = data.sparkSession.newSession()
        self.session.conf.set("spark.sql.adaptive.enabled", "false")

    def _logit(self, w: np.ndarray, b: float) -> str:
        """Sums of TERMS terms, each left to right from 0.0, then the sum of the sums: the same text for any width, and
        up to TERMS features the same bits as :func:`dot_literal`."""
        parts = []
        for k in range(0, max(len(self.cols), 1), TERMS):
            z = "0.0D"
            for c, v in zip(self.cols[k:k + TERMS], w[k:k + TERMS]):
                z = f"({z} + {c} * {_sql_double(v)})"
            parts.append(z)
        return f"({' + '.join(parts)} + {_sql_double(b)})"

    def stats(self, w: np.ndarray, b: float) -> tuple:
        """Gradient (mean), bias gradient and mean loss at weights (w, b) over the training rows, and the accuracy over
        the validation rows (None without any)."""
        fit = "CASE WHEN NOT _v THEN {} END".format
        grads = ", ".join(f"sum({fit(f'(_p - _y) * {c}')}) AS g{j}" for j, c in enumerate(self.cols))
        q = (f"SELECT {grads}{', ' if grads else ''}sum({fit('_p - _y')}) AS gb, sum({fit(_BCE_SQL)}) AS loss, count_if(NOT _v) AS n, "
             f"avg(CASE WHEN _v THEN CASE WHEN (_p > 0.5D) = (_y = 1D) THEN 1.0D ELSE 0.0D END END) AS val "
             f"FROM (SELECT *, 1.0D / (1.0D + exp(-{self._logit(w, b)})) AS _p FROM global_temp.{self.view})")
        row = self.session.sql(q).collect()[0]   # a global aggregate: exactly one row, no limit operator
        n = row["n"]
        g = np.array([row[f"g{j}"] for j in range(len(self.cols))], dtype=np.float64) / n
        return g, row["gb"] / n, row["loss"] / n, row["val"]

    def close(self):
        self.session.catalog.dropGlobalTempView(self.view)


def _sql_double(v: float) -> str:
    v = float(v)
    return f"{v!r}D" if np.isfinite(v) else f"CAST('{v!r}' AS DOUBLE)"


_BCE_SQL = ("-(_y * CASE WHEN _p > 0 THEN greatest(ln(_p), -100.0D) ELSE -100.0D END"
            " + (1.0D - _y) * CASE WHEN _p < 1 THEN greatest(ln(1.0D - _p), -100.0D) ELSE -100.0D END)")


def _checked(data: DataFrame, features: str, label: str, checkpoint: bool, validation: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """(_f, _l, _v) rows with the flag _v of validation rows, their width and number. The upstream pipeline runs ONCE: its
    rows are checkpointed, the width and the count are taken from the checkpoint, and every row's width is checked."""
    base = data.select(F.col(features).alias("_f"), F.col(label).cast("double").alias("_l"), F.lit(False).alias("_v"))
    if validation is not None:
        base = base.unionByName(validation.select(F.col(features).alias("_f"), F.col(label).cast("double").alias("_l"), F.lit(True).alias("_v")))
    base = cut_packed(base) if checkpoint else base.cache()
    row = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_f")).alias("d")).first()
    d = int(row["d"] or 0)
    checked = F.when(F.size("_f") == F.lit(d), F.col("_l")).otherwise(F.raise_error(F.lit(f"every feature array must have {d} values")))
    return base.select("_f", checked.alias("_l"), "_v"), d, row["n"]


def _flat(base: DataFrame, d: int, n: int) -> tuple[DataFrame, list[str]]:
    """Flat double columns x0..x{d-1}, _y and _v over partitions sized by bytes (never fewer than the cores; upstream AQE
    may have coalesced a small input)."""
    cols = [f"x{j}" for j in range(d)]
    flat = base.select(*[F.col("_f")[j].cast("double").alias(c) for j, c in enumerate(cols)], F.col("_l").alias("_y"), "_v")
    parts = max(base.sparkSession.sparkContext.defaultParallelism, math.ceil(n * (d + 1) * 8 / TRAIN_PARTITION_BYTES))
    # in memory on top of the checkpoint: a lost block is re-read from the
    # checkpoint files, never recomputed from the feature pipeline
    return flat.repartition(parts).cache(), cols


#: Bytes of training rows that a task of the barrier stage goes through, and of those in its memory: the rest is in a file.
TASK_BYTES = 512 * 1024 * 1024
HELD_BYTES = 64 * 1024 * 1024
#: Bytes of a slice, which is worked on at a time.
SLICE_BYTES = 1024 * 1024
#: Tasks of a small training: more would only wait for each other. Larger ones get a task for so many bytes.
FEW_TASKS = 4
SPREAD_BYTES = 8 * 1024 * 1024


class _Descent:
    """Full-batch gradient descent."""

    def __init__(self, lr: float):
        self.lr = lr

    def step(self, w: np.ndarray, b: float, g: np.ndarray, gb: float) -> tuple[np.ndarray, float]:
        return w - self.lr * g, b - self.lr * gb


class _Adam:
    """Full-batch Adam (published update rule, bias-corrected moments)."""

    def __init__(self, lr: float, betas: tuple[float, float], eps: float):
        self.lr, self.betas, self.eps, self.t = lr, betas, eps, 0
        self.m = self.v = 0.0

    def step(self, w: np.ndarray, b: float, g: np.ndarray, gb: float) -> tuple[np.ndarray, float]:
        self.t += 1
        (b1, b2), grad = self.betas, np.append(g, gb)
        self.m = b1 * self.m + (1 - b1) * grad
        self.v = b2 * self.v + (1 - b2) * grad * grad
        step = self.lr * (self.m / (1 - b1 ** self.t)) / (np.sqrt(self.v / (1 - b2 ** self.t)) + self.eps)
        return w - step[:-1], b - step[-1]


class _TaskRows:
    """A task's rows in slices with their columns apart, x (d, rows) and y. Training and validation rows are in slices of
    their own; rows with nulls are counted, but add nothing to the sums. Slices beyond HELD_BYTES are in an unnamed file."""

    def __init__(self, batches, d: int):
        self.d, self.rows, self.slices, self.file, self.largest = d, 0, [], None, 0
        room, step = HELD_BYTES, max(64, SLICE_BYTES // (8 * (d + 1)))
        for t in batches:
            for s in range(0, t.num_rows, step):
                part = t.slice(s, step)
                flat, label = part.column(0).flatten(), part.column(1)
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                y, v = label.to_numpy(zero_copy_only=False).astype(np.float64), part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                known = _valid(label) & _valid(flat).reshape(-1, d).all(axis=1)
                self.rows += int((~v).sum())
                for validation in (False, True):
                    kept = known & (v == validation)
                    n = int(kept.sum())
                    if n:
                        cols = np.empty((d + 1, n))
                        cols[:d], cols[d] = x[kept].T, y[kept]
                        room -= cols.nbytes
                        self._keep(cols, n, validation, room >= 0)

    def _keep(self, cols: np.ndarray, n: int, validation: bool, held: bool) -> None:
        if not held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(memoryview(cols).cast("B"))
            self.largest = max(self.largest, cols.size)
        self.slices.append((cols if held else None, n, validation))

    def __iter__(self):
        """(columns, whether they are validation rows)"""
        read = np.empty(self.largest)
        if self.file:
            self.file.seek(0)
        for cols, n, validation in self.slices:
            if cols is None:
                cols = read[:(self.d + 1) * n]
                if self.file.readinto(memoryview(cols).cast("B")) != cols.nbytes:
                    raise EOFError("the file of a task's rows is short")
                cols = cols.reshape(self.d + 1, n)
            yield cols, validation


def _valid(c: pa.Array) -> np.ndarray:
    return c.is_valid().to_numpy(zero_copy_only=False)


def _local_stats(rows: _TaskRows, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over a task's rows: gradient, bias gradient, loss, rows; right and all validation rows. Logits are summed in
    chains of TERMS terms, as :meth:`_EpochRunner._logit` does."""
    d = rows.d
    out = np.zeros(d + 5)
    out[d + 2] = rows.rows
    for cols, validation in rows:
        x, y = cols[:d], cols[d]
        z, term = np.zeros(len(y)), np.empty(len(y))
        for k in range(0, d, TERMS):
            part = z if k == 0 else np.zeros(len(y))
            for j in range(k, min(k + TERMS, d)):
                part += np.multiply(x[j], w[j], out=term)
            z = part if k == 0 else z + part
        with np.errstate(all="ignore"):
            p = 1.0 / (1.0 + np.exp(-(z + b)))
            if validation:
                out[d + 3] += ((p > 0.5) == (y == 1)).sum()
                out[d + 4] += len(y)
                continue
            loss = -(y * np.where(p > 0, np.maximum(np.log(p), -100.0), -100.0) + (1 - y) * np.where(p < 1, np.maximum(np.log(1 - p), -100.0), -100.0))
        r = p - y
        out[:d] += x @ r
        out[d] += r.sum()
        out[d + 1] += loss.sum()
    return out


def _fit_in_stage(data: DataFrame, d: int, epochs: int, rule, w: np.ndarray, b: float, validate: bool, tasks: int) -> list[dict]:
    """The history of a training in one barrier stage; ``data`` has columns _f, _l, _v."""
    dealt = data.repartition(tasks)
    folder = scratch_path(data.sparkSession, f"training/{uuid.uuid4().hex}")

    def run(batches):
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        held = _TaskRows(batches, d)
        together = SharedSum(ctx, folder)
        weights, bias, rows = w, b, []
        for epoch in range(1, epochs + 1 + validate):
            *g, gb, loss, n, right, seen = together.sum(_local_stats(held, weights, bias))
            if rows:
                rows[-1][4] = right / seen if seen else None
            if epoch <= epochs:
                weights, bias = rule.step(weights, bias, np.array(g) / n, gb / n)
                rows.append([epoch, loss / n, float(bias), weights.tolist(), None])
        if ctx.partitionId() == 0:
            names = ["epoch", "loss", "bias", "weights", "val"]
            types = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    out = dealt.mapInArrow(run, "epoch int, loss double, bias double, weights array<double>, val double", barrier=True).collect()  # a row per epoch
    return [{"epoch": r["epoch"], "loss": r["loss"], "bias": r["bias"], "weights": list(r["weights"]), "val_accuracy": r["val"]}
            for r in sorted(out, key=lambda r: r["epoch"])]


def _fit(data: DataFrame, features: str, label: str, epochs: int, rule, init: np.ndarray | None, init_bias: float, checkpoint: bool,
         validation: DataFrame | None) -> LinearModel:
    spark = data.sparkSession
    ship_package(spark)
    base, d, n = _checked(data, features, label, checkpoint, validation)
    w, b = np.zeros(d) if init is None else np.asarray(init, dtype=np.float64), float(init_bias)
    if not n or not epochs:
        return LinearModel(w.tolist(), b, [])
    cores = spark.sparkContext.defaultParallelism
    size = n * (d + 2) * 8
    tasks = max(1, math.ceil(size / TASK_BYTES))
    if tasks <= cores:
        hist = _fit_in_stage(base, d, epochs, rule, w, b, validation is not None, min(cores, max(tasks, FEW_TASKS, math.ceil(size / SPREAD_BYTES))))
        release(spark)
        return LinearModel(hist[-1]["weights"], hist[-1]["bias"], hist)
    slim, cols = _flat(base, d, n)
    hist = []
    run = _EpochRunner(slim, cols)
    try:
        for epoch in range(1, epochs + 1):
            g, gb, loss, seen = run.stats(w, b)
            if hist:
                hist[-1]["val_accuracy"] = seen
            w, b = rule.step(w, b, g, gb)
            hist.append({"epoch": epoch, "loss": loss, "bias": float(b), "weights": w.tolist(), "val_accuracy": None})
        if validation is not None and hist:
            hist[-1]["val_accuracy"] = run.stats(w, b)[3]
    finally:
        run.close()
        slim.unpersist()
    return LinearModel(w.tolist(), float(b), hist)


def train_gd(data: DataFrame, features: str, label: str, epochs: int = 200, lr: float = 0.1,
             init: Sequence[float] | None = None, init_bias: float = 0.0, checkpoint: bool = True,
             validation: DataFrame | None = None) -> LinearModel:
    """M1: full-batch gradient descent on mean binary cross-entropy. ``history``
    holds, per epoch, the loss at the weights before the step and the weights after it;
    with ``validation`` (rows like ``data``) also their accuracy after the step, from the
    same pass that takes the next gradient."""
    return _fit(data, features, label, epochs, _Descent(lr), init, init_bias, checkpoint, validation)


def train_adam(data: DataFrame, features: str, label: str, epochs: int = 10, lr: float = 0.01,
               betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, checkpoint: bool = True) -> LinearModel:
    """M2: full-batch Adam (published update rule, bias-corrected moments)."""
    return _fit(data, features, label, epochs, _Adam(lr, betas, eps), None, 0.0, checkpoint, None)


def history_frame(spark, model: LinearModel) -> DataFrame:
    """Training history as a small DataFrame: epoch, loss, bias, w0..w{d-1}."""
    d = len(model.weights)
    rows = [(h["epoch"], float(h["loss"]), float(h["bias"]), *[float(x) for x in h["weights"]]) for h in model.history]
    cols = ["epoch long", "loss double", "bias double"] + [f"w{j} double" for j in range(d)]
    return spark.createDataFrame(rows, ", ".join(cols))


def fixed_point_scores(df: DataFrame, features: str, weights: Sequence[float], bias: float,
                       frac_bits: Sequence[int], p: str = "p") -> DataFrame:
    """M9: scores with features and weights rounded to the grid 2^-bits, next to the
    plain score, as one row per (row, variant) carrying ``{p}_plain`` as well. Not encryption and not a noise model:
    only the drift that fixed-point rounding alone causes."""
    variants = [F.struct(F.lit("plain").alias("variant"), F.col("_p_plain").alias(p))]
    for bits in frac_bits:
        s = float(2 ** bits)
        wq = [float(np.rint(x * s) / s) for x in weights]
        bq = float(np.rint(bias * s) / s)
        logit = dot_literal(fixed_point(features, bits), wq) + F.lit(bq)
        variants.append(F.struct(F.lit(f"fixed{bits}").alias("variant"), sigmoid(logit).alias(p)))
    # the plain score rides along in every variant row, so drift needs no self-join
    base = df.withColumn("_p_plain", sigmoid(linear_logit(features, weights, bias)))
    out = base.select("*", F.explode(F.array(*variants)).alias("_v")).select("*", "_v.*").drop("_v")
    return out.withColumnRenamed("_p_plain", f"{p}_plain")
