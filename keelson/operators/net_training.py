"""Dense nets trained by minibatches in ONE barrier stage.

Every row stays in the memory of its task for the whole training; the tasks run at the same time. A step takes one
minibatch of exactly ``batch_size`` rows, wherever they lie: each task sums the gradient over its own rows of the batch,
the tasks add up their sums (:mod:`~keelson.operators.allreduce`), and each applies the same update to its own copy of the
weights and of the optimiser's state, so the copies stay equal. Nothing but sums of the model's size passes between
tasks, and no job is planned per step.

The batches are exact and reshuffled per epoch (:func:`batch_numbers`: ranks in seeded hash order, found by Spark before
the stage), so the result does not depend on the number of tasks beyond rounding. After each epoch one task writes the
state to the shared folder; a stage that is repeated after a lost executor, or a later call with the same ``folder``,
goes on from the last state written.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, ship_package
from ..sources.shared import open_shared
from ..sources.weights import WEIGHTS_SCHEMA, collect_layers
from .allreduce import SharedSum
from .nets import Dense, Net, gradient
from .ranking import hash_rank

#: Bytes of rows that a task holds; more rows take more tasks, as far as the cluster has cores for all at once.
TASK_BYTES = 1 << 30
#: Tasks of a small training: more would only wait for each other.
FEW_TASKS = 4


def batch_numbers(ids: DataFrame, id_col: str, batch_size: int, epochs: int, seed=0) -> DataFrame:
    """(id, batches): the minibatch of each row in each epoch, as :func:`~keelson.operators.sample.minibatch_ids` deals
    them, for all epochs by one exact ranking within the epochs."""
    x = ids.select(id_col).withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ranked = hash_rank(x.withColumn("_k", F.concat_ws("|", F.col("_e"), F.col(id_col))), "_k", f"{seed}", by=["_e"], rank_col="_rank")
    at = F.struct(F.col("_e").alias("e"), F.floor((F.col("_rank") - 1) / F.lit(batch_size)).alias("b"))
    listed = ranked.groupBy(id_col).agg(F.sort_array(F.collect_list(at)).alias("_l"))
    once = F.when(F.size("_l") == epochs, F.transform("_l", lambda s: s["b"])).otherwise(F.raise_error(F.lit("ids of training rows must be unique")))
    return listed.select(id_col, once.alias("batches"))


class Optimizer:
    """Adam (published update rule, bias-corrected moments) or gradient descent with momentum, on one flat vector."""

    def __init__(self, kind: str, size: int, lr: float, momentum: float, betas: tuple[float, float], eps: float):
        if kind not in ("adam", "sgd"):
            raise ValueError(f"unknown optimizer {kind}")
        self.kind, self.lr, self.momentum, self.betas, self.eps = kind, lr, momentum, betas, eps
        self.first, self.second, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, weights: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.steps += 1
        if self.kind == "sgd":
            self.first = self.momentum * self.first + grad
            return weights - self.lr * self.first
        b1, b2 = self.betas
        self.first = b1 * self.first + (1 - b1) * grad
        self.second = b2 * self.second + (1 - b2) * grad * grad
        up = self.first / (1 - b1 ** self.steps)
        return weights - self.lr * up / (np.sqrt(self.second / (1 - b2 ** self.steps)) + self.eps)


def flatten_params(net: Net, params: dict) -> np.ndarray:
    """Weights then bias of each dense layer, in layer order, as :func:`~keelson.operators.nets.gradient` has them."""
    return np.concatenate([np.concatenate([params[x.name][0].ravel(), params[x.name][1]]) for x in net.layers if isinstance(x, Dense)])


def unflatten_params(net: Net, flat: np.ndarray) -> dict:
    out, at = {}, 0
    for name, (n_out, n_in) in net.shapes().items():
        size = n_out * n_in
        out[name] = (flat[at:at + size].reshape(n_out, n_in), flat[at + size:at + size + n_out])
        at += size + n_out
    return out


def _state_files(folder: str) -> dict[int, str]:
    from pyarrow.fs import FileSelector

    fs, place = open_shared(folder)
    found = fs.get_file_info(FileSelector(place, allow_not_found=True))
    return {int(f.base_name[6:-4]): f.path for f in found if f.base_name.startswith("epoch-") and f.base_name.endswith(".npz")}


def _save_state(folder: str, epoch: int, **arrays) -> None:
    fs, place = open_shared(folder)
    held = io.BytesIO()
    np.savez(held, **arrays)
    fs.create_dir(place, recursive=True)
    name = f"{place}/tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(name) as out:
        out.write(held.getvalue())
    fs.move(name, f"{place}/epoch-{epoch:06d}.npz")  # complete or not there


def _load_state(folder: str, epoch: int) -> dict:
    fs, place = open_shared(folder)
    with fs.open_input_file(f"{place}/epoch-{epoch:06d}.npz") as f:
        return dict(np.load(io.BytesIO(f.read())))


def train_net_minibatch(images: DataFrame, net: Net, weights: DataFrame, label: str = "label", epochs: int = 10, batch_size: int = 64,
                        optimizer: str = "adam", lr: float = 0.001, momentum: float = 0.0, betas: tuple[float, float] = (0.9, 0.999),
                        eps: float = 1e-8, seed=0, id_col: str = "image_id", pixels_col: str = "pixels", tasks: int | None = None,
                        folder: str | None = None) -> tuple[DataFrame, list[float]]:
    """Dense nets with square or ReLU activations on mean softmax cross-entropy. Returns the trained weights table and
    each epoch's mean of the batches' losses before their step.

    Rows without label or pixels are left out; ids must be unique; without rows the weights stay as they are. ``folder``
    names a folder of the shared storage for the states (a new one if None)."""
    spark = images.sparkSession
    ship_package(spark)
    start = flatten_params(net, collect_layers(weights, net.shapes()))
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(pixels_col).alias("px"), F.col(label).cast("int").alias("y"))
    rows = cut_lineage(rows.where(F.col("px").isNotNull() & F.col("y").isNotNull()))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("px")), F.lit(0))).first()
    n_batches = -(-n // batch_size)
    folder = folder or scratch_path(spark, f"training/{uuid.uuid4().hex}")
    if not n or not epochs:
        return _weights_frame(spark, net, start), []
    cores = spark.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(cores, max(FEW_TASKS, math.ceil(n * width * 8 / TASK_BYTES))))
    dealt = cut_lineage(rows.join(batch_numbers(rows, "id", batch_size, epochs, seed), "id").select("px", "y", "batches").repartition(tasks))
    sent = spark.sparkContext.broadcast(start)

    def run(batches):
        ctx = BarrierTaskContext.get()
        tables = [b for b in batches if b.num_rows]
        px = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for b in tables]
        x = np.concatenate(px) if px else np.zeros((0, 0))
        y = np.concatenate([b.column(1).to_numpy() for b in tables]) if tables else np.zeros(0, np.int32)
        of = np.concatenate([b.column(2).flatten().to_numpy().reshape(b.num_rows, -1) for b in tables]) if tables else np.zeros((0, epochs), np.int64)
        own = ctx.partitionId() == 0
        together = SharedSum(ctx, folder, str(max([0, *(e for e in _state_files(folder) if e <= epochs)])) if own else "")
        done = int(together.gathered[0])
        rule = Optimizer(optimizer, len(sent.value), lr, momentum, betas, eps)
        flat, losses = sent.value, []
        if done:
            state = _load_state(folder, done)
            flat, losses = state["flat"], state["losses"].tolist()
            rule.first, rule.second, rule.steps = state["first"], state["second"], int(state["steps"])
        for epoch in range(done, epochs):
            order = np.argsort(of[:, epoch], kind="stable")
            cuts = np.searchsorted(of[order, epoch], np.arange(n_batches + 1))
            total = 0.0
            for b in range(n_batches):
                mine, part = order[cuts[b]:cuts[b + 1]], None
                if len(mine):
                    g, loss = gradient(net, unflatten_params(net, flat), x[mine], y[mine])
                    part = np.append(g, [loss, len(mine)])
                sums = together.sum(part)
                total += sums[-2] / sums[-1]
                flat = rule.step(flat, sums[:-2] / sums[-1])
            losses.append(total / n_batches)
            if own:
                _save_state(folder, epoch + 1, flat=flat, losses=np.array(losses), first=rule.first, second=rule.second, steps=np.array(rule.steps))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([len(losses)], pa.int32())], ["epochs"])

    dealt.mapInArrow(run, "epochs int", barrier=True).collect()  # one row: the task that writes is done
    sent.unpersist()
    state = _load_state(folder, epochs)
    return _weights_frame(spark, net, state["flat"]), state["losses"].tolist()


def _weights_frame(spark, net: Net, flat: np.ndarray) -> DataFrame:
    rows = [(name, o, i, float(v)) for name, (wm, bias) in unflatten_params(net, flat).items()
            for o, line in enumerate(np.column_stack([bias, wm])) for i, v in enumerate(line, -1)]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)
