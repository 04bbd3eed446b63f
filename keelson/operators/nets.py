"""Batch scoring of dense and convolutional nets from a weights table (M6-M8b),
the relational form of convolution and pooling (M8c), and MLP training (M10).

Scoring runs per Arrow batch in ``mapInPandas``: the model (checked against a
byte bound) is broadcast once, each batch becomes one matrix, convolutions are
strided NumPy windows times a matrix. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .joins import sized_broadcast
from ..sources.weights import collect_layers


@dataclass(frozen=True)
class Conv:
    name: str
    out_channels: int
    kernel: int
    stride: int = 1


@dataclass(frozen=True)
class Dense:
    name: str
    n_out: int


@dataclass(frozen=True)
class Pool:
    size: int = 2


@dataclass(frozen=True)
class Act:
    kind: str  # "square" | "relu"


@dataclass(frozen=True)
class Net:
    channels: int
    height: int
    width: int
    layers: tuple

    def shapes(self) -> dict[str, tuple[int, int]]:
        """Weight shapes (n_out, n_in) per named layer, walking the tensor shape."""
        c, h, w = self.channels, self.height, self.width
        flat = None
        out = {}
        for layer in self.layers:
            if isinstance(layer, Conv):
                out[layer.name] = (layer.out_channels, c * layer.kernel * layer.kernel)
                c = layer.out_channels
                h = (h - layer.kernel) // layer.stride + 1
                w = (w - layer.kernel) // layer.stride + 1
            elif isinstance(layer, Pool):
                h, w = h // layer.size, w // layer.size
            elif isinstance(layer, Dense):
                n_in = flat if flat is not None else c * h * w
                out[layer.name] = (layer.n_out, n_in)
                flat = layer.n_out
        return out

    def n_outputs(self) -> int:
        last = [x for x in self.layers if isinstance(x, Dense)][-1]
        return last.n_out


def forward(net: Net, params: dict, x: np.ndarray) -> np.ndarray:
    """NumPy forward pass of a batch (B, C*H*W) -> logits (B, n_out)."""
    b = x.shape[0]
    t = x.reshape(b, net.channels, net.height, net.width)
    for layer in net.layers:
        if isinstance(layer, Conv):
            wm, bias = params[layer.name]
            k, s = layer.kernel, layer.stride
            win = sliding_window_view(t, (k, k), axis=(2, 3))[:, :, ::s, ::s]      # B, C, Ho, Wo, k, k
            ho, wo = win.shape[2], win.shape[3]
            cols = win.transpose(0, 2, 3, 1, 4, 5).reshape(b, ho * wo, -1)        # B, Ho*Wo, C*k*k
            t = (cols @ wm.T + bias).transpose(0, 2, 1).reshape(b, layer.out_channels, ho, wo)
        elif isinstance(layer, Pool):
            p = layer.size
            c, h, w = t.shape[1], t.shape[2] // p, t.shape[3] // p
            t = t[:, :, :h * p, :w * p].reshape(b, c, h, p, w, p).max(axis=(3, 5))
        elif isinstance(layer, Act):
            t = t * t if layer.kind == "square" else np.maximum(t, 0.0)
        elif isinstance(layer, Dense):
            wm, bias = params[layer.name]
            t = t.reshape(b, -1) @ wm.T + bias
    return t.reshape(b, -1)


SCORE_SCHEMA = T.StructType([
    T.StructField("image_id", T.LongType(), False),
    T.StructField("logits", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("pred", T.IntegerType(), False),
])


def score_net(images: DataFrame, net: Net, weights: DataFrame, id_col: str = "image_id",
              pixels_col: str = "pixels") -> DataFrame:
    """Logits and arg-max class (first on ties) per image."""
    ship_package(images.sparkSession)
    params = collect_layers(weights, net.shapes())
    bc = images.sparkSession.sparkContext.broadcast(params)
    n_in = net.channels * net.height * net.width

    def run(batches):
        p = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["px"].to_numpy()])
            if x.shape[1] != n_in:
                raise ValueError(f"image has {x.shape[1]} values, net expects {n_in}")
            z = forward(net, p, x)
            yield pd.DataFrame({"image_id": pdf["image_id"].to_numpy(dtype=np.int64), "logits": list(z),
                                "pred": z.argmax(axis=1).astype(np.int32)})

    src = images.select(F.col(id_col).cast("long").alias("image_id"), F.col(pixels_col).alias("px"))
    return src.mapInPandas(run, SCORE_SCHEMA)


# --- relational convolution (M8c) -------------------------------------------------

def im2col_windows(images: DataFrame, height: int, width: int, kernel: int, stride: int = 1,
                   id_col: str = "image_id", pixels_col: str = "pixels") -> DataFrame:
    """One row per (image, output cell, kernel offset) with the pixel under it:
    image_id, oh, ow, ki, kj, v. Each pixel is replicated at most kernel^2 times
    by a generator (no join)."""
    ho = (height - kernel) // stride + 1
    wo = (width - kernel) // stride + 1
    px = images.select(F.col(id_col).cast("long").alias("image_id"),
                       F.posexplode(pixels_col).alias("p", "v"))
    px = px.select("image_id", (F.col("p") / F.lit(width)).cast("int").alias("r"),
                   (F.col("p") % F.lit(width)).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    off = px.select("*", F.explode(F.sequence(F.lit(0), F.lit(kernel * kernel - 1))).alias("o"))
    off = off.select("image_id", "v", (F.col("o") / F.lit(kernel)).cast("int").alias("ki"),
                     (F.col("o") % F.lit(kernel)).cast("int").alias("kj"), "r", "c")
    dr, dc = F.col("r") - F.col("ki"), F.col("c") - F.col("kj")
    ok = (dr >= 0) & (dc >= 0) & (dr % F.lit(stride) == 0) & (dc % F.lit(stride) == 0) & \
         (dr / F.lit(stride) < F.lit(ho)) & (dc / F.lit(stride) < F.lit(wo))
    return off.where(ok).select("image_id", (dr / F.lit(stride)).cast("int").alias("oh"),
                                (dc / F.lit(stride)).cast("int").alias("ow"), "ki", "kj", "v")


def conv2d_relational(windows: DataFrame, weights: DataFrame, layer: str, kernel: int) -> DataFrame:
    """Convolution (one input channel) as an equi-join of windows with the kernel
    on (ki, kj) and a grouped sum: image_id, ch, oh, ow, z. The kernel is broadcast
    after its row count is checked; the group key spreads over images, and rows of
    one image are partially summed before the shuffle."""
    w = weights.where(F.col("layer") == F.lit(layer))
    kern = w.where(F.col("in_idx") >= 0).select(F.col("out_idx").alias("ch"),
                                                  (F.col("in_idx") / F.lit(kernel)).cast("int").alias("ki"),
                                                  (F.col("in_idx") % F.lit(kernel)).cast("int").alias("kj"), "w")
    bias = w.where(F.col("in_idx") < 0).select(F.col("out_idx").alias("ch"), F.col("w").alias("b"))
    z = windows.join(sized_broadcast(kern), ["ki", "kj"]).groupBy("image_id", "ch", "oh", "ow") \
               .agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return z.join(sized_broadcast(bias), "ch").select("image_id", "ch", "oh", "ow", (F.col("s") + F.col("b")).alias("z"))


def maxpool_relational(fmap: DataFrame, size: int = 2, value: str = "z") -> DataFrame:
    """Max-pool as a group max over (image, channel, oh div size, ow div size);
    cells of an incomplete last block are dropped, as a floor-mode pool does."""
    return (fmap.withColumn("ph", (F.col("oh") / F.lit(size)).cast("int"))
                .withColumn("pw", (F.col("ow") / F.lit(size)).cast("int"))
                .groupBy("image_id", "ch", "ph", "pw")
                .agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") == F.lit(size * size)).drop("_n"))


def relational_net(images: DataFrame, net: Net, weights: DataFrame, id_col: str = "image_id", pixels_col: str = "pixels") -> DataFrame:
    """The whole net (convolutions of any number of channels and stride, pools, activations, dense layers) as
    joins with the weights and grouped sums: one row per image and output, (image_id, pos, value).

    Rows are (image, place j in the layer's output, value). They are partitioned by image once, where the pixels are laid
    out; every layer groups by image and place, which that partitioning serves, so no layer shuffles. A layer's weights
    (size-checked broadcast) say to which outputs a place contributes: :func:`_fan_out`."""
    spark, shapes = images.sparkSession, net.shapes()
    x = images.select(F.col(id_col).cast("long").alias("image_id"), F.col(pixels_col).alias("px")).repartition("image_id")
    x = x.select("image_id", F.posexplode("px").alias("j", "v")).select("image_id", "j", F.col("v").cast("double").alias("v"))
    c, h, w = net.channels, net.height, net.width
    for layer in net.layers:
        if isinstance(layer, Act):
            x = x.withColumn("v", F.col("v") * F.col("v") if layer.kind == "square" else F.greatest("v", F.lit(0.0)))
        elif isinstance(layer, Pool):
            hp, wp, size = h // layer.size, w // layer.size, layer.size
            row, col = F.floor(F.col("j") % (h * w) / w), F.col("j") % w
            place = F.floor(F.col("j") / (h * w)) * (hp * wp) + F.floor(row / size) * wp + F.floor(col / size)
            x = x.where((row < hp * size) & (col < wp * size)).groupBy("image_id", place.cast("int").alias("j")).agg(F.max("v").alias("v"))
            h, w = hp, wp
        else:
            own = weights.where(F.col("layer") == layer.name)
            bias = F.broadcast(own.where("in_idx < 0").select(F.col("out_idx").alias("o"), F.col("w").alias("b")))  # one per output channel
            if isinstance(layer, Conv):
                links, (c, h, w) = _fan_out(own, (c, h, w), layer)
            else:
                links = own.where("in_idx >= 0").select(F.col("in_idx").alias("j"), F.col("out_idx").alias("o"), F.col("out_idx").alias("to"), "w")
            z = x.join(sized_broadcast(links), "j").groupBy("image_id", "o", "to").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
            x = z.join(bias, "o").select("image_id", F.col("to").alias("j"), (F.col("s") + F.col("b")).alias("v"))
    return x.select("image_id", F.col("j").cast("int").alias("pos"), F.col("v").alias("value"))


def _fan_out(own: DataFrame, shape: tuple[int, int, int], layer: Conv) -> tuple[DataFrame, tuple[int, int, int]]:
    """(j, o, to, w): each input place of a convolution, the output places that it contributes to and with which weight; its
    size is that of the layer (places x kernel x channels), whatever the number of images."""
    (c, h, w), k, s = shape, layer.kernel, layer.stride
    ho, wo = (h - k) // s + 1, (w - k) // s + 1
    kern = own.where("in_idx >= 0").select(F.col("out_idx").alias("o"), F.col("w"), F.floor(F.col("in_idx") / (k * k)).alias("ch"),
                                           F.floor(F.col("in_idx") % (k * k) / k).alias("ki"), (F.col("in_idx") % k).alias("kj"))
    out = kern.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(ho * wo - 1))))
    row, col = F.floor(F.col("to") / wo) * s + F.col("ki"), F.col("to") % wo * s + F.col("kj")
    links = out.select((F.col("ch") * (h * w) + row * w + col).cast("int").alias("j"), "o", (F.col("o") * (ho * wo) + F.col("to")).cast("int").alias("to"), "w")
    return links, (layer.out_channels, ho, wo)


# --- M10 --------------------------------------------------------------------------

def gradient(net: Net, params: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over a batch of the gradient of softmax cross-entropy (weights then bias of each dense layer, flattened in
    layer order) and of the loss. Dense and activation layers only."""
    inputs, t = [], x
    for layer in net.layers:
        inputs.append(t)
        if isinstance(layer, Dense):
            wm, bias = params[layer.name]
            t = t @ wm.T + bias
        elif isinstance(layer, Act):
            t = t * t if layer.kind == "square" else np.maximum(t, 0.0)
        else:
            raise ValueError("training takes dense and activation layers")
    top = t.max(axis=1, keepdims=True)
    e = np.exp(t - top)
    total = e.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float((top[:, 0] + np.log(total[:, 0]) - t[rows, y]).sum())
    d = e / total
    d[rows, y] -= 1.0
    parts = []
    for layer, a in zip(reversed(net.layers), reversed(inputs)):
        if isinstance(layer, Dense):
            parts += [d.sum(axis=0), (d.T @ a).ravel()]
            d = d @ params[layer.name][0]
        else:
            d = d * 2.0 * a if layer.kind == "square" else d * (a > 0)
    return np.concatenate(parts[::-1]), loss


def train_net(images: DataFrame, net: Net, weights: DataFrame, label: str = "label", steps: int = 10, lr: float = 0.01,
              momentum: float = 0.0, batch_size: int | None = None, seed=0, id_col: str = "image_id",
              pixels_col: str = "pixels") -> tuple[DataFrame, list[float]]:
    """Dense nets with square or ReLU activations by (stochastic) gradient descent with momentum on mean softmax
    cross-entropy. Step s uses all rows, or minibatch ``s mod n_batches`` of exactly ``batch_size`` rows (reshuffled each
    pass). Executors sum gradients per partition, one grouping adds them up; only the model-sized sums reach the driver.
    Returns the trained weights table and the mean loss before each step."""
    from ..sources.weights import WEIGHTS_SCHEMA, collect_layers
    from ..session import cut_lineage
    from .sample import minibatch_ids

    spark = images.sparkSession
    ship_package(spark)
    dense = [x.name for x in net.layers if isinstance(x, Dense)]
    params = collect_layers(weights, net.shapes())
    data = cut_lineage(images.select(F.col(id_col).cast("long").alias("id"), F.col(pixels_col).alias("px"), F.col(label).cast("int").alias("y")))
    n_batches = 1 if batch_size is None else max(1, -(-data.count() // batch_size))
    velocity, losses, held = None, [], data
    for s in range(steps):
        if batch_size is not None and s % n_batches == 0:
            held = cut_lineage(minibatch_ids(data, "id", batch_size, seed, epoch=s // n_batches))
        part = held if batch_size is None else held.where(F.col("batch_id") == s % n_batches)
        sent = spark.sparkContext.broadcast(params)

        def run(batches, sent=sent):
            total, loss, n = None, 0.0, 0
            for pdf in batches:
                if len(pdf):
                    x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["px"].to_numpy()])
                    g, part_loss = gradient(net, sent.value, x, pdf["y"].to_numpy())
                    total, loss, n = (g if total is None else total + g), loss + part_loss, n + len(pdf)
            if total is not None:
                yield pd.DataFrame({"g": [[*total.tolist(), loss, float(n)]]})

        sums = part.select("px", "y").mapInPandas(run, "g array<double>").select(F.posexplode("g").alias("p", "v"))
        row = np.array([r["v"] for r in sums.groupBy("p").agg(F.sum("v").alias("v")).orderBy("p").collect()])
        sent.unpersist()
        if not len(row):
            break
        g, loss, n = row[:-2] / row[-1], row[-2], row[-1]
        losses.append(loss / n)
        velocity = g if velocity is None else momentum * velocity + g
        at, params = 0, dict(params)
        for name in dense:
            wm, bias = params[name]
            dw = velocity[at:at + wm.size].reshape(wm.shape)
            db = velocity[at + wm.size:at + wm.size + bias.size]
            params[name] = (wm - lr * dw, bias - lr * db)
            at += wm.size + bias.size
    rows = [(name, o, i, float(v)) for name in dense for o, line in enumerate(np.column_stack([params[name][1], params[name][0]]))
            for i, v in enumerate(line, -1)]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA), losses


def train_mlp(df: DataFrame, features: str, label: str, layers: Sequence[int], max_iter: int = 100,
              seed: int = 7, block_size: int = 128):
    """Distributed MLP from ``pyspark.ml`` (sigmoid hidden layers, softmax output;
    not the reference's activation choice). Returns the fitted model."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    data = df.select(array_to_vector(F.transform(F.col(features), lambda x: x.cast("double"))).alias("features"),
                     F.col(label).cast("double").alias("label"))
    mlp = MultilayerPerceptronClassifier(layers=list(layers), maxIter=max_iter, seed=seed, blockSize=block_size)
    return mlp.fit(data)


def mlp_predict(model, df: DataFrame, features: str, keep: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    data = df.select(*keep, array_to_vector(F.transform(F.col(features), lambda x: x.cast("double"))).alias("features"))
    return model.transform(data).select(*keep, F.col("prediction").cast("int").alias("pred"))
