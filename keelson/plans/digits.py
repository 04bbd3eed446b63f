"""Digit-image networks of the reference as scoring specs (28x28, one channel),
a loader from trained weight arrays to the weights table, and the evaluation
the scripts print (per-class accuracy, macro precision / recall / F1, loss)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.nets import Act, Conv, Dense, Net, Pool, score_net
from ..sources.weights import WEIGHTS_SCHEMA

# The four architectures of the digit scripts.
CONV_SQUARE_NET = Net(1, 28, 28, (Conv("conv1", 4, 7, 3), Act("square"), Dense("fc1", 1024), Act("square"),
                                  Dense("fc2", 64), Act("square"), Dense("fc3", 10)))
DENSE_SQUARE_NET = Net(1, 28, 28, (Dense("fc1", 1024), Act("square"), Dense("fc2", 64), Act("square"),
                                   Dense("fc3", 10)))
DENSE_RELU_NET = Net(1, 28, 28, (Dense("fc1", 128), Act("relu"), Dense("fc2", 64), Act("relu"), Dense("fc3", 10)))
CONV_POOL_NET = Net(1, 28, 28, (Conv("conv1", 10, 5), Pool(2), Act("relu"), Conv("conv2", 20, 5), Pool(2),
                                Act("relu"), Dense("fc1", 50), Act("relu"), Dense("fc2", 10)))
CLASSES = list(range(10))


def weights_table(spark: SparkSession, arrays: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """{layer: (W, b)} -> (layer, out_idx, in_idx, w) rows; a conv kernel (out, in, kh, kw)
    is flattened row-major, so in_idx = c_in * kh * kw + ki * kw + kj; bias has in_idx -1.
    Model-sized input only: the byte bound is checked."""
    rows = []
    for name, (w, b) in arrays.items():
        w2 = np.asarray(w, dtype=np.float64).reshape(np.asarray(w).shape[0], -1)
        o_idx, i_idx = np.nonzero(np.ones_like(w2, dtype=bool))
        rows += list(zip([name] * w2.size, o_idx.tolist(), i_idx.tolist(), w2.ravel().tolist()))
        bias = np.asarray(b, dtype=np.float64).ravel()
        rows += [(name, int(o), -1, float(v)) for o, v in enumerate(bias)]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def evaluate_digits(images: DataFrame, net: Net, weights: DataFrame, label_col: str = "label") -> dict[str, DataFrame]:
    """Scores plus the printed evaluation: per-class accuracy, per-class and macro
    precision / recall / F1 (standard definitions), and mean cross-entropy."""
    scored = score_net(images, net, weights).join(
        images.select(F.col("image_id").cast("long").alias("image_id"), F.col(label_col).cast("int").alias("label")),
        "image_id")
    return {
        "scores": scored,
        "per_class_accuracy": metrics.per_class_accuracy(scored, "label", "pred", CLASSES),
        "per_class_prf": metrics.per_class_prf(scored, "label", "pred", CLASSES),
        "macro_prf": metrics.macro_prf(scored, "label", "pred", CLASSES),
        "loss": metrics.cross_entropy(scored, "logits", "label"),
    }
