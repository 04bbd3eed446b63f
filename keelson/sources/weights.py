"""Model weights as a table: (layer, out_idx, in_idx, w); bias has in_idx = -1.

Weights are model-sized, never data-sized: their number is fixed by the net's
shapes, and a table with a missing, repeated or surplus weight is refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTS_SCHEMA = T.StructType([
    T.StructField("layer", T.StringType(), False),
    T.StructField("out_idx", T.IntegerType(), False),
    T.StructField("in_idx", T.IntegerType(), False),
    T.StructField("w", T.DoubleType(), False),
])

def write_weights(df: DataFrame, path: str) -> str:
    df.select("layer", "out_idx", "in_idx", F.col("w").cast("double")).write.mode("overwrite").parquet(path)
    return path


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS_SCHEMA).parquet(path)


def formula_weights(spark: SparkSession, layer: str, n_out: int, n_in: int, a: int = 7, b: int = 3,
                    mod: int = 11, shift: int = 5, div: float = 16.0, bias: bool = True) -> DataFrame:
    """Deterministic test weights ``((a*o + b*i) % mod - shift) / div``; bias uses i = n_in."""
    lo = -1 if bias else 0
    i_eff = F.when(F.col("i") < 0, F.lit(n_in)).otherwise(F.col("i"))
    w = ((F.lit(a) * F.col("o") + F.lit(b) * i_eff) % F.lit(mod) - F.lit(shift)).cast("double") / F.lit(div)
    return (spark.range(n_out).withColumnRenamed("id", "o")
            .withColumn("i", F.explode(F.sequence(F.lit(lo), F.lit(n_in - 1))))
            .select(F.lit(layer).alias("layer"), F.col("o").cast("int").alias("out_idx"),
                    F.col("i").cast("int").alias("in_idx"), w.alias("w")))


def formula_matrix(n_out: int, n_in: int, a: int = 7, b: int = 3, mod: int = 11, shift: int = 5,
                   div: float = 16.0) -> tuple[np.ndarray, np.ndarray]:
    """NumPy twin of :func:`formula_weights` (for tests)."""
    o = np.arange(n_out)[:, None]
    i = np.arange(n_in)[None, :]
    w = ((a * o + b * i) % mod - shift) / div
    bvec = ((a * np.arange(n_out) + b * n_in) % mod - shift) / div
    return w.astype(np.float64), bvec.astype(np.float64)


def collect_layers(weights: DataFrame, shapes: dict[str, tuple[int, int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weights table -> {layer: (W[out, in], b[out])}.

    Only model parameters pass through the driver; their number is known from
    ``shapes``. Every layer must hold each (out_idx, in_idx) of its shape exactly
    once, bias included; that is checked before anything is collected.
    """
    own = weights.where(F.col("layer").isin(list(shapes)))
    distinct = F.count_distinct("out_idx", "in_idx")
    inside = F.lit(False)
    for name, (n_out, n_in) in shapes.items():
        inside = inside | ((F.col("layer") == name) & F.col("out_idx").between(0, n_out - 1) & F.col("in_idx").between(-1, n_in - 1))
    found = {r["layer"]: (r["n"], r["d"], r["bad"]) for r in own.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), distinct.alias("d"),
        F.sum((~inside | F.col("w").isNull()).cast("long")).alias("bad")).collect()}
    for name, (n_out, n_in) in shapes.items():
        n, d, bad = found.get(name, (0, 0, 0))
        want = n_out * (n_in + 1)
        if (n, d, bad) != (want, want, 0):
            raise ValueError(f"layer {name}: {want} weights expected, found {n} rows, {d} distinct places, {bad} outside the shape or null")
    rows = own.toPandas()
    out = {}
    for name, (n_out, n_in) in shapes.items():
        part = rows[rows["layer"] == name]
        w = np.zeros((n_out, n_in), dtype=np.float64)
        b = np.zeros(n_out, dtype=np.float64)
        body = part[part["in_idx"] >= 0]
        w[body["out_idx"].to_numpy(), body["in_idx"].to_numpy()] = body["w"].to_numpy()
        bias = part[part["in_idx"] < 0]
        b[bias["out_idx"].to_numpy()] = bias["w"].to_numpy()
        out[name] = (w, b)
    return out
