"""Labelled image scans and pixel scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import normalize

# The digit-image normalisation constants (mean, std).
DIGIT_MEAN = 0.1307
DIGIT_STD = 0.3081


def scan_images(spark: SparkSession, path: str, id_col: str, pixels_col: str, label_col: str,
                height: int, width: int) -> DataFrame:
    """Row-major ``array<float>`` images with a label; rows of the wrong size fail."""
    df = spark.read.parquet(path).select(
        F.col(id_col).alias("image_id"), F.col(pixels_col).alias("pixels"), F.col(label_col).cast("int").alias("label"))
    n = height * width
    return df.withColumn("pixels", F.when(F.size("pixels") == F.lit(n), F.col("pixels"))
                         .otherwise(F.raise_error(F.lit(f"image is not {height}x{width}"))))


def pixel_normalize(df: DataFrame, col: str = "pixels", mean: float = DIGIT_MEAN, std: float = DIGIT_STD,
                    scale: float = 1.0, out: str | None = None) -> DataFrame:
    """``(x * scale - mean) / std``; ``scale = 1/255`` turns 8-bit values into [0, 1]."""
    return df.withColumn(out or col, normalize(col, mean, std, scale))


def to_rows(df: DataFrame, col: str, width: int, out: str = "image2d") -> DataFrame:
    """Flat row-major pixels -> array of rows (array<array<double>>)."""
    height_expr = F.sequence(F.lit(0), (F.size(col) / F.lit(width)).cast("int") - F.lit(1))
    return df.withColumn(out, F.transform(height_expr, lambda r: F.slice(F.col(col), r * F.lit(width) + F.lit(1), F.lit(width))))
