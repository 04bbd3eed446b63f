"""Score rows as they arrive with a fitted linear model.

The scorer is the same native expression as batch scoring (no state, no
watermark needed). The caller names the stream's checkpoint folder, on shared
storage, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import threshold_label
from ..operators.linear import linear_score


def score_stream(stream: DataFrame, features: Sequence[Column] | str, weights: Sequence[float], bias: float,
                 keep: Sequence[str]) -> DataFrame:
    """Streaming DataFrame -> keep columns, score p and 0/1 prediction."""
    feats = F.col(features) if isinstance(features, str) else F.array(*[c.cast("double") for c in features])
    scored = linear_score(stream.select(*keep, feats.alias("_f")), "_f", weights, bias)
    return scored.select(*keep, "p", threshold_label("p").alias("pred"))


def run_to_parquet(spark: SparkSession, source_dir: str, schema: T.StructType,
                   build: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str,
                   glob: str = "*.parquet", max_files_per_trigger: int = 1) -> None:
    """Process every file matching ``glob`` in ``source_dir`` that earlier runs with the same ``checkpoint`` folder have
    not processed (available-now trigger)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("pathGlobFilter", glob).parquet(source_dir))
    q = (build(stream).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
