"""A4, exact distinct counts by bitmaps: mergeable state instead of a distinct aggregate.

Values get dense codes (a fitted table); a state row holds, for one uid, feature and bucket of 64 codes, the bitmap of
the codes seen, one whole number. Bitmaps are built in each task before the shuffle by a hash aggregate and combined by
``bit_or``, also across states of different frames (train and test), without rereading rows; a uid that holds half of all
rows is a few bitmaps per task and is spread over its buckets. There is no Expand over the rows, whatever the number of
features.

A bitmap takes 8 bytes beside its key, so a state is never larger than the distinct pairs that it stands for, however few
of the values a uid holds; codes are dealt in value order, so few values mean one bitmap per uid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import encode, joins


def distinct_state(df: DataFrame, main_columns: Sequence[str], uid: str, codes: DataFrame) -> DataFrame:
    """(uid, feature, bucket, bits) of the codes that each uid has; nulls and values without a code are not counted."""
    small = encode._broadcastable(codes, main_columns)
    x = df.select(uid, *[c for c in dict.fromkeys(main_columns) if c != uid])
    for c in main_columns:
        x = encode._attach(x, codes, c, "code", small)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_v_{c}").cast("bigint").alias("code")) for c in main_columns])
    rows = x.select(F.col(uid).alias("uid"), F.explode(pairs).alias("p")).select("uid", "p.*").where("code IS NOT NULL")
    bit = F.expr("shiftleft(1L, CAST(code & 63 AS INT))")
    return rows.groupBy("uid", "feature", F.shiftright("code", 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def merge_distinct(*states: DataFrame) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("uid", "feature", "bucket").agg(F.bit_or("bits").alias("bits"))


def distinct_counts(state: DataFrame, main_columns: Sequence[str], uid: str) -> DataFrame:
    """(uid, ``{uid}_{main}_ct`` ...): bits set, by feature."""
    n = F.bit_count("bits")
    cols = [F.coalesce(F.sum(F.when(F.col("feature") == c, n)), F.lit(0)).cast("bigint").alias(f"{uid}_{c}_ct") for c in main_columns]
    return state.groupBy("uid").agg(*cols).withColumnRenamed("uid", uid)


def group_nunique_bitmap(df: DataFrame, main_columns: Sequence[str], uids: Sequence[str], fit_on: Sequence[DataFrame] | None = None) -> DataFrame:
    """As :func:`~keelson.operators.encode.group_nunique_encode`; ``fit_on`` lists the frames that are counted together, each
    read once. A uid whose values are all null has the count 0."""
    frames = list(fit_on) if fit_on is not None else [df]
    every = frames[0].select(*main_columns)
    for f in frames[1:]:
        every = every.unionByName(f.select(*main_columns))
    codes = encode.fit_label_codes(every, main_columns)
    out = df
    for uid in uids:
        state = merge_distinct(*[distinct_state(f, main_columns, uid, codes) for f in frames])
        seen = frames[0].select(uid)
        for f in frames[1:]:
            seen = seen.unionByName(f.select(uid))
        counts = seen.where(F.col(uid).isNotNull()).distinct().join(distinct_counts(state, main_columns, uid), uid, "left").fillna(
            0, subset=[f"{uid}_{c}_ct" for c in main_columns])
        out = out.join(joins.sized_broadcast(cut_lineage(counts)), uid, "left")
    return out
