"""Joins and tagged unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A fitted lookup table is broadcast only when its measured size is within
# this many bytes; above it the join stays a shuffle join.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame):
    """Aggregate: bytes of the rows, text at its real length, 16 for every other value."""
    texts = [c for c, t in df.dtypes if t in ("string", "binary")]
    width = F.lit(16 * len(df.columns))
    for c in texts:
        width = width + F.coalesce(F.octet_length(c), F.lit(0))
    return F.coalesce(F.sum(width), F.lit(0))


def sized_broadcast(small: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check (``BROADCAST_MAX_BYTES``, read at call
    time). ``small`` should be materialised (a fitted table), so measuring it is a
    cheap scan."""
    bound = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    return F.broadcast(small) if small.agg(measured_bytes(small)).first()[0] <= bound else small


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Left outer equi-join; AQE turns it into a broadcast join when the right side
    is measured small at run time, a sort-merge join otherwise."""
    right_key = right_key or left_key
    if right_key == left_key:
        return left.join(right, left_key, "left")
    return left.join(right, left[left_key] == right[right_key], "left").drop(right[right_key])


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Union all of named frames with a tag column (train/test processed in step)."""
    frames = [d.withColumn(tag, F.lit(name)) for name, d in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_back(df: DataFrame, name: str, tag: str = "split") -> DataFrame:
    return df.where(F.col(tag) == F.lit(name)).drop(tag)


def align_by_key(scores: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Pair each score with its label by row id (Spark rows have no position)."""
    return scores.join(labels, key, "inner")


#: A key is heavy when it holds this share of the left rows or more; so there are HEAVY_MOST of them at most.
HEAVY_SHARE, HEAVY_MOST = 0.005, 200
#: Items that the sketch tracks: it misses no key above 1 / SKETCH_ITEMS of the rows by more than its error.
SKETCH_ITEMS = 8192
#: Pieces that the rows of a heavy key are dealt to where its right rows are too many to broadcast.
SALTS = 128


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """The non-null values of ``key`` that hold ``share`` of the rows or more. A mergeable sketch of bounded size names
    candidates, one exact recount of those decides."""
    most = int(1 / share)
    rows = df.where(F.col(key).isNotNull())
    sketch = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {min(2 * most, SKETCH_ITEMS)}, {SKETCH_ITEMS})").alias("top")).first()
    named = [r["item"] for r in sketch["top"] or [] if r["count"] >= share * sketch["n"] / 2]
    if not named:
        return []
    exact = rows.where(F.col(key).isin(named)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(r[key] for r in exact if r["n"] >= share * sketch["n"])


def hot_key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None, how: str = "left",
                 share: float = HEAVY_SHARE, max_bytes: int | None = None) -> DataFrame:
    """J1 / J2 with hot keys: the result of a plain left (or inner) equi-join, without a task that gets all rows of one key.

    Left rows of heavy keys stay where they are and meet the right rows of those keys by a broadcast within the size
    bound; beyond it they are dealt to SALTS pieces and the right rows copied to each. Rows without a key match nothing
    and are not shuffled. All other rows are joined by a shuffle, as left to themselves."""
    if how not in ("left", "inner"):
        raise ValueError("left or inner joins only")
    right_key = right_key or left_key
    clash = [c for c in right.columns if c in left.columns and c != right_key]
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    heavy = heavy_keys(left, left_key, share)
    out_right = [c for c in right.columns if c != right_key or right_key != left_key]
    r = right.withColumnRenamed(right_key, "_rk")
    named = [F.col("_rk").alias(right_key) if c == right_key else F.col(c) for c in out_right]
    keep = left.columns

    def plain(a: DataFrame, b: DataFrame) -> DataFrame:
        joined = a.join(b, F.col(left_key) == F.col("_rk"), how)
        return joined.select(*keep, *named)

    is_heavy = F.col(left_key).isin(heavy) if heavy else F.lit(False)
    out = plain(left.where(F.col(left_key).isNotNull() & ~is_heavy), r.where(~F.col("_rk").isin(heavy)) if heavy else r)
    if how == "left":
        types = {c: t for c, t in right.dtypes}
        out = out.unionByName(left.where(F.col(left_key).isNull()).select(*keep, *[F.lit(None).cast(types[c]).alias(c) for c in out_right]))
    if heavy:
        few = r.where(F.col("_rk").isin(heavy))
        bound = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
        hot = left.where(is_heavy)
        if few.agg(measured_bytes(few)).first()[0] <= bound:
            out = out.unionByName(plain(hot, F.broadcast(few)))
        else:
            # by a hash of the row and its partition: a repeated task deals alike, equal rows are spread
            dealt = hot.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *keep), F.lit(SALTS)).cast("int"))
            copies = few.withColumn("_rs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = dealt.join(copies, (F.col(left_key) == F.col("_rk")) & (F.col("_salt") == F.col("_rs")), how)
            out = out.unionByName(joined.select(*keep, *named))
    return out
