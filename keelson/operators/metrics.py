"""Evaluation (A1, A8-A17). Each metric is one aggregate (or one group-by on a
small key) over the scored rows; no rows reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import as_double_array, log_sum_exp
from ..session import cut_lineage
from .ranking import next_desc, running_sums_desc

def _div(num: Column, den: Column) -> Column:
    """Guarded division: 0 when the denominator is 0 (the 'zero_division=0' rule)."""
    return F.when(den == F.lit(0), F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def observed_classes(df: DataFrame, *cols: str) -> list:
    """Sorted union of the values in ``cols``: one value per class."""
    u = None
    for c in cols:
        part = df.select(F.col(c).cast("long").alias("c"))
        u = part if u is None else u.unionByName(part)
    return [r[0] for r in u.where(F.col("c").isNotNull()).distinct().orderBy("c").collect()]


def _class_table(spark: SparkSession, classes: Sequence[int], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(int(c)).cast("long") for c in classes])).alias(name))


def class_size_report(df: DataFrame, label: str) -> DataFrame:
    """A1: rows per class and the smallest class size (window over the tiny count table)."""
    from pyspark.sql import Window
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("min_class_size", F.min("n").over(Window.partitionBy()))


def confusion_matrix(df: DataFrame, y: str, pred: str, classes: Sequence[int] | None = None) -> DataFrame:
    """(y_true, y_pred, n) for every class pair, zero-filled. The classes (given, or those observed) are laid out by
    the executors: nothing is collected."""
    if classes is not None:
        held = _class_table(df.sparkSession, classes, "c")
    else:
        held = df.select(F.explode(F.array(F.col(y).cast("long"), F.col(pred).cast("long"))).alias("c")).distinct()
    held = held.agg(F.collect_set("c").alias("all"))
    grid = held.select(F.explode("all").alias("y_true"), "all").select("y_true", F.explode("all").alias("y_pred"))
    counts = df.groupBy(F.col(y).cast("long").alias("y_true"), F.col(pred).cast("long").alias("y_pred")) \
               .agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def binary_counts(df: DataFrame, y: str, pred: str, positive: int = 1) -> list[Column]:
    yy, pp = F.col(y) == F.lit(positive), F.col(pred) == F.lit(positive)
    return [F.sum((yy & pp).cast("long")).alias("tp"), F.sum((~yy & pp).cast("long")).alias("fp"),
            F.sum((yy & ~pp).cast("long")).alias("fn"), F.sum((~yy & ~pp).cast("long")).alias("tn")]


def binary_prf(df: DataFrame, y: str, pred: str, positive: int = 1) -> DataFrame:
    """Precision, recall and F1 of the positive class; 0 where undefined."""
    c = df.agg(*binary_counts(df, y, pred, positive))
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"),
                    _div(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    """A10: one row (n, n_correct, accuracy)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == F.col(pred)).cast("long")).alias("n_correct")) \
             .withColumn("accuracy", _div(F.col("n_correct"), F.col("n")))


def close_enough_accuracy(df: DataFrame, y: str, p: str, tol: float = 0.5) -> DataFrame:
    """Share of rows with |p - y| < tol."""
    ok = (F.abs(F.col(p) - F.col(y)) < F.lit(tol)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_correct")) \
             .withColumn("accuracy", _div(F.col("n_correct"), F.col("n")))


#: Distinct scores per range of scores that running sums are split into, and ranges at least.
RANGE_SCORES, SCORE_RANGES = 250_000, 64
#: Relative rank error of the quantiles that cut the ranges is 1 / (CUT_DETAIL * ranges).
CUT_DETAIL = 20


def score_ranges(per: DataFrame, score: str, n_scores: int | None = None) -> Column:
    """Range number of a score, non-decreasing in it: cut at approximate quantiles of the ``n_scores`` distinct scores, so
    any distribution spreads evenly, about RANGE_SCORES to a range. One number per range comes to the driver; the place
    among the cuts is found by binary search."""
    n_scores = per.count() if n_scores is None else n_scores
    ranges = max(SCORE_RANGES, -(-n_scores // RANGE_SCORES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = per.agg(F.percentile_approx(score, shares, CUT_DETAIL * ranges).alias("cuts")).first()["cuts"] or []
    return _place(sorted(set(cuts)), F.col(score))


def _place(cuts: list[float], c: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``c``: a balanced tree of comparisons for few cuts, two levels of
    arrays for many."""
    held = lambda v: F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")
    if len(cuts) <= 256:
        return F.size(F.filter(held(cuts), lambda x: x < c))
    step = math.isqrt(len(cuts))
    coarse = F.size(F.filter(held(cuts[::step]), lambda x: x < c))  # the group before this one holds the place
    group = F.slice(held(cuts), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(group, lambda x: x < c)))


def _score_table(df: DataFrame, y: str, score: str) -> tuple[DataFrame, Column]:
    """One row per distinct score with its counts and running sums; rows whose score is null or NaN are left out."""
    per = df.select(F.col(score).cast("double").alias("threshold"), F.col(y).alias("y"))
    per = per.where(F.col("threshold").isNotNull() & ~F.isnan("threshold")).groupBy("threshold").agg(
        F.sum((F.col("y") == F.lit(1)).cast("long")).alias("tp"),
        F.sum((F.col("y") != F.lit(1)).cast("long")).alias("fp"))
    per = cut_lineage(per)   # read for the cuts, the sums of the ranges and the running sums
    b = score_ranges(per, "threshold", per.count())
    return running_sums_desc(per, "threshold", ["tp", "fp"], b), b


def roc_points(df: DataFrame, y: str, score: str, drop_intermediate: bool = True, include_origin: bool = True) -> DataFrame:
    """ROC points (threshold, fps, tps, fpr, tpr) in the plotting library's
    convention: one point per distinct score in descending order; with
    ``drop_intermediate`` a point is kept only where the curve bends (its own
    (fp, tp) step differs from the next point's), plus the first and last; with
    ``include_origin`` the point (0, 0) at threshold +inf comes first. Scores are
    grouped first, running sums and next-point values come from the offsets of
    score ranges cut at quantiles (no one-task window, any distribution). Rows
    whose score is null or NaN are left out of points and totals."""
    t, b = _score_table(df, y, score)
    tot = t.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    if drop_intermediate:
        t = next_desc(t, "threshold", ["tp", "fp"], b)
        first = (F.col("cum_tp") == F.col("tp")) & (F.col("cum_fp") == F.col("fp"))
        bend = (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
        t = t.where(first | F.col("next_tp").isNull() | bend)
    pts = t.select("threshold", F.col("cum_fp").cast("bigint").alias("fps"), F.col("cum_tp").cast("bigint").alias("tps"))
    if include_origin:
        origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                                 F.lit(0).cast("bigint").alias("fps"), F.lit(0).cast("bigint").alias("tps"))
        pts = pts.unionByName(origin)
    return pts.select("threshold", "fps", "tps",
                      (F.col("fps") / F.lit(float(N)) if N else F.lit(None).cast("double")).alias("fpr"),
                      (F.col("tps") / F.lit(float(P)) if P else F.lit(None).cast("double")).alias("tpr"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Trapezoid area under the ROC curve, exact under ties. The previous
    point of each threshold is (cum - own counts), so no ordered ``lag`` is needed.
    Rows whose score is null or NaN are left out."""
    t, _ = _score_table(df, y, score)
    area2 = F.sum(F.col("fp") * (F.col("cum_tp") * 2 - F.col("tp")))
    return t.agg(area2.alias("a2"), F.sum("tp").alias("P"), F.sum("fp").alias("N")).select(
        F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"),
        F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
         .otherwise(F.col("a2").cast("double") / (F.col("P") * F.col("N") * 2).cast("double")).alias("auc"))


def bce_term(y: str, p: str) -> Column:
    """Binary cross-entropy of one row with logs clamped at -100."""
    pc = F.col(p).cast("double")
    lp = F.when(pc > 0, F.greatest(F.log(pc), F.lit(-100.0))).otherwise(F.lit(-100.0))
    lq = F.when(pc < 1, F.greatest(F.log(F.lit(1.0) - pc), F.lit(-100.0))).otherwise(F.lit(-100.0))
    yc = F.col(y).cast("double")
    return -(yc * lp + (F.lit(1.0) - yc) * lq)


def log_loss(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean binary cross-entropy."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(bce_term(y, p)).alias("log_loss"))


def cross_entropy_rows(df: DataFrame, logits: str, target: str, out: str = "ce") -> DataFrame:
    """A14 per row: logsumexp(logits) - logits[target]."""
    a = as_double_array(logits)
    return df.withColumn(out, log_sum_exp(logits) - F.element_at(a, F.col(target).cast("int") + F.lit(1)))


def cross_entropy(df: DataFrame, logits: str, target: str, batch: str | None = None) -> DataFrame:
    """Mean cross-entropy over all rows, or per minibatch when ``batch`` is given."""
    rows = cross_entropy_rows(df, logits, target)
    agg = [F.count(F.lit(1)).alias("n"), F.avg("ce").alias("cross_entropy")]
    return rows.groupBy(batch).agg(*agg) if batch else rows.agg(*agg)


def per_class_accuracy(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Per class correct, total and accuracy; a class with no rows has total 0
    and a null accuracy."""
    stats = df.groupBy(F.col(y).cast("long").alias("class")).agg(
        F.sum((F.col(y) == F.col(pred)).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return _class_table(df.sparkSession, classes, "class").join(stats, "class", "left").select(
        "class", F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).alias("accuracy"))


def per_class_prf(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Per class tp, fp, fn and standard precision, recall, F1 (0 where undefined).
    Counts by true class and by predicted class are two group-bys on the class key."""
    by_true = df.groupBy(F.col(y).cast("long").alias("class")).agg(
        F.sum((F.col(y) == F.col(pred)).cast("long")).alias("tp"), F.count(F.lit(1)).alias("support"))
    by_pred = df.groupBy(F.col(pred).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    t = (_class_table(df.sparkSession, classes, "class").join(by_true, "class", "left").join(by_pred, "class", "left")
         .select("class", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                 F.coalesce("predicted", F.lit(0)).alias("predicted")))
    t = t.select("class", F.col("tp").cast("bigint").alias("tp"),
                 (F.col("predicted") - F.col("tp")).cast("bigint").alias("fp"),
                 (F.col("support") - F.col("tp")).cast("bigint").alias("fn"))
    return t.select("*", _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    _div(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def macro_prf(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """A16 summary: unweighted means over classes."""
    t = per_class_prf(df, y, pred, classes)
    return t.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                 F.avg("f1").alias("macro_f1"))


def model_drift_summary(df: DataFrame, model: str, y: str, pred: str, baseline: str, positive: int = 1) -> DataFrame:
    """Per model key n, accuracy, precision, recall and F1 in ONE group-by, then each model's signed and
    absolute accuracy difference to the baseline model."""
    from pyspark.sql import Window
    per = df.groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"),
                                *binary_counts(df, y, pred, positive))
    # the per-model table has one row per model: a window over it, no join
    base = F.max(F.when(F.col(model) == F.lit(baseline), F.col("accuracy"))).over(Window.partitionBy())
    out = per.withColumn("_base", base)
    return out.select(model, "n", "accuracy", (F.col("accuracy") - F.col("_base")).alias("drift"),
                      F.abs(F.col("accuracy") - F.col("_base")).alias("abs_drift"),
                      _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                      _div(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def binary_report(scored: DataFrame, y: str, p: str, pred: str) -> dict:
    """n, accuracy, precision, recall, F1 and log loss in ONE aggregate, plus the
    exact AUC; ``scored`` should be materialised (the model runs once)."""
    row = scored.agg(*binary_counts(scored, y, pred), F.count(F.lit(1)).alias("n"),
                     F.avg(bce_term(y, p)).alias("log_loss")).first()
    tp, fp, fn, tn, n = (row[k] or 0 for k in ("tp", "fp", "fn", "tn", "n"))

    def div(a, b):
        return float(a) / b if b else 0.0

    auc = roc_auc(scored, y, p).first()["auc"]
    return {"n": n, "accuracy": div(tp + tn, n), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn),
            "f1": div(2 * tp, 2 * tp + fp + fn), "auc": auc, "log_loss": row["log_loss"]}


REPORT_SCHEMA = ("model string, n long, accuracy double, precision double, recall double, f1 double, auc double, "
                 "log_loss double")


def report_frame(spark: SparkSession, reports: list[tuple[str, dict]]) -> DataFrame:
    """One row per model from :func:`binary_report` results."""
    keys = ["n", "accuracy", "precision", "recall", "f1", "auc", "log_loss"]
    return spark.createDataFrame([(name, *[r[k] for k in keys]) for name, r in reports], REPORT_SCHEMA)
