"""Results stay exact when one key holds most of the rows."""

import numpy as np
import pandas as pd

from keelson.operators import encode, sample


def _skewed(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    uid = np.where(rng.random(n) < 0.45, 7, rng.integers(0, 200, n))      # key 7 holds ~45% of rows
    pdf = pd.DataFrame({"id": np.arange(n), "uid": uid, "v": rng.normal(size=n).round(3),
                        "y": (rng.random(n) < 0.1).astype(int)})
    return pdf, spark.createDataFrame(pdf)


def test_group_stats_under_skew(spark):
    pdf, df = _skewed(spark)
    out = encode.group_stat_encode(df, ["v"], ["uid"], ["mean", "std"]).toPandas().set_index("id").sort_index()
    g = pdf.groupby("uid")["v"]
    want_m = pdf["uid"].map(g.mean()).fillna(-1)
    want_s = pdf["uid"].map(g.std()).fillna(-1)
    assert np.allclose(out["v_uid_mean"].to_numpy(), want_m.to_numpy(), atol=1e-12)
    assert np.allclose(out["v_uid_std"].to_numpy(), want_s.to_numpy(), atol=1e-12)


def test_stratified_split_under_skew(spark):
    pdf, df = _skewed(spark)
    s = sample.split_stratified(df, "id", "uid", seed=5, test_ratio=0.25).toPandas()
    got = s[s["split"] == "test"].groupby("uid").size()
    want = (pdf.groupby("uid").size() * 0.25).apply(np.floor).astype(int)
    assert (got.reindex(want.index, fill_value=0) == want).all()
    assert len(s) == len(pdf) and s["id"].is_unique


def test_frequency_under_skew(spark):
    pdf, df = _skewed(spark)
    out = encode.freq_encode(df, ["uid"]).toPandas().set_index("id").sort_index()
    want = pdf["uid"].map(pdf["uid"].value_counts(normalize=True))
    assert np.allclose(out["uid_FE"].to_numpy(), want.to_numpy(), atol=1e-15)
