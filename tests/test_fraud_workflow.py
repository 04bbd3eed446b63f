"""The fraud workflow on small generated CSV files with the real column layout."""

import os
import tempfile

import numpy as np
import pandas as pd

from keelson.plans import fraud


def _write(tmp, name, df):
    path = os.path.join(tmp, name)
    df.to_csv(path, index=False)
    return path


def _transactions(rng, ids, with_label):
    n = len(ids)
    df = pd.DataFrame({"TransactionID": ids})
    if with_label:
        df["isFraud"] = (rng.random(n) < 0.3).astype(int)
    for c in fraud.BASE_COLUMNS[1:]:
        if c in fraud.STRING_COLUMNS:
            df[c] = rng.choice(["a", "b", None], n)
        else:
            v = rng.integers(0, 50, n).astype(float)
            v[rng.random(n) < 0.1] = np.nan
            df[c] = v
    df["TransactionAmt"] = rng.integers(100, 10000, n) / 100.0
    for x in fraud.V_SELECTED[:5]:
        df[f"V{x}"] = rng.random(n)
    df["V999"] = 1.0                     # a column the workflow does not use
    return df


def _identity(rng, ids, dash):
    sep = "-" if dash else "_"
    df = pd.DataFrame({"TransactionID": ids})
    df[f"id{sep}01"] = rng.random(len(ids))
    df[f"id{sep}12"] = rng.choice(["Found", "NotFound"], len(ids))
    df["DeviceType"] = rng.choice(["mobile", "desktop"], len(ids))
    return df


def test_fraud_workflow_end_to_end(spark):
    rng = np.random.default_rng(0)
    tmp = tempfile.mkdtemp(prefix="keelson-fraud-")
    tr_ids, te_ids = np.arange(1, 401), np.arange(1001, 1201)
    paths = [_write(tmp, "train_transaction.csv", _transactions(rng, tr_ids, True)),
             _write(tmp, "train_identity.csv", _identity(rng, tr_ids[::2], False)),
             _write(tmp, "test_transaction.csv", _transactions(rng, te_ids, False)),
             _write(tmp, "test_identity.csv", _identity(rng, te_ids[::3], True))]
    feats = fraud.fraud_features(spark, *paths)
    cols = set(feats.columns)
    assert "V999" not in cols and "TransactionDT" not in cols and "cents" in cols
    assert {"card1_addr1", "card1_addr1_P_emaildomain", "addr1_FE", "card1_addr1_FE",
            "TransactionAmt_card1_mean", "D11_card1_addr1_P_emaildomain_std", "id_01", "id_12"} <= cols
    counts = {r["split"]: r["count"] for r in feats.groupBy("split").count().collect()}
    assert counts == {"train": 400, "test": 200}
    report, model = fraud.fraud_workflow(spark, *paths, epochs=3)
    r = report.first()
    assert r["n_test"] == 80 and 0.0 <= r["test_accuracy"] <= 1.0 and len(model.weights) == r["n_features"]
