import os
import tempfile

import numpy as np
import pandas as pd

from keelson.plans import diabetes


def test_diabetes_workflow(spark):
    rng = np.random.default_rng(1)
    n = 240
    df = pd.DataFrame({c: rng.integers(0, 100, n) for c in diabetes.FEATURES})
    df["BMI"] = rng.normal(30, 5, n)
    df["DiabetesPedigreeFunction"] = rng.random(n)
    df[diabetes.LABEL] = ((df["Glucose"] + rng.normal(0, 20, n)) > 60).astype(int)
    path = os.path.join(tempfile.mkdtemp(prefix="keelson-diab-"), "diabetes.csv")
    df.to_csv(path, index=False)
    out = {r["model"]: r for r in diabetes.diabetes_workflow(spark, path, epochs=30).collect()}
    assert set(out) == {"lr_gd", "knn5", "knn3"}
    smallest = int(min(df[diabetes.LABEL].sum(), n - df[diabetes.LABEL].sum()))
    assert out["lr_gd"]["n"] == int(2 * smallest * 0.3)
    assert out["lr_gd"]["auc"] > 0.7               # the label follows Glucose
