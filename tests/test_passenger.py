from keelson.plans.passenger import preprocess_passengers

SCHEMA = ("PassengerId long, Survived int, Pclass long, Name string, Sex string, Age double, SibSp long, "
          "Parch long, Ticket string, Fare double, Cabin string, Embarked string")


def test_passenger_preprocessing(spark):
    train = spark.createDataFrame([
        (1, 0, 3, "Braund, Mr. Owen Harris", "male", 22.0, 1, 0, "A/5", 7.25, None, "S"),
        (2, 1, 1, "Cumings, Mrs. John Bradley", "female", 38.0, 1, 0, "PC", 71.2833, "C85", "C"),
        (3, 1, 3, "Heikkinen, Mlle. Laina", "female", 7.0, 0, 0, "STON", 25.0, None, None),
        (4, 0, 1, "Rothes, Countess. of", "female", None, 5, 4, "X", None, "B5", "S"),
    ], SCHEMA)
    test = spark.createDataFrame([
        (5, None, 2, "Kelly, Dr. James", "male", 50.0, 0, 0, "330911", 100.0, "E1", "Q"),
    ], SCHEMA)
    out = {r["PassengerId"]: r for r in preprocess_passengers(train, test).collect()}
    r1, r2, r3, r4, r5 = (out[i] for i in range(1, 6))
    assert (r1["Cabin_N"], r2["Cabin_C"], r4["Cabin_B"]) == (1, 1, 1)
    assert r4["Family_Size"] == 6 and r3["isAlone"] == 1 and r1["isAlone"] == 0
    assert r3["Title_Miss"] == 1 and r4["Title_Mrs"] == 1 and r5["Title_Mr"] == 0    # Dr -> Other, unseen in train
    assert r3["Embarked_S"] == 1                                                      # train mode fills the gap
    assert r1["Sex"] == 1 and r2["Sex"] == 0
    # label codes fitted on train: Age_Bin sorted: Adult, Child, Unknown, Young Adult; Fare bins: 0-25, 50-100, Unknown
    assert (r1["Age_Bin"], r2["Age_Bin"], r3["Age_Bin"], r4["Age_Bin"]) == (3, 0, 1, 2)
    assert r5["Age_Bin"] == -1                                                         # "Senior" unseen in train
    assert (r1["Fare_bin"], r3["Fare_bin"], r2["Fare_bin"], r4["Fare_bin"]) == (0, 0, 1, 2)
    assert r1["Age_Pclass"] == r1["Age_Bin"] * r1["Pclass"] and r3["isAlone_Sex"] == 0
    assert "Ticket" not in r1.asDict() and "Name" not in r1.asDict()


def test_passenger_workflow(spark):
    import os
    import tempfile

    import numpy as np
    import pandas as pd

    from keelson.plans.passenger import passenger_workflow

    rng = np.random.default_rng(2)

    def frame(ids, labelled):
        n = len(ids)
        sex = rng.choice(["male", "female"], n)
        df = pd.DataFrame({"PassengerId": ids, "Pclass": rng.integers(1, 4, n),
                           "Name": [f"Doe, {t}. X" for t in rng.choice(["Mr", "Mrs", "Miss", "Dr"], n)],
                           "Sex": sex, "Age": np.where(rng.random(n) < 0.2, np.nan, rng.integers(1, 80, n)),
                           "SibSp": rng.integers(0, 4, n), "Parch": rng.integers(0, 3, n), "Ticket": "T",
                           "Fare": rng.random(n) * 120, "Cabin": rng.choice(["C85", "B5", None], n),
                           "Embarked": rng.choice(["S", "C", "Q", None], n)})
        if labelled:
            df.insert(1, "Survived", ((sex == "female") ^ (rng.random(n) < 0.15)).astype(int))
        return df

    tmp = tempfile.mkdtemp(prefix="keelson-pass-")
    tr, te = os.path.join(tmp, "train.csv"), os.path.join(tmp, "test.csv")
    frame(np.arange(1, 201), True).to_csv(tr, index=False)
    frame(np.arange(1001, 1051), False).to_csv(te, index=False)
    out = {r["model"]: r for r in passenger_workflow(spark, tr, te, epochs=20).collect()}
    assert set(out) == {"lr_gd", "lr_gd_fixed20", "lr_gd_fixed40", "knn5", "knn3"}
    assert out["lr_gd"]["n"] == 40 and out["lr_gd"]["accuracy"] > 0.7      # the label follows Sex
    assert abs(out["lr_gd_fixed40"]["accuracy"] - out["lr_gd"]["accuracy"]) < 1e-9
