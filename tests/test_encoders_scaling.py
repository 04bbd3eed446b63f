from keelson.operators import clean, encode, ranking, scale


def test_label_codes_sorted_null_and_unseen(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, c string")
    test = spark.createDataFrame([(5, "z"), (6, "a")], "id int, c string")
    codes = encode.fit_label_codes(train, ["c"])
    out = encode.apply_label_codes(train.unionByName(test), codes, ["c"])
    got = {r["id"]: r["c"] for r in out.collect()}
    assert got == {1: 1, 2: 0, 3: -1, 4: 1, 5: -1, 6: 0}


def test_label_codes_numeric_order(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, 100.0)], "id int, x double")
    got = {r["id"]: r["x"] for r in encode.label_encode(df, ["x"]).collect()}
    assert got == {1: 1, 2: 0, 3: 2}


def test_dense_codes_over_range_partitions(spark):
    df = spark.createDataFrame([(f"v{i % 37:03d}",) for i in range(500)], "c string").repartition(7)
    codes = {r["c"]: r["code"] for r in ranking.dense_codes(df, "c").collect()}
    assert codes == {f"v{i:03d}": i for i in range(37)}


def test_freq_encode_null_and_sentinel(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, -1), (4, None), (5, 7)], "id int, c int")
    got = {r["id"]: r["c_FE"] for r in encode.freq_encode(df, ["c"]).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: -1.0, 4: None, 5: 0.25}


def test_group_stats_single_row_and_sentinel(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (3, 2, 7.0), (4, 3, -1.0)], "id int, u int, v double")
    out = encode.group_stat_encode(df, ["v"], ["u"], ["mean", "std"], usena=True, fillna=True)
    got = {r["id"]: (r["v_u_mean"], r["v_u_std"]) for r in out.collect()}
    assert got[1] == (3.0, 2.0 ** 0.5)
    assert got[3] == (7.0, -1.0)           # one row: sample std undefined -> -1
    assert got[4] == (-1.0, -1.0)          # only the sentinel -> nothing to average


def test_group_nunique_ignores_null(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, None), (4, 2, "a")], "id int, u int, c string")
    got = {r["id"]: r["u_c_ct"] for r in encode.group_nunique_encode(df, ["c"], ["u"]).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 1}


def test_one_hot_null_all_zero(spark):
    df = spark.createDataFrame([(1, "S"), (2, "C"), (3, None)], "id int, e string")
    cats = encode.one_hot_categories(df, "e")
    out = {r["id"]: (r["e_C"], r["e_S"]) for r in encode.one_hot(df, "e", cats).collect()}
    assert cats == ["C", "S"]
    assert out == {1: (0, 1), 2: (1, 0), 3: (0, 0)}


def test_combine_uses_nan_text(spark):
    df = spark.createDataFrame([(1, 3, "x"), (2, None, "x"), (3, 3, None)], "id int, a int, b string")
    got = [r[0] for r in df.select(encode.combine_columns("a", "b")).collect()]
    assert got == ["3_x", "nan_x", "3_nan"]


def test_codes_and_frequencies_keep_types_apart(spark):
    """Neighbouring 64-bit keys, dates, decimals and the text "-1" stay what they are."""
    import datetime as dt
    from decimal import Decimal
    big = 2 ** 53
    rows = [(i, k, d, m, s) for i, (k, d, m, s) in enumerate([
        (big, dt.date(2020, 1, 1), Decimal("0.10"), "-1"), (big + 1, dt.date(2020, 1, 2), Decimal("0.11"), "x"),
        (big + 1, dt.date(2020, 1, 2), Decimal("0.11"), "x"), (-1, None, None, None)])]
    df = spark.createDataFrame(rows, "id int, k long, d date, m decimal(12,2), s string")
    cols = ["k", "d", "m", "s"]
    codes = {r["id"]: tuple(r[f"{c}_c"] for c in cols) for r in encode.label_encode(df, cols, suffix="_c").collect()}
    assert codes == {0: (1, 0, 0, 0), 1: (2, 1, 1, 1), 2: (2, 1, 1, 1), 3: (0, -1, -1, -1)}
    freq = {r["id"]: tuple(r[f"{c}_FE"] for c in cols) for r in encode.freq_encode(df, cols).collect()}
    third = 1 / 3
    assert freq == {0: (0.25, third, third, third), 1: (0.5, 2 / 3, 2 / 3, 2 / 3), 2: (0.5, 2 / 3, 2 / 3, 2 / 3), 3: (-1.0, None, None, None)}


def test_min_shift_leaves_exempt_columns_alone(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, 2.0), (3, 7.0, 3.0)], "id int, a double, b double")
    out = {r["id"]: (r["a"], r["b"]) for r in scale.min_shift(df, ["a", "b"], exempt=["b"]).collect()}
    assert out == {1: (0.0, None), 2: (-1.0, 2.0), 3: (2.0, 3.0)}


def test_fill_mode_fits_on_another_frame(spark):
    fit = spark.createDataFrame([(7, "a"), (7, "b"), (8, "b")], "x int, y string")
    df = spark.createDataFrame([(None, None), (9, "c")], "x int, y string")
    assert sorted(map(tuple, clean.fill_mode(df, ["x", "y"], fit_on=fit).collect())) == [(7, "b"), (9, "c")]
    assert clean.column_modes(df.where("x IS NULL"), ["x", "y"]) == {"x": None, "y": None}


def test_fill_mode_tie_smallest(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 1), (5, None)], "id int, x int")
    got = {r["id"]: r["x"] for r in clean.fill_mode(df, ["x"]).collect()}
    assert got[5] == 1


def test_standardize_population_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, c double")
    out = {r["id"]: (r["a"], r["c"]) for r in scale.standardize_population(df, ["a", "c"]).collect()}
    assert out == {1: (-1.0, 0.0), 2: (1.0, 0.0)}


def test_standardize_sample(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id int, a double")
    out = {r["id"]: r["a"] for r in scale.standardize_sample(df, ["a"]).collect()}
    s = 2 ** 0.5
    assert out == {1: -1 / s, 2: 1 / s}


def test_rename_positional_checks_count(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.rename_positional(df, ["x", "y"]).columns == ["x", "y"]
    try:
        clean.rename_positional(df, ["x"])
        raise AssertionError("expected failure")
    except ValueError:
        pass


def test_label_codes_of_several_columns_over_range_partitions(spark):
    df = spark.createDataFrame([(i, f"k{i % 53:03d}", float(i % 41)) for i in range(400)], "id int, c string, x double").repartition(9)
    got = {r["id"]: (r["c"], r["x"]) for r in encode.label_encode(df, ["c", "x"]).collect()}
    assert got == {i: (i % 53, i % 41) for i in range(400)}
