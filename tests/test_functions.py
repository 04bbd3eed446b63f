import math

from keelson.functions import scalar as S
from keelson.functions.arrays import argmax, dot_literal, fixed_point, log_sum_exp, squared_distance
from keelson.functions.hashing import hash_uniform


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.0,)], "p double")
    assert [r[0] for r in df.select(S.threshold_label("p")).collect()] == [0, 1, 0]


def test_close_enough_at_half_is_wrong(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1)], "p double, y int")
    assert [r[0] for r in df.select(S.close_enough("p", "y")).collect()] == [False, False, True]


def test_flag_null_is_false(spark):
    df = spark.createDataFrame([("male",), (None,), ("female",)], "s string")
    assert [r[0] for r in df.select(S.flag_equals("s", "male")).collect()] == [True, False, False]


def test_extract_no_match_is_null(spark):
    df = spark.createDataFrame([("C85",), ("123",), (None,), ("Braund, Mr. Owen",)], "s string")
    out = df.select(S.extract_first("s", S.LETTER_RUN).alias("a"), S.extract_first("s", S.TITLE_BEFORE_DOT).alias("t"))
    assert rows(out) == [("C", None), (None, None), (None, None), ("Braund", "Mr")]


def test_bins_edges_and_unknown(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (20.0,), (None,), (-1.0,)], "x double")
    left = [r[0] for r in df.select(S.bin_left_closed("x", [0, 5, 20], ["a", "b"])).collect()]
    assert left == ["a", "b", "b", "Unknown", "Unknown", "Unknown"]
    right = [r[0] for r in df.select(S.bin_right_closed("x", [-math.inf, 0, 10, math.inf], ["n", "s", "l"])).collect()]
    assert right == ["n", "s", "s", "l", "Unknown", "n"]


def test_capped_sum_and_fraction(spark):
    df = spark.createDataFrame([(3, 5, 2.75), (1, 1, -1.25), (None, 1, 3.0)], "a int, b int, x double")
    out = rows(df.select(S.capped_sum("a", "b", 6), S.fractional_part("x")))
    assert out == [(6, 0.75), (2, 0.75), (None, 0.0)]


def test_replace_mapping_keeps_unmapped(spark):
    df = spark.createDataFrame([("Mlle",), ("Mr",), (None,)], "t string")
    out = [r[0] for r in df.select(S.replace_mapping("t", {"Mlle": "Miss", "Ms": "Miss"})).collect()]
    assert out == ["Miss", "Mr", None]


def test_bround_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.5,)], "x double")
    assert [r[0] for r in df.select(S.round_half_even("x")).collect()] == [2.0, 4.0, 0.0]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(argmax("a"), squared_distance("a", "b"), dot_literal("a", [1.0, 2.0, 0.5]), log_sum_exp("a")).first()
    assert r[0] == 1
    assert r[1] == 8.0
    assert r[2] == 8.5
    assert abs(r[3] - math.log(math.exp(1) + 2 * math.exp(3))) < 1e-12


def test_fixed_point_grid(spark):
    df = spark.createDataFrame([([0.1, -0.30000001, 2.5 / 256],)], "a array<double>")
    out = df.select(fixed_point("a", 8)).first()[0]
    assert out == [round(0.1 * 256) / 256, round(-0.30000001 * 256) / 256, 2.0 / 256]


def test_hash_uniform_is_stable_and_in_range(spark):
    df = spark.range(1000)
    a = [r[0] for r in df.select(hash_uniform(42, "id")).collect()]
    b = [r[0] for r in df.repartition(7).orderBy("id").select(hash_uniform(42, "id")).collect()]
    assert a == b
    assert all(0.0 <= x < 1.0 for x in a)
    assert 0.4 < sum(a) / len(a) < 0.6
