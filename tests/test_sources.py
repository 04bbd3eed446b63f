import os
import tempfile

import pytest
from pyspark.sql import types as T

from keelson.sources import csv as C
from keelson.sources.images import pixel_normalize, scan_images, to_rows
from tests.conftest import SF_SMALL


def test_wide_schema_overrides_and_numbered():
    names = C.numbered("id_", 1, 3, width=2)
    assert names == ["id_01", "id_02", "id_03"]
    st = C.wide_schema(["key"], float_cols=names, string_cols=["id_02"])
    assert [f.dataType for f in st.fields] == [T.LongType(), T.FloatType(), T.FloatType(), T.StringType()]
    with pytest.raises(ValueError):
        C.wide_schema([], float_cols=["a"], order=["a", "b"])


def test_csv_roundtrip_pruned(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="keelson-test-"), "t")
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "k long, v double, s string")
    C.write_csv(df, path)
    st = C.wide_schema(["k"], ["v"], ["s"])
    back = C.read_csv(spark, path, st, columns=["k", "s"])
    assert sorted(map(tuple, back.collect())) == [(1, "x"), (2, "y")]


def test_scan_images_and_normalize(spark):
    df = scan_images(spark, f"{SF_SMALL}/embeddings.parquet", "vec_id", "embedding", "label", 8, 8)
    r = pixel_normalize(df, scale=255.0).first()
    raw = df.first()
    assert abs(r["pixels"][0] - (raw["pixels"][0] * 255.0 - 0.1307) / 0.3081) < 1e-9
    rows2d = to_rows(df, "pixels", 8).first()["image2d"]
    assert len(rows2d) == 8 and all(len(x) == 8 for x in rows2d)
    with pytest.raises(Exception):
        scan_images(spark, f"{SF_SMALL}/embeddings.parquet", "vec_id", "embedding", "label", 7, 7).collect()
