import gzip

import numpy as np
import pytest

from keelson.sources.idx import read_idx, write_idx


def put(path, x, y, pack=open, cut=0):
    with pack(f"{path}-images-idx3-ubyte{'.gz' if pack is gzip.open else ''}", "wb") as f:
        data = bytes([0, 0, 8, 3]) + np.array(x.shape, ">u4").tobytes() + x.astype(np.uint8).tobytes()
        f.write(data[:len(data) - cut])
    if y is not None:
        with pack(f"{path}-labels-idx1-ubyte{'.gz' if pack is gzip.open else ''}", "wb") as f:
            f.write(bytes([0, 0, 8, 1]) + np.array([len(y)], ">u4").tobytes() + np.asarray(y, np.uint8).tobytes())


def rows(df):
    return sorted((r.image_id, list(r.pixels), r.label) for r in df.collect())


@pytest.mark.parametrize("pack", [open, gzip.open])
def test_files_of_others(spark, tmp_path, pack):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (50, 4, 3)), rng.integers(0, 10, 50)
    put(tmp_path / "a", x[:30], y[:30], pack)
    put(tmp_path / "b", x[30:], y[30:], pack)
    df = read_idx(spark, str(tmp_path), range_rows=7)
    assert df.rdd.getNumPartitions() == 8 and df.dtypes == [("image_id", "bigint"), ("pixels", "array<float>"), ("label", "int")]
    assert rows(df) == [(i, x[i].reshape(-1).astype(float).tolist(), int(y[i])) for i in range(50)]
    one = "a-images-idx3-ubyte" + (".gz" if pack is gzip.open else "")
    assert len(rows(read_idx(spark, f"{tmp_path}/{one}"))) == 30 and len(rows(read_idx(spark, f"{tmp_path}/b-im*"))) == 20


def test_without_labels_and_empty(spark, tmp_path):
    put(tmp_path / "n", np.ones((3, 2, 2)), None)
    assert rows(read_idx(spark, str(tmp_path))) == [(i, [1.0] * 4, None) for i in range(3)]
    put(tmp_path / "m", np.ones((0, 2, 2)), [])
    assert len(rows(read_idx(spark, str(tmp_path)))) == 3


@pytest.mark.parametrize("pack", [open, gzip.open])
def test_broken_files_are_refused(spark, tmp_path, pack):
    put(tmp_path / "c", np.ones((20, 2, 2)), [1] * 20, pack, cut=3)
    with pytest.raises(Exception, match="truncated|header says"):
        read_idx(spark, str(tmp_path)).collect()
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "x", np.ones((20, 2, 2)), [1] * 19, pack)
    with pytest.raises(Exception, match="not 20 labels"):
        read_idx(spark, f"{tmp_path}/d").collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x-images-idx3-ubyte").write_bytes(b"PK\3\4 no such format")
    with pytest.raises(Exception, match="not an IDX file"):
        read_idx(spark, f"{tmp_path}/e").collect()
    if pack is gzip.open:  # a stream that was cut off
        whole = tmp_path / "d" / "x-images-idx3-ubyte.gz"
        (tmp_path / "f").mkdir()
        (tmp_path / "f" / "y-images-idx3-ubyte.gz").write_bytes(whole.read_bytes()[:-6])
        with pytest.raises(Exception, match="truncated"):
            read_idx(spark, f"{tmp_path}/f").collect()


@pytest.mark.parametrize("kind,compression", [("ubyte", ""), ("ubyte", "gzip"), ("float", ""), ("double", "gzip"), ("short", "")])
def test_round_trip(spark, tmp_path, kind, compression):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 200, (40, 6)).astype(float) if kind in ("ubyte", "short") else rng.standard_normal((40, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "k long, pixels array<float>, label int")
    path = write_idx(df.repartitionByRange(3, "k").sortWithinPartitions("k"), str(tmp_path / "out"), 2, 3, kind, compression)
    assert rows(read_idx(spark, path)) == [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
    again = write_idx(df.limit(5).repartition(1), path, 2, 3, kind, compression)  # replaces the files
    assert len(rows(read_idx(spark, again))) == 5
    with pytest.raises(Exception, match="6 pixels|9 pixels"):
        write_idx(df, str(tmp_path / "bad"), 3, 3, kind)
