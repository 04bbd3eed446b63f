"""Labelled images in IDX files (magic, big-endian sizes, raw values), plain or gzip, as a Spark data source.

``path`` names an image file, a folder of them, or a glob; the labels of ``x-images-idx3-ubyte`` lie beside it in
``x-labels-idx1-ubyte``. A partition is a range of records of
one file: a plain file is read from the range's place, a gzip stream is read up to its end and what lies before is
skipped, so its ranges are larger. Columns: image_id (record number through all files in name order), pixels, label
(null where there is no label file). Files whose size does not fit their header are refused.

Written frames need columns pixels (equal lengths, ``height`` x ``width``) and label; every task writes a pair of files
under a name of its own, which the commit puts in place.
"""

from __future__ import annotations

import fnmatch
import gzip
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship_package
from .shared import open_shared

# The format's type codes.
TYPES = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}
CODES = {"ubyte": 0x08, "byte": 0x09, "short": 0x0B, "int": 0x0C, "float": 0x0D, "double": 0x0E}
SCHEMA = "image_id bigint, pixels array<float>, label int"
#: Records per partition of a plain file and of a gzip file; records per Arrow batch.
RANGE_ROWS, GZIP_ROWS, BATCH_ROWS = 1 << 16, 1 << 18, 1024


@dataclass
class IdxRange(InputPartition):
    images: str
    labels: str | None
    first: int
    begin: int
    end: int


class _Values:
    """The values of an IDX file; ``rows(begin, end)`` reads a range of records."""

    def __init__(self, path: str):
        self.fs, self.path = open_shared(path)
        info = self.fs.get_file_info(self.path)
        self.gzip, self.file = path.endswith(".gz"), self.fs.open_input_file(self.path)
        self.stream = gzip.GzipFile(fileobj=self.file) if self.gzip else self.file
        head = self._exactly(4)
        if head[:2] != b"\0\0" or head[2] not in TYPES or not head[3]:
            raise ValueError(f"{path}: not an IDX file")
        self.shape = np.frombuffer(self._exactly(4 * head[3]), ">u4").astype(np.int64).tolist()
        self.type, self.at = np.dtype(TYPES[head[2]]), 4 + 4 * head[3]
        self.record = int(np.prod(self.shape[1:], dtype=np.int64)) * self.type.itemsize
        if not self.gzip and info.size != self.at + self.shape[0] * self.record:
            raise ValueError(f"{path}: {info.size} bytes, its header says {self.at + self.shape[0] * self.record}")

    def _exactly(self, n: int) -> bytes:
        try:
            data = self.stream.read(n)
        except EOFError:
            data = b""
        if len(data) != n:
            raise ValueError(f"{self.path}: the file is truncated")
        return data

    def skip_to(self, record: int) -> None:
        if not self.gzip:
            self.file.seek(self.at + record * self.record)
            return
        left = record * self.record
        while left:
            left -= len(self._exactly(min(left, 1 << 20)))

    def next_rows(self, n: int) -> np.ndarray:
        return np.frombuffer(self._exactly(n * self.record), self.type).reshape(n, -1)

    def check_end(self) -> None:
        """Nothing may follow the last record (a gzip stream is checked to its end, checksum included)."""
        try:
            if self.gzip and self.stream.read(1):
                raise ValueError(f"{self.path}: more values than its header says")
        except EOFError:
            raise ValueError(f"{self.path}: the file is truncated") from None


def _found(path: str) -> list[str]:
    """The image files that a path, folder or glob names, in the order of their names."""
    from pyarrow.fs import FileSelector, FileType

    folder, name = os.path.split(path.rstrip("/"))
    if not any(c in name for c in "*?["):
        fs, place = open_shared(path)
        kind = fs.get_file_info(place).type
        if kind == FileType.File:
            return [path]
        if kind != FileType.Directory:
            raise ValueError(f"{path}: no such file or folder")
        folder, name = path.rstrip("/"), "*images*"
    fs, place = open_shared(folder)
    names = sorted(f.base_name for f in fs.get_file_info(FileSelector(place)) if f.type == FileType.File and fnmatch.fnmatch(f.base_name, name))
    return [f"{folder}/{n}" for n in names if not n.startswith(("_", "."))]


def _labels_of(images: str) -> str | None:
    from pyarrow.fs import FileType

    folder, name = os.path.split(images)
    beside = f"{folder}/{re.sub('idx3-[a-z]+', 'idx1-ubyte', name.replace('images', 'labels'))}"
    fs, place = open_shared(beside)
    return beside if beside != images and fs.get_file_info(place).type == FileType.File else None


class IdxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.rows = int(options["rangerows"]) if "rangerows" in options else None

    def partitions(self) -> list[IdxRange]:
        out, first = [], 0
        for images in _found(self.path):
            values, labels = _Values(images), _labels_of(images)
            n = values.shape[0]
            if labels is not None and _Values(labels).shape != [n]:
                raise ValueError(f"{labels}: not {n} labels")
            step = self.rows or (GZIP_ROWS if values.gzip else RANGE_ROWS)
            out += [IdxRange(images, labels, first, b, min(n, b + step)) for b in range(0, max(n, 1), step)]
            first += n
        return out

    def read(self, partition: IdxRange):
        images = _Values(partition.images)
        labels = _Values(partition.labels) if partition.labels else None
        for v in (images, labels):
            if v is not None:
                v.skip_to(partition.begin)
        for begin in range(partition.begin, partition.end, BATCH_ROWS):
            n = min(BATCH_ROWS, partition.end - begin)
            x = images.next_rows(n).astype("<f4")
            ids = np.arange(n, dtype=np.int64) + partition.first + begin
            pixels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            y = pa.array(labels.next_rows(n).reshape(-1).astype(np.int32)) if labels else pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pixels, y], ["image_id", "pixels", "label"])
        if partition.end == images.shape[0]:
            images.check_end()
            if labels is not None:
                labels.check_end()


@dataclass
class IdxFiles(WriterCommitMessage):
    pairs: list


class IdxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.shape = int(options["height"]), int(options["width"])
        self.kind, self.gzip = options.get("type", "ubyte"), options.get("compression", "") == "gzip"

    def write(self, iterator) -> IdxFiles:
        code = CODES[self.kind]
        kind, size = np.dtype(TYPES[code]), self.shape[0] * self.shape[1]
        fs, place = open_shared(self.path)
        fs.create_dir(place, recursive=True)
        # the header holds the number of records, so the values wait in one file until it is known
        held = [f"{place}/_{uuid.uuid4().hex}" for _ in range(4)]
        n = 0
        with fs.open_output_stream(held[0]) as xs, fs.open_output_stream(held[1]) as ys:
            for b in iterator:
                if not b.num_rows:
                    continue
                pixels, label = b.column(b.schema.get_field_index("pixels")), b.column(b.schema.get_field_index("label"))
                if pixels.null_count or label.null_count or (np.diff(pixels.offsets.to_numpy()) != size).any():
                    raise ValueError(f"every row needs a label and {size} pixels")
                flat, y = pixels.flatten().to_numpy(zero_copy_only=False), label.to_numpy()
                if kind.kind in "iu" and ((flat != np.floor(flat)) | (flat < np.iinfo(kind).min) | (flat > np.iinfo(kind).max)).any():
                    raise ValueError(f"pixels that are no {self.kind}")
                if (y < 0).any() or (y > 255).any():
                    raise ValueError("labels must be 0 .. 255")
                xs.write(flat.astype(kind).tobytes())
                ys.write(y.astype(np.uint8).tobytes())
                n += b.num_rows
        suffix = ".gz" if self.gzip else ""
        name = f"part-{TaskContext.get().partitionId():06d}"
        pairs = [(held[2], f"{place}/{name}-images-idx3-{self.kind}{suffix}"), (held[3], f"{place}/{name}-labels-idx1-ubyte{suffix}")]
        heads = (bytes([0, 0, code, 3]) + np.array([n, *self.shape], ">u4").tobytes(), bytes([0, 0, 8, 1]) + np.array([n], ">u4").tobytes())
        for source, (target, _), head in zip(held, pairs, heads):
            with fs.open_input_stream(source) as data, fs.open_output_stream(target) as raw:
                out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.gzip else raw
                out.write(head)
                while part := data.read(1 << 20):
                    out.write(part)
                if self.gzip:
                    out.close()
            fs.delete_file(source)
        return IdxFiles(pairs if n else [])

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, place = open_shared(self.path)
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(place, allow_not_found=True)):
                if "-idx" in f.base_name and not f.base_name.startswith("_"):
                    fs.delete_file(f.path)
        for m in messages:
            for held, target in m.pairs if m else ():
                fs.move(held, target)

    def abort(self, messages: list) -> None:
        fs, _ = open_shared(self.path)
        for m in messages:
            for held, _ in m.pairs if m else ():
                fs.delete_file(held)


class IdxDataSource(DataSource):
    """``spark.read.format("idx").load(path)`` and ``df.write.format("idx").option("height", h).option("width", w).save(path)``
    after :func:`register_idx`."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdxReader:
        return IdxReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> IdxWriter:
        return IdxWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register_idx(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(IdxDataSource)


def read_idx(spark: SparkSession, path: str, range_rows: int | None = None) -> DataFrame:
    register_idx(spark)
    reader = spark.read.format("idx")
    return (reader.option("rangeRows", str(range_rows)) if range_rows else reader).load(path)


def write_idx(df: DataFrame, path: str, height: int, width: int, kind: str = "ubyte", compression: str = "") -> str:
    register_idx(df.sparkSession)
    df.select("pixels", "label").write.format("idx").option("height", str(height)).option("width", str(width)).option(
        "type", kind).option("compression", compression).mode("overwrite").save(path)
    return path
