"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches handed to mapInPandas scorers; bounded so a batch fits a task.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # checkpoint files of frames that are no longer referenced are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Spark already runs one task per core: NumPy's BLAS in Python workers stays single-threaded
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app: str = "keelson",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests: driver and tasks are one process) may fall
    back to a private temp folder; on a cluster the setting must name shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of their own
        raise RuntimeError("spark.checkpoint.dir is unset; set it to shared storage")
    local = tempfile.mkdtemp(prefix="keelson-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate files under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "keelson-scratch", name) if "://" not in base else f"{base.rstrip('/')}/keelson-scratch/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): survives executor loss.

    A reliable checkpoint writes its files in a second job after the eager count;
    without a persisted input that job recomputes the whole upstream plan. The
    input is persisted for the duration of the checkpoint and released after."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


#: Bytes of rows that are packed together by :func:`cut_packed`.
PACK_BYTES = 4 * 1024 * 1024


def _packed(batches):
    import pyarrow as pa

    def one(rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in rows:
                out.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
            if size >= PACK_BYTES:
                yield one(held)
                held, size = [], 0
    if held:
        yield one(held)


def _unpacked(batches):
    import pyarrow as pa

    for b in batches:
        for rows in b.column(0):
            with pa.ipc.open_stream(rows.as_buffer()) as stream:
                yield from stream


def cut_packed(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for wide or many rows: the checkpoint holds them in compressed batches, about half the bytes of
    rows one by one, and so does the copy kept while it is written. Every read unpacks them. Partitions and the order of rows in them stay."""
    ship_package(df.sparkSession)
    return cut_lineage(df.mapInArrow(_packed, "rows binary")).mapInArrow(_unpacked, df.schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of frames that nothing refers to any more: it does so when the
    driver's JVM collects its garbage, which with a large heap may be long after."""
    import gc
    import time

    gc.collect()
    # a thread of the gateway tells the JVM which objects Python has let go
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    end = time.monotonic() + 5
    while waiting and time.monotonic() < end:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


def _write_bytes(spark: SparkSession, target: str, data: bytes) -> None:
    """Write a small file to the shared folder (local path or any Hadoop filesystem)."""
    if target.startswith("file:"):
        local = target[len("file:"):]
        while local.startswith("//"):
            local = local[1:]
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as fh:
            fh.write(data)
        return
    if "://" not in target:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as fh:
            fh.write(data)
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (``mapInPandas`` stages
    reference its functions by module). The package is zipped into the shared
    scratch folder and added with ``addPyFile`` once per SparkContext."""
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_keelson_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("keelson", os.path.relpath(full, pkg_dir)))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    target = scratch_path(spark, f"pyfiles/{digest}/keelson.zip")
    _write_bytes(spark, target, data)
    sc.addPyFile(target)
    sc._keelson_shipped = True
