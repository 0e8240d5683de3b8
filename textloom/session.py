"""Session set-up, shared work folders and shipping of this package to executors."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch between the JVM and a Python worker; long texts make large batches.
ARROW_ROWS = "1000"


def get_session(cpus: str = "*", app: str = "textloom", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor and keep Arrow batches small.

    The package is zipped once per application and handed to Spark's file server, so
    executors need neither the source tree nor a shared disk.
    """
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    sc._textloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Only where the session names none and runs on one machine (tests, a laptop) is a temporary
    folder made; on a cluster executors could not read it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = getattr(spark.sparkContext, "_textloom_shared", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="textloom-shared-")
            spark.sparkContext._textloom_shared = base
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`materialize` has written; call it when no result needs them any more."""
    while _made:
        _delete(spark, _made.pop())


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for df in tables:
        path = getattr(df, "_textloom_path", None)
        if path in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: its cleaner acts on what the driver has collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: losing an executor later costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name for use inside an operator that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def lean(run):
    """``run``, a function of Arrow batches, after which the worker hands freed memory back to the system.

    Workers live on between tasks, and what the allocators keep would count against their executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return wrapped


def _hand_back() -> None:
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
