"""What all parts share: tables written on the way, and memory given back."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that every executor can read.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, which has no
    other machines, may fall back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="lectern-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/lectern-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


def persist_table(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    The files stay until ``discard`` or ``release`` removes them, at the latest when the process ends.
    ``last`` says that nothing else reads the shuffles behind ``df``: the driver collects its
    garbage, upon which Spark removes their files now instead of some time later. What still holds
    the plan of the finished write lets go of it within a second, so it is collected twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    if last:
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(1)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``persist_table`` returned and nothing reads any more."""
    files = df.inputFiles()
    for entry in [e for e in _written if files and any(f"/{e[1].rsplit('/', 2)[-2]}/" in f for f in files[:1])]:
        _remove(*entry)
        _written.remove(entry)


def release() -> None:
    """Remove all tables that the operators have written so far; their results must have been read or stored."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the session may be gone already
        _written.clear()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def tidied(made: Iterator) -> Iterator:
    """What ``made`` yields; at its end the worker gives the memory that it no longer needs back to the system.

    Workers are used again and wait beside each other in an executor, as many as ever ran at once;
    without this each keeps what its largest task took.
    """
    try:
        yield from made
    finally:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)
