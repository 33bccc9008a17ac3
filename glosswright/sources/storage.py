"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group of intermediate tables: a task holds one while writing and one while
#: reading, and a file is split between them.
_ROW_GROUP = 16 << 20

#: Seconds between two calls of tidy() that do something, and how many times as long as the last one took.
_TIDY_S, _TIDY_TIMES = 10, 50

_local_dir: list[str] = []
_open: list[Scratch] = []
_tidy_at = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only a local-mode session may go without that setting: it then gets a temporary
    folder, which is removed when the process ends.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="glosswright-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return _local_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns the table read back.

    This cuts the lineage: a lost executor costs the tasks it was running, never the
    steps that led here. The shuffles of the write go with it, the table goes with the
    innermost scratch() around the call.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if _open:
        _open[-1].paths.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    tidy(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def give_back() -> None:
    """Hands this process' free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Hands the driver's free memory back to the system, in Python and in its JVM; most calls do nothing.

    A step of some hundred jobs leaves plans, broadcasts and what the JVM's compiler freed
    behind, and a JVM with room in its heap keeps all of that. The time between two calls
    that collect garbage grows with the time that takes.
    """
    began = time.monotonic()
    if began < _tidy_at[0]:
        return
    give_back()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    took = time.monotonic() - began
    _tidy_at[0] = began + max(_TIDY_S, _TIDY_TIMES * took)


def trim_jvm(spark: SparkSession) -> str:
    """The JVM's answer to System.trim_native_heap; empty where it doesn't know that."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class isn't open to Py4J, its interface is
        invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:
        return ""


class Scratch:
    """The tables materialised since scratch() began."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables whose last reader is done."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path in self.paths:
                self.paths.remove(path)
                delete(self.spark, path)

    def keep(self, table: DataFrame) -> DataFrame:
        """Hands a table to the scratch() around this one, or lets it stay if there is none."""
        path = table._scratch_path
        self.paths.remove(path)
        if i := _open.index(self):
            _open[i - 1].paths.append(path)
        return table


def discard(table: DataFrame) -> None:
    """Deletes a table of materialize() that no scratch() holds."""
    delete(table.sparkSession, table._scratch_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables materialised inside are deleted at the end, on failure too."""
    held = Scratch(spark)
    _open.append(held)
    try:
        yield held
    finally:
        _open.remove(held)
        for path in held.paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path, wherever it lies, if it's there."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
