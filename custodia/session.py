"""Session and shared-folder helpers."""

import atexit
import contextlib
import functools
import os
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def local_session(cpus="*", shuffle_partitions=8, **conf):
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("custodia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # call sites for error messages cost several driver calls per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    Only a session whose executors are this process may use a temporary folder of the machine."""
    configured = spark.conf.get(_DIR_KEY, None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_DIR_KEY} to a folder shared by all executors")
    return _local_fallback()


@functools.cache
def _local_fallback():
    path = tempfile.mkdtemp(prefix="custodia-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_owned = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed with the application's others when its JVM ends."""
    context = spark.sparkContext
    work = os.path.join(shared_dir(spark), "custodia", context.applicationId)
    if work not in _owned:
        folder = context._jvm.org.apache.hadoop.fs.Path(work)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _owned.add(work)
    path = os.path.join(work, f"{name}-{uuid.uuid4().hex}")
    if (made := getattr(_scratch, "made", None)) is not None:
        made.append(path)
    return path


_scratch = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that are written meanwhile, by this thread, at the end."""
    _scratch.made = []
    try:
        yield
    finally:
        made, _scratch.made = _scratch.made, None
        for path in made:
            remove(spark, path)


def is_folder(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def union(*frames: DataFrame, allow_missing=False) -> DataFrame:
    """All rows of the frames, by column name.

    Spark 4.1 may report a union as hash-partitioned when its inputs are; after adaptive
    coalescing of an input that no longer holds, and a grouping above it gives wrong rows.
    The session setting below keeps a union from claiming a partitioning."""
    first, *rest = frames
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=allow_missing)
    return first
