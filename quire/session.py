"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings every job here relies on; both can be changed on a live session.
REQUIRED_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing costs far more per byte than what Spark sizes tasks for: small
    # inputs should still spread over all cores. Without effect on large ones.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that decide results (ANSI casts, UTC) and task sizes."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once."""
    context = spark.sparkContext
    shipped = context.getLocalProperty("quire.shipped")
    if shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    context.setLocalProperty("quire.shipped", archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may fall back to a
    temporary folder: on a cluster such a folder would be lost with its host.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whichever kind that is."""
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small UTF-8 file."""
    handle, files = hadoop_path(spark, path)
    stream = files.open(handle)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small UTF-8 file."""
    handle, files = hadoop_path(spark, path)
    stream = files.create(handle, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, path: str, target: str) -> bool:
    """Rename a file unless the target exists; whether it was renamed."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    source, place = fs.Path(path), fs.Path(target)
    context = fs.FileContext.getFileContext(hadoop_path(spark, path)[1].getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, place, gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError as problem:
        if problem.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True
