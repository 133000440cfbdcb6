"""Folders and small files of the shared file system, through Spark's own file access."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, folder: str):
    """Path and file system of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what is in it, or a file; nothing happens if it does not exist."""
    path, system = _system(spark, folder)
    system.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    path, system = _system(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []


def read_text(spark: SparkSession, file: str) -> str | None:
    """A small file; None if it does not exist."""
    path, system = _system(spark, file)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, file: str, text: str) -> bool:
    """A small file that appears whole and only if there is none of that name; whether it did.

    It is written beside its place and then given its name: by a link on a local file system, by a renaming that does
    not overwrite elsewhere.  Of several writers of one name exactly one succeeds where the file system does these in
    one step, as local ones and HDFS do.
    """
    jvm = spark.sparkContext._jvm
    path, system = _system(spark, file)
    aside, _ = _system(spark, f"{file.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    stream = system.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if system.getScheme() == "file":
            place = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (path, aside)]
            jvm.java.nio.file.Files.createLink(*place)
        else:
            options = jvm.org.apache.hadoop.fs.Options.Rename
            kept = spark.sparkContext._gateway.new_array(options, 1)
            kept[0] = options.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), system.getConf())
            context.rename(aside, path, kept)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        system.delete(aside, False)
    return True
