"""Commits in a folder: a file that is there whole or not at all, and that only one writer can make."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


class AlreadyCommitted(Exception):
    """Another writer has made this commit."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the session (spark.checkpoint.dir), which may only be unset on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The file context, the file system and the path."""
    jvm = spark._jvm
    place, conf = jvm.org.apache.hadoop.fs.Path(path), spark._jsparkSession.sessionState().newHadoopConf()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf), place.getFileSystem(conf), place


def commit(spark: SparkSession, path: str, content: dict) -> None:
    """Write a JSON file under a name that is not taken: a hidden file first, which is then renamed. Raises AlreadyCommitted if the name is taken."""
    context, fs, place = _files(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    try:
        context.rename(hidden, place, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(hidden, False)
        if fs.exists(place):
            raise AlreadyCommitted(path) from e
        raise


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of the commits in a folder, sorted."""
    _, fs, place = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if not s.getPath().getName().startswith(".")) if fs.exists(place) else []


def content(spark: SparkSession, path: str) -> dict:
    _, fs, place = _files(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    _, fs, place = _files(spark, path)
    fs.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    return committed(spark, path)
