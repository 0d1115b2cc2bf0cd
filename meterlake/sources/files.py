"""Paths on the file system the session is configured for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """Scheme, authority and path of a path as it is given, completed by the session's defaults."""
    fs, p = _fs(spark, path)
    uri = fs.makeQualified(p).toUri()
    return uri.getScheme() or "", uri.getAuthority() or "", uri.getPath()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that is there whole or not at all: under a hidden name first, and then
    renamed. A file that is there already stays, and is an error."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/_{uuid.uuid4().hex}-{name}"
    fs, p = _fs(spark, hidden)
    stream = fs.create(p, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if exists(spark, path):
        raise FileExistsError(path)
    renamed(spark, hidden, path)


def renamed(spark: SparkSession, path: str, to: str) -> str:
    """Gives a file another name in its file system; returns the name."""
    fs, p = _fs(spark, path)
    if not fs.rename(p, _fs(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")
    return to


@contextmanager
def writing(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """For writes only: a write is planned anew each time, so that nothing reads its shuffles again.
    ``settings`` hold for these writes, too."""
    changed = FREED | (settings or {})
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for tables that cut lineage or hold intermediate data: below the shared
    folder of spark.checkpoint.dir; only a session without one (a local test) gets a local folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"{purpose}-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
