"""Small files and folders, through Spark's own file systems."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

_claims = threading.Lock()


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def find_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob matches, in lexicographic order."""
    at, fs = _fs(spark, pattern)
    return sorted(str(f.getPath()) for f in fs.globStatus(at) or [])


def modified(spark: SparkSession, path: str) -> float:
    """When a file was written, in seconds since 1970."""
    at, fs = _fs(spark, path)
    return fs.getFileStatus(at).getModificationTime() / 1000


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder goes, where it is there."""
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole; where there is one of that name, it goes just before."""
    at, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")  # hidden from readers of the folder
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(part, at)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of that name; whether it was written. Of several writers one wins."""
    at, fs = _fs(spark, path)
    with _claims:  # where a file system only looks before it creates, writers of this driver still take turns
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    at, fs = _fs(spark, path)
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(at) else None
