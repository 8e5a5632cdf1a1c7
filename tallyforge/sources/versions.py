"""Versions of a small state in a shared folder, through Spark's own file system layer: written beside, then renamed, newest last.

A version is there whole or not at all. Absence is a state of its own; any other failure to read is raised, never taken for absence.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

_NAME = re.compile(r"v(\d{12})\.json")


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbers(fs, path) -> list[int]:
    if not fs.exists(path):
        return []
    return sorted(int(m[1]) for f in fs.listStatus(path) if (m := _NAME.fullmatch(f.getPath().getName())))


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The newest version, or None if there is none yet."""
    jvm, fs, path = _fs(spark, folder)
    if not (n := _numbers(fs, path)):
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"v{n[-1]:012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, state: dict, keep: int = 2) -> None:
    """Adds a version; older ones but for `keep` are removed."""
    jvm, fs, path = _fs(spark, folder)
    n = _numbers(fs, path)
    fs.mkdirs(path)
    tmp, to = (jvm.org.apache.hadoop.fs.Path(path, x) for x in (f".{uuid.uuid4().hex}.tmp", f"v{(n[-1] if n else 0) + 1:012d}.json"))
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(json.dumps(state).encode("utf-8")))
    finally:
        stream.close()
    if not fs.rename(tmp, to):
        raise OSError(f"cannot publish {to.toString()}: another version came first")
    for old in n[: max(0, len(n) + 1 - keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"v{old:012d}.json"), False)


def remove(spark: SparkSession, folder: str) -> None:
    """A folder that no version names any more."""
    _, fs, path = _fs(spark, folder)
    fs.delete(path, True)


def size(spark: SparkSession, folder: str) -> int:
    """Bytes in a folder."""
    _, fs, path = _fs(spark, folder)
    return int(fs.getContentSummary(path).getLength())
