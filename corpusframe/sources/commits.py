"""Commit logs: what a folder holds is told by the names of empty files, each made in one step.

Data are written under a new version name, then the version is committed; a job that dies before has changed
nothing a reader sees. Names begin with a running number; of two writers that take the same number both stay.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

LOG = "_commits"
_NAME = re.compile(r"(\d{10})-(.+)")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions, oldest first."""
    at, fs = _at(spark, f"{folder}/{LOG}")
    if not fs.exists(at):
        return []
    names = sorted(m.groups() for s in fs.listStatus(at) if (m := _NAME.fullmatch(s.getPath().getName())))
    return [version for _, version in names]


def commit(spark: SparkSession, folder: str, version: str) -> None:
    at, fs = _at(spark, f"{folder}/{LOG}")
    last = max((int(m[1]) for s in fs.listStatus(at) if (m := _NAME.fullmatch(s.getPath().getName()))), default=0) if fs.exists(at) else 0
    fs.create(_at(spark, f"{folder}/{LOG}/{last + 1:010d}-{version}")[0], False).close()


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []
