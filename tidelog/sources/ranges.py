"""Positioned reads from any store that a worker can open."""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import SparkSession


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and bytes of each file under a path or glob, in the order of their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(p) or []:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(x.getPath().toString(), x.getLen()) for x in inner if x.isFile()]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def opened(path: str) -> BinaryIO:
    """A seekable file."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)
