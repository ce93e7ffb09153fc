"""Sparse files written in place by many tasks, then published in one step.

The driver makes each file at its length, all holes, in a staging place beside its target; tasks write their pieces
where they belong. A piece that is written again after a failure writes the same bytes to the same place. Only whole
results get the target's name. Target folders must be ones that all executors share.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are left as a hole if all are zero.
HOLE = 1 << 20


class SinkError(ValueError):
    """A file that was not written as it should be."""


def _written(top: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zeros = bytes(HOLE)
        for pdf in batches:
            done = 0
            for name, own in pdf.groupby("file", sort=False):
                handle = os.open(os.path.join(top, name), os.O_WRONLY)  # never made here: only the driver does
                try:
                    for lo, data in zip(own["lo"], own["data"], strict=True):
                        for at in range(0, len(data), HOLE):
                            part = bytes(data[at : at + HOLE])
                            if part != zeros[: len(part)]:
                                os.pwrite(handle, part, int(lo) + at)
                                done += len(part)
                    os.fsync(handle)
                finally:
                    os.close(handle)
            yield pd.DataFrame({"bytes": [done]})

    return work


def fill(pieces: DataFrame, top: str) -> int:
    """Writes pieces (file, lo, data) into files that stand under a folder; bytes that are no holes."""
    return pieces.select("file", "lo", "data").mapInPandas(_written(top), "bytes long").agg(F.sum("bytes")).first()[0] or 0


def make(path: str, size: int) -> None:
    with open(path, "xb") as f:
        f.truncate(size)


def digest_of(path: str) -> str:
    """SHA-256 of a file, holes as zeros."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def publish(pieces: DataFrame, target: str, size: int, overwrite: bool = True) -> str:
    """Writes pieces (lo, data) as a sparse file of a size that takes the target's name in one step; its SHA-256."""
    target = os.path.abspath(target)
    if not overwrite and os.path.lexists(target):
        raise FileExistsError(target)
    staging = tempfile.mkdtemp(prefix=".tidelog-", dir=os.path.dirname(target))
    try:
        made = os.path.join(staging, "file")
        make(made, size)
        cut = pieces.where(F.col("lo") < size).select(F.lit("file").alias("file"), "lo", F.expr(f"substring(data, 1, cast(least(length(data), {size} - lo) as int))").alias("data"))
        fill(cut, staging)
        if os.path.getsize(made) != size:
            raise SinkError(f"{target}: {os.path.getsize(made)} bytes, not {size}")
        sha = digest_of(made)
        with open(made, "rb") as f:
            os.fsync(f.fileno())
        os.replace(made, target)
        return sha
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def publish_tree(pieces: DataFrame, files: list[tuple[str, int]], folders: list[str], target: str, overwrite: bool = False) -> None:
    """Writes a tree in one step: folders and files (paths below the target, with sizes), and pieces (file, lo, data).

    A target that is there already is put aside first, and put back if the new one cannot take its place.
    """
    target = os.path.abspath(target)
    if os.path.lexists(target) and not overwrite:
        raise FileExistsError(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    staging = tempfile.mkdtemp(prefix=".tidelog-", dir=os.path.dirname(target))
    try:
        top, previous = os.path.join(staging, "new"), os.path.join(staging, "previous")
        os.mkdir(top)
        for name in sorted(folders):
            os.mkdir(os.path.join(top, name))
        for name, size in files:
            make(os.path.join(top, name), size)
        fill(pieces, top)
        for name, size in files:
            if os.path.getsize(os.path.join(top, name)) != size:
                raise SinkError(f"{name}: {os.path.getsize(os.path.join(top, name))} bytes, not {size}")
        if os.path.lexists(target):
            os.rename(target, previous)
        try:
            os.rename(top, target)
        except OSError:
            if os.path.lexists(previous):
                os.rename(previous, target)
            raise
    finally:
        shutil.rmtree(staging, ignore_errors=True)
