"""Disk images and the file systems in them: as files, as files of a snapshot, or as files of another image's volume.

The driver reads tables and directories; the bytes of files are read by tasks, each its own extents through the same
stack of sources, and written in place.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators import lineage
from tidelog.plans import filesystem as snapshots
from tidelog.plans import verbs
from tidelog.sources import partitions, sink, volumes
from tidelog.sources.images import Extent, Image, ImageError, Replayed, Segment, Source, container
from tidelog.sources.ranges import listed
from tidelog.sources.volumes import DIRECTORY, FILE, Node

#: Bytes that a task reads at once, segments that a replayed image may have, and images within one another.
CHUNK, MOST_SEGMENTS, MOST_LAYERS = 4 << 20, 4 << 20, 8
#: Bytes of a file that may be read whole.
SMALL = 4 << 20
# Endings of files that are likely images.
IMAGES = ("img", "raw", "dd", "qcow", "qcow2", "vmdk", "detto", "datto", "vhd", "vhdx", "iso")

ENTRY = "name string, object long, kind int, letter string, size long, pos int"


class Session(NamedTuple):
    """An opened image: its container's kind, the disk in it, the disk's volumes, and the images that it lies in."""

    spark: SparkSession
    kind: str
    disk: Source
    volumes: list[dict]
    layers: tuple = ()

    def volume(self, selector: str | None = None) -> Source:
        v = partitions.selected(self.volumes, selector)
        return self.disk.window(v["offset"], v["length"])

    def fs(self, selector: str | None = None) -> volumes.FileSystem:
        v = partitions.selected(self.volumes, selector)
        if not v["filesystem"]:
            raise volumes.VolumeError(v["diagnostic"] or "no known file system")
        return volumes.opened(self.volume(selector), v["filesystem"])


def of_source(spark: SparkSession, source: Source, start: int = 0, length: int | None = None, layers: tuple = ()) -> Session:
    """A session on a window of a source."""
    if len(layers) > MOST_LAYERS:
        raise ImageError(f"more than {MOST_LAYERS} images within one another")
    kind, disk = container(source.window(start, source.size - start if length is None else length))
    names = [c.split(" ")[0] for c in partitions.VOLUME.split(", ")][1:]
    return Session(spark, kind, disk, [dict(zip(names, v, strict=True)) for v in partitions.volumes_of(disk)], layers)


def of_file(spark: SparkSession, path: str, start: int = 0, length: int | None = None) -> Session:
    ((name, size),) = listed(spark, path)
    return of_source(spark, Image(name, size), start, length, (path,))


def replayed(snap: snapshots.Snapshot, inside: str) -> Replayed:
    """A file of a snapshot as a source; its map of segments, MOST_SEGMENTS at most, is held by the driver and tasks."""
    at = snapshots.resolve(snap, inside)
    if at.kind != snapshots.FILE:
        raise snapshots.PathError(f"{at.path} is no file")
    if snap.pieces is not snapshots.plain_pieces:
        raise ImageError("an image in an encrypted snapshot: extract it first")
    life = snap.life.where(F.col("object") == at.object_id)
    found = verbs.segments_of(life).select("lo", "hi", "begins", "path", "at", "payload_length", "how", "codec", "etype", "logical", "packed", "window").where(F.col("lo") < at.size)
    if found.limit(MOST_SEGMENTS + 1).count() > MOST_SEGMENTS:
        raise ImageError(f"more than {MOST_SEGMENTS} segments")
    whole = found.withColumn("hi", F.least("hi", F.lit(at.size))).mapInPandas(_with_sums, "lo long, hi long, begins long, path string, at long, payload_length long, how string, codec long, etype long, logical long, packed long, window long, crc long")
    return Replayed(at.size, [Segment(*r) for r in whole.collect()])


def _with_sums(batches):
    import zlib

    from tidelog.functions import wire
    from tidelog.sources.ranges import opened

    for pdf in batches:
        sums = []
        for r in pdf.itertuples(index=False):
            with opened(r.path) as f:
                f.seek(r.at + wire.RECORD)
                sums.append(zlib.crc32(f.read(r.payload_length)))
        out = pdf.assign(crc=sums)
        yield out.astype({c: "Int64" for c in ("codec", "etype", "logical", "packed", "window")})


def of_snapshot(spark: SparkSession, path: str, inside: str, snapshot: str | None = None, verify: bool = True, start: int = 0, length: int | None = None) -> Session:
    """A session on an image that is a file of a stream's snapshot."""
    return of_source(spark, replayed(snapshots.opened(spark, path, snapshot, verify), inside), start, length, (path, inside))


def child(session: Session, inside: str, selector: str | None = None) -> Session:
    """A session on an image that is a file of a session's volume."""
    fs = session.fs(selector)
    node, extents = fs.file(inside)
    return of_source(session.spark, volumes.FileBytes(fs.source, node.size, extents), layers=(*session.layers, inside))


def list_directory(session: Session, path: str, selector: str | None = None) -> DataFrame:
    """ENTRY rows of a directory, in the file system's own order (pos). Sizes are those of regular files."""
    found = session.fs(selector).listed(path)
    letter = {DIRECTORY: "d", FILE: "f", volumes.LINK: "l"}
    rows = [(n.name, n.number, n.kind, letter.get(n.kind, "?"), n.size if n.kind == FILE else None, k) for k, n in enumerate(found)]
    return session.spark.createDataFrame(rows, ENTRY)


def pieces_of(spark: SparkSession, source: Source, files: list[tuple[str, int, list[Extent]]]) -> DataFrame:
    """(file, lo, data) of files (name, size, extents): every task reads its own parts from the volume's source."""
    parts = []
    for name, size, extents in files:
        for e in extents:
            end = min(e.lo + e.length, size)
            if e.data is None and e.at < 0:
                continue
            for lo in range(e.lo, end, CHUNK):
                n = min(CHUNK, end - lo)
                parts.append((name, lo, -1 if e.data is not None else e.at + lo - e.lo, n, None if e.data is None else e.data[lo - e.lo : lo - e.lo + n]))
    table = spark.createDataFrame(parts, "file string, lo long, at long, n long, data binary")

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame({"file": [r.file], "lo": [r.lo], "data": [r.data if r.at < 0 else source.read(r.at, r.n)]})

    return table.repartition(max(1, min(len(parts), 10_000))).mapInPandas(read, "file string, lo long, data binary")


def extract(session: Session, path: str, target: str, selector: str | None = None, overwrite: bool = True) -> str:
    """Extracts a regular file; its SHA-256."""
    fs = session.fs(selector)
    node, extents = fs.file(path)
    pieces = pieces_of(session.spark, fs.source, [("file", node.size, extents)])
    return sink.publish(pieces.drop("file"), target, node.size, overwrite)


def extract_tree(session: Session, path: str, target: str, selector: str | None = None, overwrite: bool = False) -> snapshots.Totals:
    """Extracts all regular files below a directory, and publishes the tree in one step. Which volume is meant, and that
    all names are safe, is settled before anything is written."""
    fs = session.fs(selector)
    top = fs.resolve(path)
    if top.kind != DIRECTORY:
        raise volumes.VolumeError(f"{path} is no directory")
    stack: list[tuple[Node, str, int]] = [(top, "", 0)]
    files, folders, skipped, seen = [], [], 0, 0
    while stack:
        node, at, depth = stack.pop()
        if depth > lineage.TREE_DEPTH:
            raise lineage.TreeTooLarge(f"more than {lineage.TREE_DEPTH} levels below {path}")
        for n in fs.entries(node):
            seen += 1
            if seen > lineage.TREE_ENTRIES:
                raise lineage.TreeTooLarge(f"more than {lineage.TREE_ENTRIES} entries below {path}")
            if not text.is_safe(n.name):
                raise volumes.VolumeError(f"a name that cannot be written: {n.name!r}")
            name = f"{at}{n.name}"
            if n.kind == DIRECTORY:
                folders.append(name)
                stack.append((n, name + "/", depth + 1))
            elif n.kind == FILE:
                files.append((name, *fs.sized(n)))
            else:
                skipped += 1
    sink.publish_tree(pieces_of(session.spark, fs.source, files), [(n, s) for n, s, _ in files], folders, target, overwrite)
    return snapshots.Totals(len(files), 1 + len(folders), sum(s for _, s, _ in files), skipped)


def small_file(session: Session, path: str, selector: str | None = None, most: int = SMALL) -> bytes:
    """The bytes of a file that is no larger than allowed."""
    fs = session.fs(selector)
    node, extents = fs.file(path)
    if node.size > most:
        raise volumes.VolumeError(f"{path} has {node.size} bytes")
    return volumes.FileBytes(fs.source, node.size, extents).read(0, node.size)


def likely_image(name: str) -> bool:
    """Whether a file's ending is that of an image."""
    return name.rpartition(".")[2].lower() in IMAGES and "." in name
