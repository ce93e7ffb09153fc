"""Directories and files of a snapshot, by path.

A snapshot's objects and directory entries are two tables, made by one replay of the records that hold metadata: a row
per object with the place of its bonus, and a row per entry of every attribute table. Paths are walked by lookups in
the second, listings join both, and a tree is extracted in a single replay of all its files.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import attributes, text, wire, zap
from tidelog.operators import lineage
from tidelog.plans import verbs
from tidelog.session import Scratch
from tidelog.sources import sink, stream

#: Object that holds a file system's root, and its entries' names.
MASTER = 1
DIRECTORY, FILE, LINK = 4, 8, 10
#: Bytes of one object's attribute table, and rows of a registry, at most.
MOST_TABLE, MOST_ATTRIBUTES = 64 << 20, 65_536


class PathError(ValueError):
    """A path that a snapshot does not have, or that is not what was asked for."""


class KeyNeeded(ValueError):
    """A key that is missing, or one that nothing needs."""


Pieces = Callable[[DataFrame], DataFrame]


class Snapshot(NamedTuple):
    """A snapshot's tables: the live log of its chain, objects and entries; and its attribute registry."""

    spark: SparkSession
    scratch: Scratch
    guid: int
    life: DataFrame
    objects: DataFrame
    entries: DataFrame
    known: attributes.Registry
    pieces: Pieces


def plain_pieces(life: DataFrame) -> DataFrame:
    """(object, lo, data) of all bytes that a live log's objects show."""
    return verbs.read_segments(verbs.segments_of(life))


def opened(spark: SparkSession, path: str, snapshot: str | None = None, verify: bool = True, key: bytes | None = None) -> Snapshot:
    """A snapshot of a stream, ready to be listed and read; an encrypted one needs its key material."""
    if verify:
        verbs.inspect(spark, path)
    recs = verbs.indexed(spark, path)
    snaps = stream.snapshots(recs)
    target = verbs.selected(snaps, snapshot)
    chain = lineage.chain(snaps, target)
    if snaps.where(F.col("idx") == target).first()["raw"]:
        if key is None:
            raise KeyNeeded(f"{snapshot or path} is encrypted")
        from tidelog.plans import raw

        return raw.opened(spark, path, key, snapshot, verify=False)
    if key is not None:
        raise KeyNeeded("a key for what is not encrypted")
    scratch = Scratch(spark, "snapshot")
    life = scratch.save(verbs.live_log(verbs.log_of(recs, snaps, chain)), "life")
    objects = scratch.save(objects_of(life), "objects")
    entries = scratch.save(entries_of(life, objects), "entries")
    guid = chain.where("depth = 0").first()["to_guid"]
    return Snapshot(spark, scratch, guid, life, objects, entries, registry_of(entries), plain_pieces)


def objects_of(life: DataFrame) -> DataFrame:
    """One row per object: object, object_type, bonus_type, block_size, and the places of its bonus and of its spill."""
    place = F.struct("path", "at", "payload_length", "codec", "window")
    last = lambda what, kind: F.max_by(what, F.when(F.col("kind") == kind, F.col("seq")))
    told = [last(c, "OBJECT").alias(c) for c in ("object_type", "bonus_type", "block_size")]
    found = life.where("kind in ('OBJECT', 'SPILL')").groupBy("object").agg(*told, last(place, "OBJECT").alias("bonus"), last(place, "SPILL").alias("spill"))
    return found.where("object_type is not null")


def entries_of(life: DataFrame, objects: DataFrame, read: Pieces = plain_pieces) -> DataFrame:
    """(object, name, width, numbers): every entry of every attribute table. A table that breaks the format, or is
    larger than one may be, is an error."""
    tables = objects.where(F.col("object_type").isin(*wire.METADATA_TYPES)).select("object", F.col("block_size").alias("block"))
    pieces = read(life.join(tables, "object", "left_semi")).join(tables, "object")

    def parsed(pdf: pd.DataFrame) -> pd.DataFrame:
        end = max(lo + len(d) for lo, d in zip(pdf["lo"], pdf["data"], strict=True))
        if end > MOST_TABLE:
            raise zap.TableError(f"object {pdf['object'].iloc[0]}: a table of {end} bytes")
        whole = bytearray(end)
        for lo, d in zip(pdf["lo"], pdf["data"], strict=True):
            whole[lo : lo + len(d)] = d
        rows = [(pdf["object"].iloc[0], name, width, [wire.signed(n) for n in numbers]) for name, width, numbers in zap.parsed(bytes(whole), int(pdf["block"].iloc[0] or 0))]
        return pd.DataFrame(rows, columns=["object", "name", "width", "numbers"])

    return pieces.groupBy("object").applyInPandas(parsed, "object long, name string, width int, numbers array<long>")


def _rows(entries: DataFrame, object_id: int) -> list:
    found = entries.where(F.col("object") == object_id).select("name", "numbers").limit(MOST_ATTRIBUTES + 1).collect()
    if len(found) > MOST_ATTRIBUTES:
        raise PathError(f"object {object_id} has more than {MOST_ATTRIBUTES} entries")
    return found


def registry_of(entries: DataFrame) -> attributes.Registry:
    """The registry and layouts that the master object leads to; empty where it names none (the older, fixed form)."""
    lookup = lambda object_id, name: next((r["numbers"][0] for r in entries.where((F.col("object") == object_id) & (F.col("name") == name)).select("numbers").limit(1).collect()), None)
    top = lookup(MASTER, "SA_ATTRS")
    if top is None:
        return attributes.Registry({}, {})
    names, layouts = lookup(top, "REGISTRY"), lookup(top, "LAYOUTS")
    if names is None or layouts is None:
        raise PathError("the attribute master has no registry or no layouts")
    return attributes.registry([(r["name"], r["numbers"][0]) for r in _rows(entries, names)], [(r["name"], r["numbers"]) for r in _rows(entries, layouts)])


ATTRIBUTES = "object long, " + ", ".join(f"{n} long" for n in attributes.SHOWN) + ", size_bonus_offset long, size_spill_offset long"


def attributes_of(snap: Snapshot, objects: DataFrame) -> DataFrame:
    """ATTRIBUTES of some rows of the snapshot's objects; those whose bonus holds none come back with nulls."""
    known = snap.known
    columns = [c.split(" ")[0] for c in ATTRIBUTES.split(", ")]

    def row(number: int, bonus_type: int, bonus: bytes, spill: bytes | None) -> tuple:
        got = attributes.decoded(bonus_type, bonus, spill, known) or {}
        at = attributes.size_offset(bonus_type, bonus, known)
        beyond = attributes.size_offset(attributes.LAID_OUT, spill, known) if bonus_type == attributes.LAID_OUT else None
        return number, *[None if got.get(n) is None else wire.signed(got[n]) for n in attributes.SHOWN], at, beyond

    def typed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns})

    if "plain" in objects.columns:

        def at_hand(batches):
            for pdf in batches:
                yield typed([row(r.object, int(r.bonus_type), bytes(r.plain), None if r.spill_data is None else bytes(r.spill_data)) for r in pdf.itertuples(index=False)])

        return objects.select("object", "bonus_type", "plain", "spill_data").mapInPandas(at_hand, ATTRIBUTES)

    def work(batches):
        for pdf in batches:
            out = []
            for path, own in pdf.groupby("path", sort=False):
                with stream.opened(path) as f:
                    for r in own.sort_values("at").itertuples(index=False):
                        f.seek(r.at + wire.RECORD)
                        bonus = f.read(r.payload_length)
                        spill = None
                        if r.s_path is not None:
                            place = _Place(int(r.s_at), int(r.s_payload_length), int(r.s_codec), int(r.s_window))
                            with stream.opened(r.s_path) as g:
                                spill = verbs.body_of(g, place)
                        out.append(row(r.object, int(r.bonus_type), bonus, spill))
            yield typed(out)

    spill = [F.col(f"spill.{c}").alias(f"s_{c}") for c in ("path", "at", "payload_length", "codec", "window")]
    return objects.select("object", "bonus_type", "bonus.path", "bonus.at", "bonus.payload_length", *spill).mapInPandas(work, ATTRIBUTES)


class _Place(NamedTuple):
    at: int
    payload_length: int
    codec: int
    window: int
    how: str = "SPILL"


class Resolved(NamedTuple):
    path: str
    object_id: int
    kind: int
    object_type: int
    bonus_type: int
    size: int
    size_bonus_offset: int | None
    size_spill_offset: int | None


def resolve(snap: Snapshot, path: str) -> Resolved:
    """What a path names: one lookup per component from the root that the master object names."""
    parts = text.outer_parts(path)
    current, kind = None, DIRECTORY
    for name in ("ROOT", *parts):
        found = snap.entries.where((F.col("object") == (MASTER if current is None else current)) & (F.col("name") == name)).select("numbers").limit(1).collect()
        if not found:
            raise PathError(f"no {path} in the snapshot" if current is not None else "the snapshot has no root")
        word = found[0]["numbers"][0] & wire._MASK
        kind = kind if current is None else word >> 60
        current = word & (1 << 48) - 1
    row = snap.objects.where(F.col("object") == current)
    told = row.first()
    if told is None:
        raise PathError(f"object {current} of {path} has no record")
    got = attributes_of(snap, row).first()
    if got["size"] is None:
        raise PathError(f"the attributes of {path} cannot be read")
    return Resolved("/" + "/".join(parts), current, kind, told["object_type"], told["bonus_type"], got["size"], got["size_bonus_offset"], got["size_spill_offset"])


def _named(entries: DataFrame) -> DataFrame:
    word = F.get("numbers", F.lit(0))
    return entries.where("width = 8 and size(numbers) = 1").select("object", "name", text.dirent_object(word).alias("child"), text.dirent_type(word).cast("int").alias("kind"))


def listed(snap: Snapshot, path: str) -> DataFrame:
    """(name, object, kind, letter, size) of a directory, by name; size is null where attributes cannot be read."""
    at = resolve(snap, path)
    if at.kind != DIRECTORY:
        raise PathError(f"{at.path} is no directory")
    here = _named(snap.entries.where(F.col("object") == at.object_id)).select("name", F.col("child").alias("object"), "kind")
    sizes = attributes_of(snap, snap.objects.join(here.select("object").distinct(), "object", "left_semi")).select("object", "size")
    letter: Column = text.dirent_letter(F.col("kind")).alias("letter")
    return here.join(sizes, "object", "left").select("name", "object", "kind", letter, "size").orderBy("name")


def walked(snap: Snapshot, path: str) -> DataFrame:
    """(path, object, kind, size, depth) of everything below a directory, in one walk of all levels."""
    at = resolve(snap, path)
    if at.kind != DIRECTORY:
        raise PathError(f"{at.path} is no directory")
    edges = snap.scratch.save(_named(snap.entries.join(snap.objects.where("object_type = 20").select("object"), "object", "left_semi")), "edges")
    # a file of several names is a node once for each of them
    node = F.struct("object", "name", "child", "kind").alias("node")
    table = edges.select(node, F.col("object").alias("parent"), "name")
    below = _descended(snap, table, at.object_id)
    sizes = attributes_of(snap, snap.objects.join(below.select("object").distinct(), "object", "left_semi")).select("object", "size")
    return below.join(sizes, "object", "left").select("path", "object", "kind", "size", "depth")


def _descended(snap: Snapshot, table: DataFrame, root: int) -> DataFrame:
    edges = table.select(F.col("node.child").alias("node"), "parent", F.concat_ws("\0", "name", F.col("node.kind").cast("string")).alias("name"))
    found = lineage.descent(edges.where(F.col("node") != F.lit(root)), "node", "parent", "name", root, entries=lineage.TREE_ENTRIES)
    kind = F.regexp_extract("path", "\0([0-9]+)$", 1).cast("int")
    return found.select(F.regexp_replace("path", "\0[0-9]+", "").alias("path"), F.col("node").alias("object"), kind.alias("kind"), "depth")


def extract(spark: SparkSession, path: str, inside: str, target: str, snapshot: str | None = None, verify: bool = True, overwrite: bool = True, key: bytes | None = None) -> str:
    """Extracts a file by its path, with the state that deltas are applied by; its SHA-256."""
    snap = opened(spark, path, snapshot, verify, key)
    at = resolve(snap, inside)
    if at.kind != FILE:
        raise PathError(f"{at.path} is no file")
    pieces = snap.pieces(snap.life.where(F.col("object") == at.object_id))
    sha = sink.publish(pieces, target, at.size, overwrite)
    verbs.save_state(target, at.object_id, at.size, snap.guid, sha, path=at.path, bonus_type=at.bonus_type, size_bonus_offset=at.size_bonus_offset, size_spill_offset=at.size_spill_offset)
    return sha


class Totals(NamedTuple):
    """What a tree holds; its own root counts as a directory."""

    files: int
    directories: int
    bytes: int
    skipped: int


def extract_tree(spark: SparkSession, path: str, inside: str, target: str, snapshot: str | None = None, verify: bool = True, overwrite: bool = False, key: bytes | None = None) -> Totals:
    """Extracts all files below a directory in one replay, and publishes the tree in one step.

    Links and other entries are skipped and counted. Names that are not safe everywhere are an error before anything
    is written. The tree's entries are lineage.TREE_ENTRIES at most, and the driver holds their names and sizes.
    """
    snap = opened(spark, path, snapshot, verify, key)
    below = snap.scratch.save(walked(snap, inside), "below")
    bad = below.where(~text.safe_component(F.substring_index("path", "/", -1))).select("path").limit(1).collect()
    if bad:
        raise PathError(f"a name that cannot be written: {bad[0]['path']!r}")
    known = below.where(f"kind = {FILE}")
    if known.where("size is null").limit(1).count():
        raise PathError("a file whose attributes cannot be read")
    k = F.col("kind")
    row = below.agg(F.count(F.when(k == FILE, 1)).alias("files"), (1 + F.count(F.when(k == DIRECTORY, 1))).alias("directories"), F.coalesce(F.sum(F.when(k == FILE, F.col("size"))), F.lit(0)).alias("bytes"), F.count(F.when(~k.isin(FILE, DIRECTORY), 1)).alias("skipped")).first()
    files = [(r["path"].lstrip("/"), r["size"]) for r in known.select("path", "size").collect()]
    folders = [r["path"].lstrip("/") for r in below.where(f"kind = {DIRECTORY}").select("path").collect()]
    wanted = known.select("object", F.expr("substring(path, 2)").alias("file"), "size")
    pieces = snap.pieces(snap.life.join(wanted, "object", "left_semi")).join(wanted, "object").where("lo < size")
    cut = pieces.select("file", "lo", F.expr("substring(data, 1, cast(least(length(data), size - lo) as int))").alias("data"))
    sink.publish_tree(cut, files, folders, os.path.abspath(target), overwrite)
    return Totals(*row)
