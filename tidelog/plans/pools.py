"""Files and trees of offline pools, by path."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import attributes, sealed, text
from tidelog.operators import lineage
from tidelog.plans import nested, verbs
from tidelog.plans.filesystem import Totals
from tidelog.sources import pool as pools
from tidelog.sources import sink
from tidelog.sources.images import Sectors
from tidelog.sources.pool import Pool, PoolError, PoolFile

ENTRY = "name string, object long, kind int, letter string, size long"


def list_directory(spark: SparkSession, pool: Pool, selector: str, path: str, key: bytes | None = None) -> DataFrame:
    """ENTRY rows of a directory of a data set or snapshot, by name."""
    rows = pool.listed(pool.view(selector, key), path)
    return spark.createDataFrame(rows, "name string, object long, kind int, size long").select("name", "object", "kind", text.dirent_letter(F.col("kind")).alias("letter"), "size").orderBy("name")


def extract(spark: SparkSession, pool: Pool, selector: str, path: str, target: str, overwrite: bool = True, key: bytes | None = None) -> str:
    """Extracts a regular file; its SHA-256. A snapshot's file gets the state that deltas are applied by; a file of a
    data set's head gets none, and loses what an earlier extraction left."""
    view = pool.view(selector, key)
    at = pool.file(view, path)
    sha = sink.publish(pools.pieces_of(spark, pool.source, at), target, at.size, overwrite)
    if view.guid is None:
        if os.path.lexists(f"{target}.state.json"):
            os.unlink(f"{target}.state.json")
    else:
        where = attributes.size_offset(at.record.bonus_type, at.record.bonus, view.known)
        verbs.save_state(target, at.object_id, at.size, view.guid, sha, path=at.path, bonus_type=at.record.bonus_type, size_bonus_offset=where)
    return sha


def extract_tree(spark: SparkSession, pool: Pool, selector: str, path: str, target: str, overwrite: bool = False, key: bytes | None = None) -> Totals:
    """Extracts all regular files below a directory, and publishes the tree in one step."""
    view = pool.view(selector, key)
    stack, files, folders, skipped, total = [(path, "", 0)], [], [], 0, 0
    while stack:
        at, below, depth = stack.pop()
        if depth > lineage.TREE_DEPTH:
            raise lineage.TreeTooLarge(f"more than {lineage.TREE_DEPTH} levels below {path}")
        for name, _, kind, _ in pool.listed(view, at):
            total += 1
            if total > lineage.TREE_ENTRIES:
                raise lineage.TreeTooLarge(f"more than {lineage.TREE_ENTRIES} entries below {path}")
            if not text.is_safe(name):
                raise PoolError(f"a name that cannot be written: {name!r}")
            if kind == 4:
                folders.append(below + name)
                stack.append((f"{at.rstrip('/')}/{name}", f"{below}{name}/", depth + 1))
            elif kind == 8:
                files.append((below + name, pool.file(view, f"{at.rstrip('/')}/{name}")))
            else:
                skipped += 1
    parts = spark.createDataFrame([], "file string, lo long, data binary")
    for name, found in files:
        if found.size:
            parts = parts.unionByName(pools.pieces_of(spark, pool.source, found).withColumn("file", F.lit(name)))
    sink.publish_tree(parts, [(n, f.size) for n, f in files], folders, target, overwrite)
    return Totals(len(files), 1 + len(folders), sum(f.size for _, f in files), skipped)


def session(spark: SparkSession, pool: Pool, selector: str, path: str, start: int = 0, length: int | None = None, key: bytes | None = None) -> nested.Session:
    """A session on an image that is a file of a pool."""
    return nested.of_source(spark, PoolFile(pool.source, pool.file(pool.view(selector, key), path)), start, length, (selector, path))


def sealed_session(spark: SparkSession, pool: Pool, selector: str, path: str, password: bytes, stash: str | None = None, key: bytes | None = None) -> nested.Session:
    """A session on an image whose sectors are sealed; its key stands in a stash in /config, or where it is said to."""
    view = pool.view(selector, key)
    where = stash or "/config/" + sealed.stash_in([(name, kind) for name, _, kind, _ in pool.listed(view, "/config")])
    secret = sealed.stashed_key(pool.small_file(selector, where, material=key), password)
    return nested.of_source(spark, Sectors(PoolFile(pool.source, pool.file(view, path)), secret), layers=(selector, path))
