"""One view of any source: what it is, and the snapshots and file systems that can be chosen in it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import nvlist, wire, zap
from tidelog.plans import nested, raw, verbs
from tidelog.sources import pool as pools
from tidelog.sources import stream
from tidelog.sources.images import ImageError

VIEW = "label string, selector string, view_kind string, guid long, update_eligible boolean, encrypted boolean, key_format string"


class UnknownSource(ValueError):
    """A source that no reader opens; the message has each reader's reason."""


class Opened(NamedTuple):
    kind: str
    source: object
    views: DataFrame
    diagnostics: list[str]


def stream_views(spark: SparkSession, path: str) -> DataFrame:
    """VIEW rows of a stream's snapshots; the key format comes by the snapshot's guid."""
    recs = verbs.indexed(spark, path)
    snaps = stream.snapshots(recs)
    need = raw.requirements(spark, path)
    kind = F.concat(wire.full_or_incremental(F.col("from_guid")), F.when(F.col("raw"), " raw").otherwise(" plain"))
    both = snaps.join(F.broadcast(need), "to_guid", "left")  # a row per snapshot
    return both.select(F.concat("name", F.lit(" ("), kind, F.lit(")")).alias("label"), "name", F.col("name").alias("selector"), F.lit("snapshot").alias("view_kind"), F.col("to_guid").alias("guid"), F.lit(True).alias("update_eligible"), F.col("raw").alias("encrypted"), "key_format").drop("name")


def pool_views(spark: SparkSession, pool: pools.Pool) -> DataFrame:
    """VIEW rows of a pool: its snapshots, then the heads of its data sets, which no delta applies to."""
    sets, shots = pools.catalog(spark, pool)
    need = sets.select("dataset", "encrypted")
    snapshots = shots.join(need, "dataset", "left").select(F.col("full_name").alias("label"), F.col("full_name").alias("selector"), F.lit("snapshot").alias("view_kind"), "guid", F.lit(True).alias("update_eligible"), "encrypted")
    heads = sets.select(F.concat("dataset", F.lit(" (now)")).alias("label"), F.col("dataset").alias("selector"), F.lit("head").alias("view_kind"), "guid", F.lit(False).alias("update_eligible"), "encrypted")
    return snapshots.unionByName(heads).withColumn("key_format", F.lit(None).cast("string"))


def opened(spark: SparkSession, path: str) -> Opened:
    """Tries the readers one after another: a stream, a pool, a disk image. The first that opens is taken."""
    why = []
    for kind in ("stream", "pool", "image"):
        try:
            if kind == "stream":
                names = stream.listed(spark, path)
                with stream.opened(names[0][0]) as f:
                    head = f.read(wire.RECORD)
                if len(head) < wire.RECORD or wire.decoded(head)[0] != "BEGIN" or wire.decoded(head)[1]["magic"] != wire.MAGIC:
                    raise wire.StreamError("no stream header")
                return Opened(kind, path, stream_views(spark, path), why)
            if kind == "pool":
                pool = pools.opened(spark, path)
                return Opened(kind, pool, pool_views(spark, pool), why)
            session = nested.of_file(spark, path)
            if not any(v["filesystem"] for v in session.volumes):
                raise ImageError("; ".join(v["diagnostic"] or "no known file system" for v in session.volumes))
            rows = [(f"{v['scheme']}{v['partition'] or ''}", v["filesystem"], v["name"]) for v in session.volumes]
            views = spark.createDataFrame(rows, "selector string, filesystem string, name string")
            shown = F.concat_ws(": ", "selector", F.coalesce("filesystem", F.lit("unknown")), F.when(F.col("name") != "", F.col("name")))
            none = F.lit(None)
            return Opened(kind, session, views.select(shown.alias("label"), "selector", F.lit("volume").alias("view_kind"), none.cast("long").alias("guid"), F.lit(False).alias("update_eligible"), F.lit(False).alias("encrypted"), none.cast("string").alias("key_format")), why)
        except (wire.StreamError, ImageError, nvlist.NvError, zap.TableError, OSError, ValueError) as e:
            why.append(f"{kind}: {e}")
    raise UnknownSource("; ".join(why))


# Credentials.

CREDENTIAL = "source string, view string, key binary, added long"


def credential(credentials: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, view) with the key that was added last of those that fit; a null source or view fits any."""
    c = credentials.select(F.col("source").alias("c_source"), F.col("view").alias("c_view"), "key", "added")
    fits = (F.col("c_source").isNull() | (F.col("c_source") == F.col("source"))) & (F.col("c_view").isNull() | (F.col("c_view") == F.col("view")))
    both = wanted.join(F.broadcast(c), fits, "left")  # what one person has typed in
    w = Window.partitionBy("source", "view").orderBy(F.desc_nulls_last("added"))
    return both.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("source", "view", "key")


def upserted(credentials: DataFrame, new: DataFrame) -> DataFrame:
    """Credentials with new ones in the place of those for the same source and view."""
    w = Window.partitionBy("source", "view").orderBy(F.desc("added"))
    return credentials.unionByName(new).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def byte_count(said: str) -> int:
    """A number of bytes in decimal or 0x-hexadecimal digits, with spaces around it and _ within it; no units."""
    digits = said.strip().replace("_", "")
    try:
        return int(digits, 16) if digits[:2].lower() == "0x" else int(digits, 10)
    except ValueError:
        raise ValueError(f"no number of bytes: {said!r}") from None


def settings(told: dict, defaults: dict) -> dict:
    """Settings with a default for each one that is missing; those that are not known are left out."""
    return {k: told.get(k, v) for k, v in defaults.items()}


def tsv(rows: Iterable, columns: list[str]) -> str:
    """Rows as lines of tab-separated fields; a null is a dash."""
    return "\n".join("\t".join("-" if r[c] is None else str(r[c]) for c in columns) for r in rows)
