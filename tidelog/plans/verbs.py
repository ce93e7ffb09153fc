"""What can be asked of a change stream: inspect, snapshots, extract, apply."""

from __future__ import annotations

import json
import os
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codecs, wire
from tidelog.operators import lineage, replay
from tidelog.session import Scratch
from tidelog.sources import sink, stream
from tidelog.sources.sink import publish


def indexed(spark: SparkSession, path: str, objects: list[int] | None = None) -> DataFrame:
    """The stream's records without payloads, read and decoded once and written as a table; of one object's records
    only those of some objects, if these are given."""
    return Scratch(spark, "stream").save(stream.records(spark, path, objects=objects), "records")


class Inspection(NamedTuple):
    records: dict[str, int]
    stream_bytes: int
    snapshots: list[dict]


def inspect(spark: SparkSession, path: str, verify: bool = True) -> Inspection:
    """Counts by kind, length and snapshots of a stream. With verify, a checksum that does not hold is an error."""
    if verify:
        bad = stream.verified(spark, path).where("not ok").orderBy("path", "seq").limit(1).collect()
        if bad:
            raise wire.StreamError(f"checksum of record {bad[0]['seq']} ({bad[0]['kind']}) in {bad[0]['path']}")
    index = indexed(spark, path)
    counts = {r["kind"]: r["n"] for r in index.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = index.groupBy("path").agg(F.max(F.col("at") + wire.RECORD + F.col("payload_length")).alias("end"))
    size = ends.agg(F.sum("end")).first()[0]
    shown = [r.asDict() for r in stream.snapshots(index).orderBy("idx").collect()]
    return Inspection(dict(sorted(counts.items())), size, shown)


def selected(snaps: DataFrame, selector: str | None) -> int:
    """The idx of the snapshot that a selector names; without one there must be exactly one."""
    if selector is None:
        rows = snaps.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("name a snapshot: the stream has none or several")
        return rows[0]["idx"]
    wanted = snaps.sparkSession.createDataFrame([(selector,)], "selector string")
    row = lineage.selected(snaps, wanted).first()
    if row["idx"] is None:
        raise ValueError(f"no single snapshot is named {selector}")
    return row["idx"]


class Unsupported(ValueError):
    """A stream whose records cannot be replayed from the stream alone."""


def refuse(recs: DataFrame, ranges: bool = False) -> None:
    """Raises Unsupported for records that other data must be at hand for, or that were cut out; and, unless ranges are
    dealt with, for those of encrypted streams."""
    kinds = ("WRITE_BYREF", "REDACT") if ranges else ("WRITE_BYREF", "REDACT", "OBJECT_RANGE")
    found = recs.where(F.col("kind").isin(*kinds)).select("kind", "path", "at").limit(1).collect()
    if found:
        raise Unsupported(f"{found[0]['kind']} record at {found[0]['at']} of {found[0]['path']}")


def log_of(recs: DataFrame, snaps: DataFrame, chain: DataFrame) -> DataFrame:
    """The replay log of a chain of snapshots: seq, object, kind, lo, hi (null to the end), and the records' places.

    Records count if their substream's guid is in the chain. seq orders all files' records in the order of their names.
    """
    plan = chain.select("to_guid").join(snaps, "to_guid").select("path", "substream", F.col("idx").alias("order"))
    rows = recs.join(F.broadcast(plan), ["path", "substream"])  # a row per snapshot, lineage.DEEPEST at most
    refuse(rows)
    seq = F.col("order") * F.lit(1 << 40) + F.col("seq")
    length = F.when(F.col("kind") == "WRITE_EMBEDDED", F.least("length", "logical")).otherwise(F.col("length"))
    base = ["path", "at", "payload_length", "codec", "etype", "packed", "logical", F.col("length").alias("window"), "object_type", "bonus_type", "block_size", "count"]
    told = rows.where(F.col("kind").isin("OBJECT", "WRITE", "WRITE_EMBEDDED", "SPILL", "FREE", "FREEOBJECTS"))
    return told.select(seq.alias("seq"), "object", "kind", F.col("offset").alias("lo"), (F.col("offset") + length).alias("hi"), *base)


def live_log(log: DataFrame) -> DataFrame:
    """Rows of every object that are behind its last free or change of type."""
    frees = log.where("kind = 'FREEOBJECTS'").select("seq", F.col("object").alias("first_object"), "count")
    if frees.limit(1).count() == 0:
        return replay.live(log, "object_type")
    return replay.live(replay.expanded_frees(log.where("kind <> 'FREEOBJECTS'"), frees), "object_type")


def covers(object_id: int):
    """Whether a row's range of objects holds one."""
    return (F.col("object") <= object_id) & ((F.lit(object_id) - F.col("object")) < F.col("count"))


def segments_of(life: DataFrame) -> DataFrame:
    """Segments of a live log's objects, with the places of their payloads. An embedded write clears its whole window
    before it shows."""
    double = lambda c: (F.col(c) * 2).alias(c)
    writes = life.where("kind in ('WRITE', 'WRITE_EMBEDDED')").select("object", (F.col("seq") * 2 + 1).alias("seq"), F.lit("WRITE").alias("kind"), "lo", "hi")
    frees = life.where("kind = 'FREE'").select("object", double("seq"), "kind", "lo", "hi")
    cleared = life.where("kind = 'WRITE_EMBEDDED'").select("object", double("seq"), F.lit("FREE").alias("kind"), "lo", (F.col("lo") + F.col("window")).alias("hi"))
    segs = replay.segments(writes.union(frees).union(cleared))
    places = life.where("kind in ('WRITE', 'WRITE_EMBEDDED')").select("seq", F.col("kind").alias("how"), "path", "at", "payload_length", "codec", "etype", "packed", "logical", "window")
    return segs.withColumn("seq", F.expr("(seq - 1) div 2")).join(places, "seq").select("object", "lo", "hi", "seq", "begins", *places.columns[1:])


def object_segments(log: DataFrame, object_id: int) -> DataFrame:
    """Segments of one object at the end of a log."""
    mine = log.where(F.when(F.col("kind") == "FREEOBJECTS", covers(object_id)).otherwise(F.col("object") == object_id)).withColumn("object", F.lit(object_id).cast("long"))
    return segments_of(replay.live(mine, "object_type"))


def body_of(f, r) -> bytes:
    """A write's or spill's payload as plain bytes, from the opened stream."""
    f.seek(r.at + wire.RECORD)
    body = f.read(r.payload_length)
    if r.how == "WRITE_EMBEDDED":
        return codecs.decode_embedded(int(r.etype), int(r.codec), body, int(r.logical), int(r.packed))
    return codecs.decode(codecs.name_of(int(r.codec), replay=True), body, int(r.window))


def read_segments(segs: DataFrame) -> DataFrame:
    """(object, lo, data): the bytes that each segment shows; payloads are read and decoded where the rows are."""

    def read(batches):
        for pdf in batches:
            out, held = [], 0
            for path, own in pdf.groupby("path", sort=False):
                with stream.opened(path) as f:
                    last, data = None, b""
                    for r in own.sort_values(["at", "lo"]).itertuples(index=False):
                        if r.at != last:
                            data, last = body_of(f, r), r.at
                        out.append((r.object, r.lo, data[r.lo - r.begins : r.hi - r.begins]))
                        held += r.hi - r.lo
                        if held > 16 << 20:
                            yield pd.DataFrame(out, columns=["object", "lo", "data"])
                            out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["object", "lo", "data"])

    return segs.mapInPandas(read, "object long, lo long, data binary")


def extract(spark: SparkSession, path: str, object_id: int, size: int, snapshot: str | None = None, verify: bool = True) -> DataFrame:
    """(lo, data) rows of an object's bytes as of a snapshot, up to size; what no row covers is zero."""
    if verify:
        inspect(spark, path)
    recs = indexed(spark, path, [object_id])
    snaps = stream.snapshots(recs)
    chain = lineage.chain(snaps, selected(snaps, snapshot))
    data = read_segments(object_segments(log_of(recs, snaps, chain), object_id))
    return data.where(F.col("lo") < size).select("lo", F.expr(f"substring(data, 1, cast(least(length(data), {size} - lo) as int))").alias("data"))


class StateError(ValueError):
    """A stored state that a delta does not follow on."""


class State(NamedTuple):
    """What is stored beside an extracted file, so that deltas can be applied to it."""

    object_id: int
    logical_size: int
    snapshot_guid: str
    sha256: str
    path: str | None = None
    bonus_type: int | None = None
    size_bonus_offset: int | None = None
    size_spill_offset: int | None = None


def save_state(target: str, object_id: int, size: int, guid: int, sha256: str, **more) -> None:
    """Writes the state file in one step."""
    state = State(object_id, size, f"0x{guid & wire._MASK:016x}", sha256, **more)
    part = f"{target}.state.json.part"
    with open(part, "w") as f:
        json.dump({"format_version": 1, **state._asdict()}, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, f"{target}.state.json")


def load_state(target: str) -> State:
    with open(f"{target}.state.json") as f:
        state = json.load(f)
    if state.pop("format_version", None) != 1:
        raise StateError("a state of another version")
    if unknown := set(state) - set(State._fields):
        raise StateError(f"a state with unknown fields: {sorted(unknown)}")
    return State(**state)


def size_after(own: DataFrame, state: State) -> int:
    """The size that a delta's records of the object give it: of the last bonus or spill that holds the attribute."""
    if state.size_bonus_offset is None and state.size_spill_offset is None:
        return state.logical_size
    rows = own.where("kind in ('OBJECT', 'SPILL')").orderBy(F.desc("seq")).select(F.col("kind").alias("how"), "path", "at", "payload_length", "codec", "window", "etype", "logical", "packed").toLocalIterator()
    for r in rows:
        place = state.size_bonus_offset if r.how == "OBJECT" else state.size_spill_offset
        if place is None:
            continue
        with stream.opened(r.path) as f:
            if r.how == "OBJECT":
                f.seek(r.at + wire.RECORD)
                body = f.read(r.payload_length)
            else:
                body = body_of(f, r)
        if place + 8 > len(body):
            raise StateError(f"a {r.how} record whose size attribute is cut short")
        return int.from_bytes(body[place : place + 8], "little")
    return state.logical_size


def apply(spark: SparkSession, delta: str, target: str, size: int | None = None) -> str:
    """Brings an extracted file forward by one delta alone, in one step; the new SHA-256.

    The delta must hold one snapshot whose base is the stored state's, must change the file's object, and must not
    delete it or make it one of another type; the file must still have its stored length and digest. Without a size,
    the delta's own attributes give it. The file must be in a folder that executors share.
    """
    state = load_state(target)
    inspect(spark, delta)
    recs = indexed(spark, delta)
    snaps = stream.snapshots(recs)
    rows = snaps.limit(2).collect()
    if len(rows) != 1:
        raise StateError("a delta must hold one snapshot")
    if f"0x{rows[0]['from_guid'] & wire._MASK:016x}" != state.snapshot_guid:
        raise StateError("the delta's base is another snapshot")
    if os.path.getsize(target) != state.logical_size or sink.digest_of(target) != state.sha256:
        raise StateError("the file is not what the state says")
    log = log_of(recs, snaps, snaps)
    object_id = state.object_id
    if log.where("kind = 'FREEOBJECTS'").where(covers(object_id)).limit(1).count():
        raise StateError("the delta deletes or replaces the object: extract it anew")
    own = log.where((F.col("object") == object_id) & (F.col("kind") != "FREEOBJECTS"))
    if own.limit(1).count() == 0:
        raise StateError(f"the delta changes nothing of {state.path or object_id}")
    if state.bonus_type is not None and own.where("kind = 'OBJECT'").where(F.col("bonus_type") != state.bonus_type).limit(1).count():
        raise StateError("the delta changes the object's bonus type: extract it anew")
    size = size_after(own, state) if size is None else size
    was = state.logical_size
    base = f"file:{os.path.abspath(target)}"
    kept = spark.createDataFrame([(-1, object_id, "WRITE", 0, was)], "seq long, object long, kind string, lo long, hi long").where(f"{was} > 0")
    cover = own.where("kind in ('WRITE', 'FREE', 'WRITE_EMBEDDED')").select("seq", "object", F.lit("FREE").alias("kind"), "lo", F.when(F.col("kind") == "WRITE_EMBEDDED", F.col("lo") + F.col("window")).otherwise(F.col("hi")).alias("hi"))
    old = replay.segments(kept.union(cover))

    def read_old(batches):
        for pdf in batches:
            with stream.opened(base) as f:
                for r in pdf.itertuples(index=False):
                    for at in range(r.lo, r.hi, 1 << 20):
                        f.seek(at)
                        yield pd.DataFrame([(at, f.read(min(1 << 20, r.hi - at)))], columns=["lo", "data"])

    parts = old.where("seq = -1").select(F.explode(F.expr("sequence(lo, hi - 1, 67108864L)")).alias("lo"), "hi").withColumn("hi", F.least("hi", F.col("lo") + (64 << 20)))
    both = parts.mapInPandas(read_old, "lo long, data binary").union(read_segments(object_segments(log, object_id)).select("lo", "data"))
    sha = publish(both, target, size)
    save_state(target, object_id, size, rows[0]["to_guid"], sha, path=state.path, bonus_type=state.bonus_type, size_bonus_offset=state.size_bonus_offset, size_spill_offset=state.size_spill_offset)
    return sha
