"""The table `events` as change streams, written by tasks, and queries that read them back.

Each day is a snapshot and a file of its own; files count as one stream in the order of their names. A write's payload
is the number of its event, again and again, packed by one of the codecs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import testgen
from tidelog.functions import codecs
from tidelog.operators import lineage
from tidelog.plans import verbs
from tidelog.plans.tables import BLOCK, GRID, LOG, SNAPS, day_snapshots, event_log, query
from tidelog.session import Scratch
from tidelog.sources import stream

CODECS = {0: "off", 15: "lz4", 6: "gzip", 16: "zstd"}


def _records(rows: pd.DataFrame) -> Iterator[tuple]:
    for r in rows.itertuples(index=False):
        if r.kind == "OBJECT":
            yield testgen.new_object(r.object)
        elif r.kind == "WRITE":
            data = np.full((r.hi - r.lo) // 8, r.seq, "<u8").tobytes()
            codec = (0, 15, 6, 16)[r.seq % 64 and 1 + r.seq % 3]  # few are stored as they are
            packed = None if not codec else codecs.encode(CODECS[codec], data)
            yield testgen.write(r.object, r.lo, data, codec=codec, packed=packed and packed + bytes(-len(packed) % 8))
        elif r.kind == "FREE":
            yield testgen.free(r.object, r.lo, r.hi - r.lo)
        else:
            yield testgen.free_objects(r.object, 1)


def write_streams(log: DataFrame, snapshots: DataFrame, folder: str) -> DataFrame:
    """Writes a replay log (seq, object, kind, lo, hi, to_guid) as a stream file per snapshot; (file, bytes).

    A task writes a file under another name and renames it when it is whole, so that a task that runs again leaves the
    same files. A snapshot's rows pass through one task in their order, a batch at a time.
    """
    rows = log.join(F.broadcast(snapshots), "to_guid")  # a row per day
    dealt = rows.select("idx", "name", "to_guid", "from_guid", "seq", "object", "kind", "lo", "hi").repartition("idx").sortWithinPartitions("idx", "seq")
    top = folder.removeprefix("file:")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, now, out, handle, part = [], None, None, None, None

        def close() -> None:
            if handle is not None:
                out.record("END")
                handle.write(out.out)
                done.append((name(now), handle.tell()))
                handle.close()
                os.replace(part, name(now))

        name = lambda idx: f"{top}/{idx:08d}.bin"
        for pdf in batches:
            for idx, own in pdf.groupby("idx", sort=False):
                if idx != now:
                    close()
                    now, out, part = idx, testgen.StreamWriter(), f"{top}/.{uuid.uuid4().hex}"
                    handle = open(part, "wb")
                    first = own.iloc[0]
                    out.begin(first["name"], int(first["to_guid"]), int(first["from_guid"]))
                for kind, payload, fields in _records(own):
                    out.record(kind, payload, **fields)
                handle.write(out.out)
                out.out.clear()
        close()
        yield pd.DataFrame(done, columns=["file", "bytes"])

    return dealt.mapInPandas(write, "file string, bytes long")


def event_streams(spark: SparkSession, sf_dir: str) -> str:
    """Writes events as streams to the shared folder; where."""
    scratch = Scratch(spark, "events")
    folder = scratch.folder("streams")
    scratch.save(write_streams(event_log(spark, sf_dir), day_snapshots(spark, sf_dir), folder), "files")
    return folder


def _log(spark: SparkSession, folder: str) -> DataFrame:
    recs = verbs.indexed(spark, folder)
    snaps = stream.snapshots(recs)
    last = snaps.agg(F.max("idx")).first()[0]
    return verbs.log_of(recs, snaps, lineage.chain(snaps, last))


@query(f"with {LOG}, days as (select distinct to_guid from log) select kind, count(*)::bigint as records, true as ok from (select kind from log union all select 'BEGIN' from days union all select 'END' from days) group by kind")
def stream_inspect(spark, d):
    """Records by kind of the streams that events are written to, every checksum verified."""
    checked = stream.verified(spark, event_streams(spark, d))
    return checked.groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.every("ok").alias("ok"))


@query(f"with {SNAPS} select idx, name, to_guid, from_guid, false as raw from snaps")
def stream_snapshots(spark, d):
    return stream.snapshots(stream.records(spark, event_streams(spark, d))).select("idx", "name", "to_guid", "from_guid", "raw")


@query(f"with {LOG} select kind, object, case when kind in ('WRITE', 'FREE') then lo end as \"offset\", case when kind in ('WRITE', 'FREE') then hi - lo end as length, count(*)::bigint as records from log group by all")
def stream_records(spark, d):
    """The fields of every record's header, read back."""
    recs = stream.records(spark, event_streams(spark, d)).where("kind not in ('BEGIN', 'END')")
    placed = F.col("kind").isin("WRITE", "FREE")
    lo = F.when(placed, F.col("offset"))
    return recs.groupBy("kind", "object", lo.alias("offset"), F.when(placed, F.col("length")).alias("length")).agg(F.count(F.lit(1)).alias("records"))


@query(f"with {GRID} select object, count(*)::bigint as blocks, sum(seq)::bigint as words, min(b) * {BLOCK} as first_byte, (max(b) + 1) * {BLOCK} as end_byte from grid where kind = 'WRITE' group by object")
def stream_contents(spark, d):
    """What every object holds at the last snapshot: payloads are read and decoded, and a word of each block summed."""
    life = verbs.live_log(_log(spark, event_streams(spark, d)))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = np.frombuffer(r.data, "<u8").reshape(-1, BLOCK // 8)
                assert (own == own[:, :1]).all()
                rows.append((r.object, r.lo, r.lo + len(r.data), len(own), int(own[:, 0].sum())))
            yield pd.DataFrame(rows, columns=["object", "lo", "hi", "blocks", "words"])

    read = verbs.read_segments(verbs.segments_of(life)).mapInPandas(words, "object long, lo long, hi long, blocks long, words long")
    return read.groupBy("object").agg(F.sum("blocks").alias("blocks"), F.sum("words").alias("words"), F.min("lo").alias("first_byte"), F.max("hi").alias("end_byte"))
