"""The table `events` as a change stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog import testgen
from tidelog.plans.tables import BLOCK, event_log


def events_as_stream(spark: SparkSession, sf_dir: str, target: str) -> int:
    """Writes events as a stream of two snapshots (@first, @last) to a local file; its bytes.

    A fixture for tests and benchmarks: the driver reads the events, and payloads are a pattern of their seq.
    """
    rows = event_log(spark, sf_dir).select("seq", "object", "kind", "lo", "hi").orderBy("seq").toPandas()
    half = len(rows) // 2
    out = testgen.StreamWriter()
    for name, guid, base, part in (("first", 1, 0, rows[:half]), ("last", 2, 1, rows[half:])):
        records = []
        for r in part.itertuples(index=False):
            if r.kind == "OBJECT":
                records.append(testgen.new_object(r.object))
            elif r.kind == "WRITE":
                records.append(testgen.write(r.object, r.lo, np.full((r.hi - r.lo) // 8, r.seq, "<u8").tobytes()))
            elif r.kind == "FREE":
                records.append(testgen.free(r.object, r.lo, r.hi - r.lo))
            else:
                records.append(testgen.free_objects(r.object, 1))
        out.substream(f"tank/events@{name}", guid, base, records)
    with open(target, "wb") as f:
        return f.write(out.out)


def expected(spark: SparkSession, sf_dir: str, object_id: int, size: int = 68 * BLOCK) -> bytes:
    """The object's bytes by applying its events one by one."""
    rows = event_log(spark, sf_dir).where(F.col("object") == object_id).orderBy("seq").collect()
    data = bytearray(size)
    for r in rows:
        if r["kind"] == "FREEOBJECTS":
            data[:] = bytes(size)
        elif r["kind"] == "FREE":
            data[r["lo"] : r["hi"]] = bytes(r["hi"] - r["lo"])
        elif r["kind"] == "WRITE":
            data[r["lo"] : r["hi"]] = np.full((r["hi"] - r["lo"]) // 8, r["seq"], "<u8").tobytes()
    return bytes(data)
