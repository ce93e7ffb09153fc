"""Replay of a log as it arrives: the state of each object is its interval map.

A trigger's rows of an object are applied in the order of seq. Rows at or before the last seq applied are deliveries
of what was applied already, and change nothing. Each trigger writes the objects it changed under its own number, so a
trigger that is run again after a failure overwrites what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.intervals import Intervals
from tidelog.session import Scratch

STATE = "last long, rows string"
CHANGED = "object long, last_seq long, live_bytes long"


def advanced(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, held = (state.get[0], Intervals(json.loads(state.get[1]))) if state.exists else (-1, Intervals())
    rows = pd.concat(list(batches)).sort_values("seq")
    for r in rows[rows["seq"] > last].itertuples(index=False):
        hi = None if pd.isna(r.hi) else int(r.hi)
        if r.kind == "WRITE":
            held.put(int(r.lo), hi, int(r.seq))
        elif r.kind == "FREE":
            held.cut(int(r.lo), hi)
        elif r.kind == "FREEOBJECTS":
            held = Intervals()
        last = int(r.seq)
    state.update((last, json.dumps(held.rows())))
    yield pd.DataFrame({"object": [key[0]], "last_seq": [last], "live_bytes": [held.length()]})


def replayed(log: DataFrame, name: str = "stream") -> DataFrame:
    """Runs a streaming log (seq, object, kind, lo, hi) through all that is there now; CHANGED, one row per object."""
    spark = log.sparkSession
    scratch = Scratch(spark, name)
    out = scratch.at("changed")
    states = log.select("seq", "object", "kind", "lo", "hi").groupBy("object").applyInPandasWithState(advanced, CHANGED, STATE, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    query = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch.at("progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(f"{CHANGED}, trigger long").parquet(out)
    return found.groupBy("object").agg(F.max_by(F.struct("last_seq", "live_bytes"), "trigger").alias("top")).select("object", "top.*")
