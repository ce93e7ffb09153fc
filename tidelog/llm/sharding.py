"""Sharding: a Feistel permutation of global row numbers gives each row a reproducible place.

Rows are numbered in the order of a total key. A Feistel network over the least even power of two that holds all
numbers permutes them; numbers that leave the range walk on through the network until they are back in it. The place
modulo the shard count is the shard, the quotient is the slot: both follow from the row number alone, and back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import Scratch

ROUNDS = 6
#: Steps of the walk; each leaves the range with a chance of 3/4 at most. A row that is still outside stops the job.
STEPS = 256


def half_bits(rows: int) -> int:
    """Bits of each half of the network: 4 ** bits is at least rows."""
    return max(1, -(-max(1, rows - 1).bit_length() // 2))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed * 1_000_003 + (r + 1) * 7_368_787) % (1 << 20) for r in range(rounds)]


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place in 0 to rows - 1 of a row number in that range."""
    bits = half_bits(rows)
    if bits > 26:
        raise ValueError("more than 2 ** 52 rows")
    mask = (1 << bits) - 1

    def once(x: Column) -> Column:
        """One pass: in each round the right half moves left, and the left one gets a mix of the right one added."""

        def turn(h: Column, k: Column) -> Column:
            spread = (h["b"] + k) * F.lit(2654435761)
            return F.struct(h["b"].alias("a"), (h["a"] + F.shiftright(spread, 13) + F.shiftright(spread, 29)).bitwiseAND(F.lit(mask)).alias("b"))

        halves = F.struct(F.shiftright(x, bits).alias("a"), x.bitwiseAND(F.lit(mask)).alias("b"))
        keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
        return F.aggregate(keys, halves, turn, lambda h: F.shiftleft(h["a"], bits).bitwiseOR(h["b"]))

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), once(number), lambda x, _: F.when(x >= rows, once(x)).otherwise(x))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("a row number left the walk outside its range")).cast("long"))


def numbered(df: DataFrame, by: list[str], scratch: Scratch, name: str = "numbered") -> tuple[DataFrame, int]:
    """df with `row_number` (long, gapless from 0) in the order of the columns `by`, and the number of rows.

    Rows are dealt by ranges of the key with their place in the input as its last part, so that equal keys part too;
    the sorted rows are written once, since sampled range bounds may differ in a second run. Each written partition's
    first number is a sum over one row per partition. Rows that tie in `by` are numbered in any order. A column of df
    that is called row_number gives way.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie, place, part, start = (unused(df, k) for k in ("tie", "place", "part", "start"))
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(n, *by, tie).sortWithinPartitions(*by, tie).drop(tie)
    placed = scratch.save(sorted_.withColumn(place, F.monotonically_increasing_id()), name)
    counts = placed.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count(F.lit(1)).alias(start))
    # one row for each partition of the write above
    sizes = {r[part]: r[start] for r in counts.collect()}
    first, total = [], 0
    for p in sorted(sizes):
        first.append((p, total))
        total += sizes[p]
    # from Arrow, as Spark would keep a second daemon and workers for rows of Python
    told = pa.table([pa.array([p[k] for p in first], pa.int64()) for k in (0, 1)], names=[part, start])
    starts = F.broadcast(df.sparkSession.createDataFrame(told))
    out = placed.withColumn(part, F.shiftright(place, 33)).join(starts, part)
    out = out.withColumn("row_number", F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop(part, start, place), total


def unused(df: DataFrame, name: str) -> str:
    """A name that df has no column of, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def sharded(df: DataFrame, by: list[str], shards: int, scratch: Scratch, seed: int = 0) -> DataFrame:
    """df with row_number, place, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Shards differ by one row at most. An empty df gives an empty result. Columns of df that have these names give way,
    but for those in `by`, which may not have them; all others stay, whatever their names.
    """
    rows, total = numbered(df, by, scratch)
    return rows.withColumn("place", permuted(F.col("row_number"), max(1, total), seed)).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


SHARDS, SEED = 8, 20_240_607


def query(documents: DataFrame) -> DataFrame:
    """A null text is an empty one of size 1. Repeated rows tie, and share their places out among themselves."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharded(narrow, ["doc_id", "text_crc32", "size"], SHARDS, Scratch(documents.sparkSession, "sharding"), SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
