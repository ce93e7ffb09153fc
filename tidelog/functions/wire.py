"""The change stream's wire format: record layout, payload sizes and the running checksum."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import Scratch

RECORD = 312
SUM_AT = 280
MAGIC = 0x2F5BACBAC
MOST_PAYLOAD = 256 << 20
RAW = 1 << 24
SUBSTREAM, COMPOUND = 1, 2
TO_END = (1 << 64) - 1
_MASK = (1 << 64) - 1

# Record tags of the format.
TAGS = {"BEGIN": 0, "OBJECT": 1, "FREEOBJECTS": 2, "WRITE": 3, "FREE": 4, "END": 5, "WRITE_BYREF": 6, "SPILL": 7, "WRITE_EMBEDDED": 8, "OBJECT_RANGE": 9, "REDACT": 10}
NAMES = {v: k for k, v in TAGS.items()}
#: Object types whose data is metadata that listings need.
METADATA_TYPES = (20, 21, 45, 46, 47)
# Object types that are stored encrypted, besides those whose flag bits say so.
ENCRYPTED_TYPES = (9, 10, 18, 19, 20, 22, 23, 25, 26, 33, 34, 35, 39, 40, 44, 45, 46, 47, 49)

# Name, format and byte offset of the header fields of each kind.
FIELDS: dict[str, list[tuple[str, str, int]]] = {
    "BEGIN": [("payload", "I", 4), ("magic", "Q", 8), ("version", "Q", 16), ("creation_time", "Q", 24), ("objset_type", "I", 32), ("flags", "I", 36), ("to_guid", "Q", 40), ("from_guid", "Q", 48), ("name", "256s", 56)],
    "OBJECT": [("object", "Q", 8), ("object_type", "I", 16), ("bonus_type", "I", 20), ("block_size", "I", 24), ("bonus_length", "I", 28), ("checksum", "B", 32), ("codec", "B", 33), ("slots", "B", 34), ("flags", "B", 35), ("raw_bonus_length", "I", 36), ("indirect_shift", "B", 48), ("levels", "B", 49), ("pointers", "B", 50), ("max_block", "Q", 56)],
    "FREEOBJECTS": [("object", "Q", 8), ("count", "Q", 16)],
    "WRITE": [("object", "Q", 8), ("object_type", "I", 16), ("offset", "Q", 24), ("length", "Q", 32), ("checksum", "B", 48), ("flags", "B", 49), ("codec", "B", 50), ("packed", "Q", 96), ("salt", "8s", 104), ("iv", "12s", 112), ("mac", "16s", 124)],
    "FREE": [("object", "Q", 8), ("offset", "Q", 16), ("length", "Q", 24)],
    "END": [("sum", "32s", 8)],
    "WRITE_BYREF": [],
    "SPILL": [("object", "Q", 8), ("length", "Q", 16), ("flags", "B", 32), ("codec", "B", 33), ("packed", "Q", 40), ("salt", "8s", 48), ("iv", "12s", 56), ("mac", "16s", 68), ("object_type", "I", 84)],
    "WRITE_EMBEDDED": [("object", "Q", 8), ("offset", "Q", 16), ("length", "Q", 24), ("codec", "B", 40), ("etype", "B", 41), ("logical", "I", 48), ("packed", "I", 52)],
    "OBJECT_RANGE": [("object", "Q", 8), ("count", "Q", 16), ("salt", "8s", 32), ("iv", "12s", 40), ("mac", "16s", 52), ("flags", "B", 68)],
    "REDACT": [],
}


class StreamError(ValueError):
    """A change stream that breaks its format."""


def header(kind: str, **values: int | bytes) -> bytes:
    """A record header without its checksum; fields that are not given are zero."""
    out = bytearray(RECORD)
    struct.pack_into("<I", out, 0, TAGS[kind])
    for name, form, at in FIELDS[kind]:
        if name in values:
            struct.pack_into(f"<{form}", out, at, values[name])
    return bytes(out)


def decoded(head: bytes) -> tuple[str, dict[str, int | bytes]]:
    """A header's kind and fields."""
    (tag,) = struct.unpack_from("<I", head)
    if tag not in NAMES:
        raise StreamError(f"unknown record tag {tag}")
    kind = NAMES[tag]
    return kind, {name: struct.unpack_from(f"<{form}", head, at)[0] for name, form, at in FIELDS[kind]}


def payload_size(kind: str, f: dict) -> int:
    up = lambda n: (n + 7) & ~7
    if kind == "BEGIN":
        size = f["payload"]
    elif kind == "OBJECT":
        size = f["raw_bonus_length"] or up(f["bonus_length"])
    elif kind == "WRITE":
        size = f["packed"] if f["codec"] else f["length"]
    elif kind == "SPILL":
        size = f["packed"] or f["length"]
    elif kind == "WRITE_EMBEDDED":
        size = up(f["packed"])
    else:
        size = 0
    if size > MOST_PAYLOAD:
        raise StreamError(f"a payload of {size} bytes")
    return size


Sum = tuple[int, int, int, int]
ZERO: Sum = (0, 0, 0, 0)


def fletcher4(data: bytes) -> tuple[Sum, int]:
    """The checksum of data from a zero state, and its number of 32-bit words.

    Each of the four words is a sum of the data weighted by binomials of the distance to the end, modulo 2 ** 64.
    """
    if len(data) % 4:
        raise StreamError("a region that is no multiple of 4 bytes")
    words = np.frombuffer(data, "<u4").astype(np.uint64)
    n = len(words)
    state: Sum = ZERO
    for at in range(0, n, 1 << 16):  # binomials of a short run stay exact
        run = words[at : at + (1 << 16)]
        k = np.arange(len(run), 0, -1, dtype=np.uint64)
        two = k * (k + np.uint64(1)) // np.uint64(2)
        three = two * (k + np.uint64(2)) // np.uint64(3)
        part = tuple(int((run * w).sum(dtype=np.uint64)) for w in (np.uint64(1), k, two, three))
        state = joined(state, part, len(run))
    return state, n


def joined(left: Sum, right: Sum, n: int) -> Sum:
    """The state after two regions, the right one of n words, each summed from a zero state."""
    a, b, c, d = left
    two, three = n * (n + 1) // 2, n * (n + 1) * (n + 2) // 6
    return (a + right[0]) & _MASK, (b + n * a + right[1]) & _MASK, (c + n * b + two * a + right[2]) & _MASK, (d + n * c + two * b + three * a + right[3]) & _MASK


def packed_sum(s: Sum) -> bytes:
    return struct.pack("<4Q", *s)


def signed(x: int) -> int:
    """A 64-bit pattern as a signed number."""
    return x - (1 << 64) if x >> 63 else x


def encrypted_type(kind: Column) -> Column:
    """Whether an object type is stored encrypted: one of the list, or both flag bits set."""
    return F.when(kind.bitwiseAND(F.lit(0x80)) != 0, kind.bitwiseAND(F.lit(0x20)) != 0).otherwise(kind.isin(*ENCRYPTED_TYPES))


def is_encrypted_type(kind: int) -> bool:
    """encrypted_type for one number."""
    return kind & 0xA0 == 0xA0 if kind & 0x80 else kind in ENCRYPTED_TYPES


def full_or_incremental(from_guid: Column) -> Column:
    return F.when(from_guid == 0, "full").otherwise("incremental")


PARTIAL = "seq long, a long, b long, c long, d long, n long"


def partial_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for seq, data in zip(pdf["seq"], pdf["data"], strict=True):
            s, n = fletcher4(bytes(data))
            rows.append((seq, *map(signed, s), n))
        yield pd.DataFrame(rows, columns=["seq", "a", "b", "c", "d", "n"])


def prefix_states(pdf: pd.DataFrame) -> pd.DataFrame:
    """State after each row of (seq, a, b, c, d, n), in the order of seq, within one group."""
    pdf = pdf.sort_values("seq")
    state, out = ZERO, []
    for r in pdf[["a", "b", "c", "d", "n"]].itertuples(index=False):
        state = joined(state, tuple(int(x) & _MASK for x in r[:4]), int(r[4]))
        out.append(tuple(map(signed, state)))
    pdf[["a", "b", "c", "d"]] = pd.DataFrame(out, columns=["a", "b", "c", "d"], index=pdf.index, dtype="int64")
    return pdf


def running_fletcher4(rows: DataFrame, run: int = 4096) -> DataFrame:
    """(seq, a, b, c, d): the checksum of all data up to each row (seq from 0 on, data), as signed 64-bit patterns.

    Rows become partials where they are; runs of `run` rows are summed up each in its group, and their totals in turn,
    level by level, so that no group holds more than a run.
    """
    scratch = Scratch(rows.sparkSession, "fletcher4")
    parts = scratch.save(rows.select("seq", "data").mapInPandas(partial_batches, PARTIAL), "partials")
    return _prefixed(parts, run, scratch, 0).select("seq", "a", "b", "c", "d")


def _prefixed(parts: DataFrame, run: int, scratch: Scratch, level: int) -> DataFrame:
    """PARTIAL rows with the state after each one, and the words so far, in the place of its own."""
    if parts.limit(run + 1).count() <= run:
        return parts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: _with_words(prefix_states(pdf.drop(columns="one"))), PARTIAL)
    dealt = parts.withColumn("run", F.expr(f"seq div {run}"))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        last = prefix_states(pdf.drop(columns="run")).iloc[-1]
        return pd.DataFrame({"seq": [int(pdf["run"].iloc[0])], **{k: [int(last[k])] for k in "abcd"}, "n": [int(pdf["n"].sum())]})

    totals = scratch.save(dealt.groupBy("run").applyInPandas(total, PARTIAL), f"totals-{level}")
    before = _prefixed(totals, run, scratch, level + 1).select((F.col("seq") + 1).alias("run"), *[F.col(k).alias(f"s{k}") for k in "abcdn"])

    def moved(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        start, words = (ZERO, 0) if pd.isna(first["sa"]) else (tuple(int(first[f"s{k}"]) & _MASK for k in "abcd"), int(first["sn"]))
        own = _with_words(prefix_states(pdf[["seq", "a", "b", "c", "d", "n"]]))
        out = [tuple(map(signed, joined(start, tuple(int(x) & _MASK for x in r[:4]), int(r[4])))) for r in own[["a", "b", "c", "d", "n"]].itertuples(index=False)]
        own[["a", "b", "c", "d"]] = pd.DataFrame(out, columns=["a", "b", "c", "d"], index=own.index, dtype="int64")
        own["n"] += words
        return own

    return dealt.join(before, "run", "left").groupBy("run").applyInPandas(moved, PARTIAL)


def _with_words(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    pdf["n"] = pdf["n"].cumsum()
    return pdf
