"""Best-fit packing planned on a histogram of lengths.

Texts become pieces of at most `room` tokens. The plan sees only how many pieces there are of each length: best-fit
decreasing places whole counts at a time, so its work and size follow `room`, not the corpus. Pieces then take the
planned places by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.sharding import numbered
from tidelog.llm.shingles import in_pieces, lean
from tidelog.llm.tokens import VOCABULARY, encoder, forget
from tidelog.session import Scratch

ROOM, END = 4096, 1


class Plan(NamedTuple):
    """Segments in the order of (length, rank): pieces first .. first + count - 1 of all pieces sorted by length go,
    `each` to a sequence, to sequences from `sequence` on, from place `offset` in them on."""

    first: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int


def planned(histogram: dict[int, int], room: int = ROOM) -> Plan:
    """Best-fit decreasing over counts by length (1 to room).

    Sequences with equal room left are ranges of numbers. A length goes to the sequences with the least room that
    holds it; one of them takes as many of this length as fit, since it stays the best fit until it is full.
    """
    start, at = {}, 0
    for length in sorted(histogram):
        start[length], at = at, at + histogram[length]
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    found: list[tuple[int, int, int, int, int]] = []
    used = 0

    def give(left: int, sequence: int, count: int) -> None:
        if left and count:
            if left not in free:
                free[left] = []
                insort(rooms, left)
            free[left].append((sequence, count))

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= room:
            raise ValueError(f"a piece of {length} tokens")
        left, rank = histogram[length], start[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                space = rooms[k]
                sequence, count = free[space].pop()
                if not free[space]:
                    del free[space]
                    rooms.pop(k)
            else:
                space, sequence = room, used
                count = -(-left // (room // length))
                used += count
            each = space // length
            full = min(count, left // each)
            if full:
                found.append((rank, length, sequence, room - space, each))
                rank, left = rank + full * each, left - full * each
                give(space - each * length, sequence, full)
            rest = count - full
            if left and rest:  # fewer are left than one sequence takes
                found.append((rank, length, sequence + full, room - space, left))
                give(space - left * length, sequence + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            give(space, sequence + full, rest)
    rows = np.array(sorted(found), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(c) for c in rows.T), used)


PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def piece_batches(room: int, end: int, vocabulary: str, ids: bool, specials: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, text) to PIECE, with the ids as little-endian unsigned 32-bit bytes if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, specials).encode
        last = end.to_bytes(4, "little")
        for batch in batches:
            for part in in_pieces(batch, 1):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = encode(text or "") + last
                    for k, at in enumerate(range(0, len(data), 4 * room)):
                        own = data[at : at + 4 * room]
                        for c, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                keep = 6 if ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:keep], kinds, strict=False)], names=names[:keep])

    return work


def pieces(documents: DataFrame, room: int = ROOM, end: int = END, vocabulary: str = VOCABULARY, ids: bool = False, specials: bool = True) -> DataFrame:
    """Every row's pieces; a null text is empty and makes one piece that holds the end id alone. Strings of special
    tokens in a text become those tokens' ids, as the library's plain call has it, unless specials is false."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(piece_batches(room, end, vocabulary, ids, specials), forget), PIECE + ", ids binary" * ids)


def placed_batches(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds sequence_id and offset to batches whose last column is the rank among all pieces by length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            s = np.searchsorted(plan.first, rank, "right") - 1
            within = rank - plan.first[s]
            sequence = plan.sequence[s] + within // plan.each[s]
            offset = plan.offset[s] + within % plan.each[s] * plan.length[s]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return work


def packed(documents: DataFrame, room: int = ROOM, end: int = END, vocabulary: str = VOCABULARY, specials: bool = True) -> DataFrame:
    """PIECE, sequence_id and offset for every piece of documents (doc_id, text); other columns are ignored.

    Equal rows, and rows without a doc_id, are packed each for itself. An empty table makes no sequence.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    cut = scratch.save(pieces(documents, room, end, vocabulary, specials=specials), "pieces")
    # room rows at most
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked, _ = numbered(cut, ["length", "doc_id", "piece", "ids_crc32"], scratch, "ranked")
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "row_number")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(lean(placed_batches(planned(histogram, room))), schema)


def sequences(documents: DataFrame, room: int = ROOM, end: int = END, vocabulary: str = VOCABULARY, specials: bool = True) -> DataFrame:
    """One row per sequence: sequence_id, ids (array of long, room at most), and starts: the documents' places in it."""
    places = packed(documents, room, end, vocabulary, specials).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    # rows that repeat have equal pieces, which may swap places
    key = ["doc_id", "piece", "ids_crc32", "nth"]
    nth = "row_number() over (partition by doc_id, piece, ids_crc32 order by {})"
    places = places.withColumn("nth", F.expr(nth.format("sequence_id, offset")))
    full = pieces(documents, room, end, vocabulary, True, specials).select("doc_id", "piece", "ids_crc32", "ids").withColumn("nth", F.expr(nth.format("length(ids)")))
    both = places.join(full, [F.equal_null(places[k], full[k]) for k in key]).select("sequence_id", "offset", places["doc_id"], "ids")
    each = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int64) for row in batch.column(1).to_pylist()]
            starts = [[p["offset"] for p in row] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names=["sequence_id", "ids", "starts"])

    return each.mapInArrow(work, "sequence_id long, ids array<long>, starts array<long>")


def query(documents: DataFrame) -> DataFrame:
    return packed(documents)
