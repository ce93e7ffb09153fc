"""Change streams as tables.

A stream's framing is sequential, its contents are not. One task per file skims headers and seeks over payloads; the
frames it finds are dealt in even runs of bytes to tasks that decode headers, check sums and, if asked, read payloads.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import wire
from tidelog.functions.wire import StreamError
from tidelog.session import Scratch
from tidelog.sources.ranges import listed, opened

FRAME = "path string, seq long, substream int, header_type int, kind string, at long, payload_length long"
#: Bytes of frames that one task decodes.
RUN = 64 << 20


def framed(path: str) -> Iterator[tuple]:
    """Frames of one file. A stream is a row of substreams, each BEGIN to END; a compound prelude (BEGIN, END) may come
    before some of them, and a zero-filled END record after them closes it."""
    with opened(path) as f:
        seq, inside, substream, header_type, compound, any_ = 0, False, -1, 0, 0, False
        at = 0
        while head := f.read(wire.RECORD):
            if len(head) < wire.RECORD:
                raise StreamError(f"{path}: a record is cut short at {at}")
            kind, fields = wire.decoded(head)
            if kind == "BEGIN":
                if inside:
                    raise StreamError(f"{path}: BEGIN inside a substream at {at}")
                if fields["magic"] != wire.MAGIC:
                    swapped = int.from_bytes(fields["magic"].to_bytes(8, "little"), "big") == wire.MAGIC
                    raise StreamError(f"{path}: {'a big-endian stream' if swapped else 'no stream header'} at {at}")
                header_type = fields["version"] & 3
                if header_type not in (wire.SUBSTREAM, wire.COMPOUND):
                    raise StreamError(f"{path}: header type {header_type}")
                inside, any_ = True, True
                substream += 1
                compound += header_type == wire.COMPOUND
            elif not inside:
                if kind == "END" and compound and not any(head[4:]):
                    compound -= 1  # the conclusion
                    yield path, seq, substream, 0, kind, at, 0
                    seq, at = seq + 1, at + wire.RECORD
                    continue
                raise StreamError(f"{path}: {kind} outside a substream at {at}")
            size = wire.payload_size(kind, fields)
            yield path, seq, substream, header_type, kind, at, size
            if kind == "END":
                inside = False
            seq, at = seq + 1, at + wire.RECORD + size
            if size:
                f.seek(at - 1)
                if not f.read(1):
                    raise StreamError(f"{path}: a payload is cut short before {at}")
        if inside or not any_:
            raise StreamError(f"{path}: the stream {'has no END' if inside else 'is empty'}")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAME rows of every file under a path: where each record is. Breaks of the format are errors."""
    files = listed(spark, path)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(min(len(files), 1024))

    def skim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in FRAME.split(", ")]
        for pdf in batches:
            for p in pdf["path"]:
                rows = []
                for row in framed(p):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return paths.mapInPandas(skim, FRAME)


_NUMBERS = ("object", "object_type", "bonus_type", "block_size", "offset", "length", "logical", "packed", "codec", "etype", "count", "flags", "slots", "levels", "max_block", "to_guid", "from_guid", "creation_time", "version")
RECORD = FRAME + ", " + ", ".join(f"{n} long" for n in _NUMBERS) + ", to_end boolean, name string, crc long, payload binary"
SUMS = "a1 long, b1 long, c1 long, d1 long, n1 long, a2 long, b2 long, c2 long, d2 long, n2 long, said binary, ended binary"


def _runs(index: DataFrame) -> DataFrame:
    """frames with `run`: even runs of bytes within each file."""
    return index.withColumn("run", F.expr(f"at div {RUN}"))


def decoded_batches(payloads: bool, objects: frozenset[int] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From FRAME to RECORD rows. Of records that belong to one object only those of `objects` are kept, if given, and
    only their payloads are read; ranges of objects and the stream's own records always are."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for path, own in pdf.groupby("path", sort=False):
                with opened(path) as f:
                    for r in own.sort_values("at").itertuples(index=False):
                        f.seek(r.at)
                        kind, v = wire.decoded(f.read(wire.RECORD))
                        if objects is not None and kind in OWNED and v["object"] not in objects:
                            continue
                        body = f.read(r.payload_length) if payloads else None
                        to_end = kind == "FREE" and v["length"] == wire.TO_END
                        numbers = [None if to_end and n == "length" else (wire.signed(v[n]) if isinstance(v.get(n), int) else None) for n in _NUMBERS]
                        name = v["name"].split(b"\0")[0].decode("utf-8", "replace") if kind == "BEGIN" else None
                        out.append((*tuple(r)[:7], *numbers, to_end, name, zlib.crc32(body) if payloads else None, body))
                        held += r.payload_length + 400
                        if held > 16 << 20:
                            yield _typed(out)
                            out, held = [], 0
            if out:
                yield _typed(out)

    return decode


def _typed(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    return df.astype({n: "Int64" for n in (*_NUMBERS, "crc")})


#: Kinds of records that belong to one object.
OWNED = ("OBJECT", "WRITE", "WRITE_EMBEDDED", "SPILL", "FREE")


def records(spark: SparkSession, path: str, payloads: bool = False, objects: list[int] | None = None) -> DataFrame:
    """One row per record: FRAME, the numbers of its header (64-bit patterns), to_end for frees without a length, name
    of a BEGIN, and with payloads their bytes and CRC-32. Filters on FRAME columns come before any decoding; a list of
    objects, which tasks are sent, before any payload is read."""
    index = _runs(frames(spark, path)).repartition(F.col("path"), F.col("run")).drop("run")
    return index.mapInPandas(decoded_batches(payloads, None if objects is None else frozenset(objects)), RECORD)


def summed_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial checksums of each frame's two regions, before its sum field and from it on, with the sums it states."""
    for pdf in batches:
        out = []
        for path, own in pdf.groupby("path", sort=False):
            with opened(path) as f:
                for r in own.sort_values("at").itertuples(index=False):
                    f.seek(r.at)
                    head = f.read(wire.RECORD)
                    cut = wire.RECORD if r.kind == "BEGIN" else wire.SUM_AT
                    one, n1 = wire.fletcher4(head[:cut])
                    two, n2 = wire.fletcher4(head[cut:] + f.read(r.payload_length))
                    said = head[wire.SUM_AT :] if r.kind != "BEGIN" and any(head[wire.SUM_AT :]) else None
                    ended = head[8:40] if r.kind == "END" and any(head[8:40]) else None
                    out.append((*tuple(r)[:7], *map(wire.signed, one), n1, *map(wire.signed, two), n2, said, ended))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in (FRAME + ", " + SUMS).split(", ")])


def _state(r: tuple, at: int) -> wire.Sum:
    return tuple(int(x) & wire._MASK for x in r[at : at + 4])


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, kind, ok): whether every checksum that a record states holds. A zero field states none.

    Partials combine like sums, so each run of records is summed where it is read; only one total per run and
    substream is combined in order before records are compared.
    """
    index = _runs(frames(spark, path)).repartition(F.col("path"), F.col("run"))
    # written once, as both the totals and the comparison need them: the stream itself is read a single time
    parts = Scratch(spark, "verified").save(index.drop("run").mapInPandas(summed_batches, FRAME + ", " + SUMS).withColumn("run", F.expr(f"at div {RUN}")), "parts")
    key = ["path", "substream", "run"]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n = wire.ZERO, 0
        for r in pdf.sort_values("seq")[["a1", "b1", "c1", "d1", "n1", "a2", "b2", "c2", "d2", "n2"]].itertuples(index=False):
            state = wire.joined(wire.joined(state, _state(r, 0), int(r[4])), _state(r, 5), int(r[9]))
            n += int(r[4] + r[9])
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in key), *map(wire.signed, state), n)], columns=[*key, *"abcdn"])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = wire.ZERO, []
        for r in pdf.sort_values("run")[[*key, *"abcdn"]].itertuples(index=False):
            out.append((*r[:3], *map(wire.signed, state)))
            state = wire.joined(state, _state(r, 3), int(r[7]))
        return pd.DataFrame(out, columns=[*key, "a", "b", "c", "d"])

    def compared(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        state, out = _state(tuple(pdf[["a", "b", "c", "d"]].iloc[0]), 0), []
        for r in pdf[["a1", "b1", "c1", "d1", "n1", "a2", "b2", "c2", "d2", "n2", "path", "seq", "kind", "said", "ended", "header_type"]].itertuples(index=False):
            before = state
            state = wire.joined(state, _state(r, 0), int(r.n1))
            ok = r.header_type == 0 or ((r.said is None or bytes(r.said) == wire.packed_sum(state)) and (r.ended is None or bytes(r.ended) == wire.packed_sum(before)))
            state = wire.joined(state, _state(r, 5), int(r.n2))
            out.append((r.path, r.seq, r.kind, ok))
        return pd.DataFrame(out, columns=["path", "seq", "kind", "ok"])

    totals = parts.groupBy(*key).applyInPandas(total, "path string, substream int, run long, a long, b long, c long, d long, n long")
    begun = totals.groupBy("path", "substream").applyInPandas(starts, "path string, substream int, run long, a long, b long, c long, d long")
    return parts.join(begun, key).groupBy(*key).applyInPandas(compared, "path string, seq long, kind string, ok boolean")


def snapshots(recs: DataFrame) -> DataFrame:
    """(idx, path, substream, name, to_guid, from_guid, creation_time, features, raw) of substreams in stream order.

    Streams that follow one another in the order of their names count as one. A row per snapshot.
    """
    begins = recs.where("kind = 'BEGIN' and header_type = 1")
    idx = (F.row_number().over(Window.orderBy("path", "seq")) - 1).cast("long")
    features = F.shiftrightunsigned("version", 2)
    return begins.select(idx.alias("idx"), "path", "substream", "name", "to_guid", "from_guid", "creation_time", features.alias("features"), (features.bitwiseAND(F.lit(wire.RAW)) != 0).alias("raw"))
