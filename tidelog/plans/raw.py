"""Encrypted streams: authentication of object ranges, and replay with a key.

Records of 32 objects share one code, which covers their records and the codes of all their blocks, older ones too. A
range's records of all snapshots therefore meet in one group, which carries its objects' blocks on and checks the code
whenever a range is complete. Payloads are opened where segments are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import codecs, sealed, wire
from tidelog.operators import lineage, replay
from tidelog.plans import filesystem, verbs
from tidelog.session import Scratch
from tidelog.sources import stream

OBJECTS = "object long, object_type long, bonus_type long, block_size long, since long, plain binary, spill_data binary"
#: Snapshots whose key parameters the driver looks at.
MOST = lineage.DEEPEST

Keys = dict[tuple[str, int], sealed.DatasetKey]


def headers(spark: SparkSession, recs: DataFrame) -> list[tuple]:
    """(path, substream, to_guid, raw, payload) of the snapshots' headers, a row per snapshot."""
    rows = recs.where("kind = 'BEGIN' and header_type = 1").orderBy("path", "seq").select("path", "substream", "to_guid", "version", "at", "payload_length").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} snapshots")
    out = []
    for r in rows:
        raw = bool(r["version"] >> 2 & wire.RAW)
        payload = b""
        if raw:
            with stream.opened(r["path"]) as f:
                f.seek(r["at"] + wire.RECORD)
                payload = f.read(r["payload_length"])
        out.append((r["path"], r["substream"], r["to_guid"], raw, payload))
    return out


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """(to_guid, key_format) of every encrypted snapshot of a stream, the last one of a guid counting."""
    found = {}
    for _, _, guid, raw, payload in headers(spark, verbs.indexed(spark, path)):
        if raw:
            found[guid] = sealed.params_of_header(payload).form
    return spark.createDataFrame(list(found.items()), "to_guid long, key_format string")


def requirement(spark: SparkSession, path: str, snapshot: str | None = None) -> str | None:
    """The key format that one snapshot needs, or None."""
    snaps = stream.snapshots(verbs.indexed(spark, path))
    guid = snaps.where(F.col("idx") == verbs.selected(snaps, snapshot)).first()["to_guid"]
    row = requirements(spark, path).where(F.col("to_guid") == guid).first()
    return row and row["key_format"]


def delta_requirement(spark: SparkSession, path: str) -> str | None:
    """As requirement, of a stream that must hold exactly one snapshot."""
    if stream.snapshots(verbs.indexed(spark, path)).limit(2).count() != 1:
        raise verbs.StateError("a delta must hold one snapshot")
    return requirement(spark, path)


def keys_of(found: list[tuple], chain: set[int], material: bytes) -> Keys:
    """Every snapshot's keys; all of a chain must be of one key and one version."""
    out: Keys = {}
    known: dict[bytes, sealed.DatasetKey] = {}
    identity = set()
    for path, substream, guid, raw, payload in found:
        if guid not in chain:
            continue
        if not raw:
            raise verbs.Unsupported("a chain of encrypted and plain snapshots")
        if payload not in known:
            p = sealed.params_of_header(payload)
            identity.add((p.guid, p.version))
            known[payload] = sealed.unlocked(p, material)
        out[path, substream] = known[payload]
    if len(identity) > 1:
        raise verbs.Unsupported("a chain whose snapshots have different keys")
    return out


LOG = "path string, substream int, seq long, kind string, at long, payload_length long, object long, count long, lo long, hi long, head binary"


def log_of(recs: DataFrame, snaps: DataFrame, chain: DataFrame) -> DataFrame:
    """LOG rows of a chain: every record with its header's bytes, in the order of all files."""
    plan = chain.select("to_guid").join(snaps, "to_guid").select("path", "substream", F.col("idx").alias("order"))
    rows = recs.join(F.broadcast(plan), ["path", "substream"])
    verbs.refuse(rows, ranges=True)
    if rows.where("kind = 'WRITE_EMBEDDED'").limit(1).count():
        raise verbs.Unsupported("an embedded write in an encrypted stream")
    rows = rows.where(F.col("kind").isin("OBJECT", "WRITE", "SPILL", "FREE", "FREEOBJECTS", "OBJECT_RANGE", "END"))
    told = rows.select("path", "substream", (F.col("order") * F.lit(1 << 40) + F.col("seq")).alias("seq"), "kind", "at", "payload_length", "object", "count", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, own in pdf.groupby("path", sort=False):
                with stream.opened(path) as f:
                    for at in own["at"]:
                        f.seek(at)
                        out.append(f.read(wire.RECORD))
            yield pd.concat([own for _, own in pdf.groupby("path", sort=False)]).assign(head=out) if out else pdf.assign(head=[])

    return told.mapInPandas(heads, LOG)


def by_range(log: DataFrame) -> DataFrame:
    """LOG rows with `cell`, the range of objects that they belong to, and `until`, where a range is complete. A free
    of many objects is a row in each range that it touches and that anything else is in."""
    closers = log.where("kind in ('OBJECT_RANGE', 'END')").select("path", "substream", "seq", F.lead("seq").over(Window.partitionBy("path", "substream").orderBy("seq")).alias("until"))
    own = log.where("kind not in ('FREEOBJECTS', 'END')").withColumn("cell", F.expr(f"object div {sealed.SLOTS}"))
    own = own.join(closers, ["path", "substream", "seq"], "left")
    frees = log.where("kind = 'FREEOBJECTS' and count > 0")
    met = replay.covering(own.select(F.col("cell").alias("object")).distinct(), frees.select("seq", F.expr(f"object div {sealed.SLOTS}").alias("first_object"), F.expr(f"(object + count - 1) div {sealed.SLOTS} - object div {sealed.SLOTS} + 1").alias("count")))
    spread = frees.join(met.select(F.col("object").alias("cell"), "seq"), "seq").withColumn("until", F.lit(None).cast("long"))
    return own.unionByName(spread)


def replayed_range(keys: Keys):
    """Replays the records of one range: OBJECTS rows of what is left, every completed range authenticated."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        records: dict[int, sealed.Record] = {}
        told: dict[int, dict] = {}
        files: dict[str, object] = {}
        now: dict | None = None

        def payload(r) -> bytes:
            f = files.get(r.path) or files.setdefault(r.path, stream.opened(r.path))
            f.seek(r.at + wire.RECORD)
            return f.read(r.payload_length)

        def close() -> None:
            nonlocal now
            if now is None:
                return
            own = [x for x in records.values() if now["object"] <= x.object < now["object"] + sealed.SLOTS]
            if now["flags"] & 2 or now["count"] != sealed.SLOTS:
                raise sealed.SealedError("a range of swapped bytes or of another length")
            for number, plain in sealed.bonuses(now["key"], now["object"], now["salt"], now["iv"], now["mac"], own).items():
                told[number]["plain"] = plain
            now = None

        try:
            for r in pdf.sort_values("seq").itertuples(index=False):
                if now is not None and (r.seq >= now["until"] or (r.path, r.substream) != now["where"]):
                    close()
                _, v = wire.decoded(bytes(r.head))
                own = keys[r.path, r.substream]
                if r.kind == "OBJECT_RANGE":
                    now = v | {"until": r.until, "where": (r.path, r.substream), "key": own}
                elif r.kind == "OBJECT":
                    if now is None:
                        raise sealed.SealedError(f"object {r.object} outside its range")
                    before = records.get(r.object)
                    made = sealed.Record(
                        r.object, v["object_type"], v["bonus_type"], v["block_size"], v["bonus_length"], v["checksum"], v["codec"], v["slots"], v["flags"], v["indirect_shift"], v["levels"], v["pointers"], v["max_block"], payload(r), {}, None
                    )
                    if before is not None and made.same_layout(before):
                        made = made._replace(leaves={k: b for k, b in before.leaves.items() if k <= made.last}, spill=before.spill if made.flags & 4 else None)
                    records[r.object] = made
                    was = told.get(r.object)
                    same = was is not None and was["object_type"] == made.kind
                    told[r.object] = {"object_type": made.kind, "bonus_type": made.bonus_type, "block_size": made.block, "since": was["since"] if same else r.seq, "plain": b"", "spill_data": was["spill_data"] if was and made.flags & 4 else None}
                elif r.kind == "WRITE":
                    if r.object not in records or not v["length"] or v["offset"] % v["length"]:
                        raise sealed.SealedError(f"a write to object {r.object} without a record or between blocks")
                    records[r.object].leaves[v["offset"] // v["length"]] = sealed.Leaf(v["object_type"], v["length"], v["packed"], v["codec"], v["flags"], v["mac"])
                elif r.kind == "SPILL":
                    if r.object not in records:
                        raise sealed.SealedError(f"a spill of object {r.object} without a record")
                    records[r.object] = records[r.object]._replace(spill=sealed.Leaf(44, v["length"], v["packed"], v["codec"], v["flags"], v["mac"]))
                    data = own.opened(v["salt"], v["iv"], v["mac"], b"", payload(r))
                    told[r.object]["spill_data"] = codecs.decode(codecs.name_of(v["codec"] or 2), data, v["length"])
                elif r.kind == "FREE":
                    if r.object in records:
                        end = wire._MASK if v["length"] == wire.TO_END else v["offset"] + v["length"]
                        leaves = records[r.object].leaves
                        for k in [k for k, b in leaves.items() if k * b.logical < end and (k + 1) * b.logical > v["offset"]]:
                            del leaves[k]
                else:  # FREEOBJECTS
                    for number in [x for x in records if r.object <= x < r.object + r.count]:
                        del records[number], told[number]
            close()
        finally:
            for f in files.values():
                f.close()
        rows = [(n, t["object_type"], t["bonus_type"], t["block_size"], t["since"], t["plain"], t["spill_data"]) for n, t in sorted(told.items())]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OBJECTS.split(", ")])

    return work


def segments_of(life: DataFrame) -> DataFrame:
    """Segments with the places of their sealed payloads."""
    segs = replay.segments(life.select("object", "seq", "kind", "lo", "hi"))
    return segs.join(life.where("kind = 'WRITE'").select("seq", "path", "substream", "at", "payload_length"), "seq")


def read_segments(segs: DataFrame, keys: Keys) -> DataFrame:
    """(object, lo, data): payloads are authenticated, opened and unpacked where the rows are."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=False):
                with stream.opened(path) as f:
                    last, data = None, b""
                    for r in own.sort_values(["at", "lo"]).itertuples(index=False):
                        if r.at != last:
                            f.seek(r.at)
                            _, v = wire.decoded(f.read(wire.RECORD))
                            body, key = f.read(r.payload_length), keys[path, r.substream]
                            if wire.is_encrypted_type(v["object_type"]):
                                body = key.opened(v["salt"], v["iv"], v["mac"], b"", body)
                            else:
                                key.check(body, v["mac"])
                            data, last = codecs.decode(codecs.name_of(v["codec"] or 2), body, v["length"]), r.at
                        yield pd.DataFrame([(r.object, r.lo, data[r.lo - r.begins : r.hi - r.begins])], columns=["object", "lo", "data"])

    return segs.mapInPandas(read, "object long, lo long, data binary")


def opened(spark: SparkSession, path: str, material: bytes, snapshot: str | None = None, verify: bool = True) -> filesystem.Snapshot:
    """An encrypted snapshot, ready to be listed and read by the functions of module filesystem."""
    if verify:
        verbs.inspect(spark, path)
    recs = verbs.indexed(spark, path)
    snaps = stream.snapshots(recs)
    chain = lineage.chain(snaps, verbs.selected(snaps, snapshot))
    guids = {r["to_guid"] for r in chain.collect()}
    keys = keys_of(headers(spark, recs), guids, material)
    scratch = Scratch(spark, "sealed")
    log = scratch.save(log_of(recs, snaps, chain), "log")
    objects = scratch.save(by_range(log).groupBy("cell").applyInPandas(replayed_range(keys), OBJECTS), "objects")
    since = objects.select("object", "since")
    life = log.where("kind in ('WRITE', 'FREE')").drop("head").join(since, "object").where("seq >= since").drop("since")
    life = scratch.save(life, "life")
    pieces = lambda rows: read_segments(segments_of(rows), keys)
    entries = scratch.save(filesystem.entries_of(life, objects, pieces), "entries")
    guid = chain.where("depth = 0").first()["to_guid"]
    return filesystem.Snapshot(spark, scratch, guid, life, objects, entries, filesystem.registry_of(entries), pieces)
