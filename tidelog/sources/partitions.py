"""Partition tables and volumes of disk images: GPT, MBR with its chain of extended records, and file systems."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.images import Image, ImageError, Source, container
from tidelog.sources.ranges import listed
from tidelog.sources.volumes import probed

SECTORS = (512, 4096)
MOST_ENTRIES, MOST_TABLE, MOST_LINKS = 16_384, 64 << 20, 128
# Partition types of extended partitions, and of the one that protects a GPT.
EXTENDED, PROTECTIVE = (0x05, 0x0F, 0x85), 0xEE


class PartitionError(ImageError):
    """A partition table that breaks its format."""


class Part(NamedTuple):
    scheme: str
    number: int
    offset: int
    length: int
    kind: str
    name: str


def _gpt_at(image: Source, sector: int, at: int, strict: bool = True) -> list[Part]:
    head = image.read(at, sector)
    if head[:8] != b"EFI PART":
        raise PartitionError("no GPT header")
    size, said = struct.unpack_from("<II", head, 12)
    if not 92 <= size <= sector or zlib.crc32(head[:16] + bytes(4) + head[20:size]) != said:
        raise PartitionError("the GPT header's checksum does not hold")
    own, _, first, last = struct.unpack_from("<QQQQ", head, 24)
    table, count, entry, crc = struct.unpack_from("<QIII", head, 72)
    if own * sector != at or entry < 128 or entry % 8 or count > MOST_ENTRIES or count * entry > MOST_TABLE:
        raise PartitionError("the GPT header's numbers are out of range")
    rows = image.read(table * sector, count * entry)
    if zlib.crc32(rows) != crc:
        raise PartitionError("the GPT table's checksum does not hold")
    out = []
    for k in range(count):
        e = rows[k * entry : (k + 1) * entry]
        if not any(e[:16]):
            continue
        lo, hi = struct.unpack_from("<QQ", e, 32)
        if not first <= lo <= hi <= last or (hi + 1) * sector > image.size:
            if not strict:
                continue
            raise PartitionError(f"GPT partition {k + 1} is out of range")
        name = e[56:128].decode("utf-16-le", "replace").split("\0")[0]
        out.append(Part("gpt", k + 1, lo * sector, (hi - lo + 1) * sector, str(uuid.UUID(bytes_le=e[:16])), name))
    return out


def gpt(image: Source) -> list[Part] | None:
    """Partitions by the first header that holds: the primary, then the backup, in sectors of 512, then 4096 bytes.

    None if no header is there; an error if one is and none holds."""
    errors = []
    for sector in SECTORS:
        for at in (sector, image.size - sector):
            if at + sector > image.size or at < sector:
                continue
            if image.read(at, 8) != b"EFI PART":
                continue
            try:
                return _gpt_at(image, sector, at)
            except ImageError as e:
                errors.append(str(e))
    if errors:
        raise PartitionError("; ".join(errors))
    return None


def _entries(record: bytes) -> list[tuple[int, int, int]]:
    return [(record[446 + 16 * k + 4], *struct.unpack_from("<II", record, 446 + 16 * k + 8)) for k in range(4)]


def mbr(image: Source) -> list[Part] | None:
    """Primary partitions, numbered 1 to 4, and logical ones from 5 on, along the chain of extended records."""
    if image.size < 512:
        return None
    record = image.read(0, 512)
    if record[510:] != b"\x55\xaa" or any(record[446 + 16 * k] not in (0, 0x80) for k in range(4)):
        return None
    out: list[Part] = []

    def put(number: int, kind: int, first: int, count: int) -> None:
        if not count or (first + count) * 512 > image.size or not first:
            raise PartitionError(f"MBR partition {number} is out of range")
        out.append(Part("mbr", number, first * 512, count * 512, f"0x{kind:02x}", ""))

    number = 5
    for k, (kind, first, count) in enumerate(_entries(record), 1):
        if not kind or kind == PROTECTIVE:
            continue
        if kind not in EXTENDED:
            put(k, kind, first, count)
            continue
        seen: set[int] = set()
        link = first
        while True:
            if link in seen or len(seen) >= MOST_LINKS:
                raise PartitionError("the extended chain is a loop or too long")
            seen.add(link)
            if not first <= link < first + count:
                raise PartitionError("an extended record lies outside its partition")
            sub = image.read(link * 512, 512)
            if sub[510:] != b"\x55\xaa":
                raise PartitionError("an extended record has no signature")
            (kind1, at1, n1), (kind2, at2, _), *_ = _entries(sub)
            if kind1:
                put(number, kind1, link + at1, n1)
                number += 1
            if kind2 not in EXTENDED:
                break
            link = first + at2
    return sorted(out, key=lambda p: p.number)


def filesystem(image: Source) -> str | None:
    """The file system at the start of an image, by the marks of its boot sector or superblock."""
    if image.size < 512:
        return None
    boot = image.read(0, 512)
    if boot[3:11] == b"NTFS    ":
        return "ntfs"
    if boot[3:11] == b"EXFAT   ":
        return "exfat"
    if image.size >= 2048 and image.read(1024 + 56, 2) == b"\x53\xef":
        features = struct.unpack("<I", image.read(1024 + 96, 4))[0]
        return "ext4" if features & 0x40 else "ext2"
    sector, per, reserved, fats = struct.unpack_from("<HBHB", boot, 11)
    if boot[510:] == b"\x55\xaa" and sector in (512, 1024, 2048, 4096) and per and not per & (per - 1) and reserved and fats in (1, 2):
        roots, small = struct.unpack_from("<HH", boot, 17)
        fat16, large, fat32 = struct.unpack_from("<H", boot, 22)[0], *struct.unpack_from("<II", boot, 32)
        total, fat = small or large, fat16 or fat32
        data = total - reserved - fats * fat - -(-roots * 32 // sector)
        if total and fat and data > 0:
            clusters = data // per
            return "fat12" if clusters < 4085 else "fat16" if clusters < 65525 else "fat32"
    return None


def volumes_of(image: Source) -> Iterator[tuple]:
    """(scheme, number, offset, length, kind, name, filesystem, diagnostic) of a disk: GPT first, then a file system at
    byte 0, then MBR; one raw volume where there is none of these. A table that breaks its format, or a file system
    that announces itself and does not open, is a diagnostic."""
    note = None
    try:
        parts = gpt(image)
        if parts is None and filesystem(image) is None:
            parts = mbr(image)
    except ImageError as e:
        parts, note = None, str(e)
    if not parts:
        found, why = probed(image, filesystem(image))
        yield "raw", 0, 0, image.size, "", "", found, note or (why if filesystem(image) else None)
        return
    for p in parts:
        volume = image.window(p.offset, p.length)
        yield *p, *probed(volume, filesystem(volume))


def pool_partitions(image: Source) -> list[Part]:
    """Partitions that may hold a pool: those of the primary GPT that lie within the disk, or else primary MBR ones.

    Unlike gpt() and mbr(), what is out of range is passed over, and neither the backup nor extended chains are read.
    """
    for sector in SECTORS:
        if image.size >= 2 * sector and image.read(sector, 8) == b"EFI PART":
            try:
                return _gpt_at(image, sector, sector, strict=False)
            except ImageError:
                continue
    if image.size < 512 or image.read(510, 2) != b"\x55\xaa":
        return []
    found = enumerate(_entries(image.read(0, 512)), 1)
    return [Part("mbr", k, first * 512, count * 512, f"0x{kind:02x}", "") for k, (kind, first, count) in found if kind and kind != PROTECTIVE and kind not in EXTENDED and first and count and (first + count) * 512 <= image.size]


def label(volume) -> str:
    """What a volume is called: its selector, file system and name."""
    own = f"{volume['scheme']}{volume['partition'] or ''}"
    return ": ".join(x for x in (own, volume["filesystem"] or "unknown", volume["name"]) if x)


def default_volume(found: list):
    """The first volume with a known file system, or None."""
    return next((v for v in found if v["filesystem"]), None)


VOLUME = "path string, scheme string, partition int, offset long, length long, partition_type string, name string, filesystem string, diagnostic string"


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """VOLUME rows of every image under a path, in whatever container, one task per image."""
    files = spark.createDataFrame(listed(spark, path), "path string, size long")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.path, *v) for r in pdf.itertuples(index=False) for v in volumes_of(container(Image(r.path, r.size))[1])]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in VOLUME.split(", ")])

    return files.repartition(files.count()).mapInPandas(probe, VOLUME)


def selected(found: list, selector: str | None) -> object:
    """The volume that a selector such as `gpt2` or `raw` names, whatever its case; without one the only supported."""
    if selector is None:
        fit = [v for v in found if v["filesystem"]]
    else:
        fit = [v for v in found if f"{v['scheme']}{v['partition'] or ''}".lower() == selector.lower()]
    if len(fit) != 1:
        raise PartitionError(f"{len(fit)} volumes fit")
    return fit[0]
