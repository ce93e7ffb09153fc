"""Byte sources with positioned reads: files, windows, disk containers and replayed objects, one on top of another.

A source has a size and reads exactly the bytes asked for, or fails. Sources hold places, not data, so that they travel
to executors and each task reads its own part.
"""

from __future__ import annotations

import io
import struct
import zlib
from bisect import bisect_right
from typing import NamedTuple

import zstandard

from tidelog.functions import aes, codecs, wire
from tidelog.sources.ranges import opened


class ImageError(ValueError):
    """A source that breaks its format, or a read beyond its end."""


class Source:
    size: int

    def fetch(self, at: int, n: int) -> bytes:
        raise NotImplementedError

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ImageError(f"bytes {at} to {at + n} of {self.size}")
        data = self.fetch(at, n) if n else b""
        if len(data) != n:
            raise ImageError(f"{len(data)} of {n} bytes at {at}")
        return data

    def window(self, at: int, n: int) -> Source:
        if at < 0 or n < 0 or at + n > self.size:
            raise ImageError(f"a window from {at} to {at + n} of {self.size}")
        return Window(self, at, n)


class Image(Source):
    """A file, or a part of it."""

    def __init__(self, path: str, size: int, start: int = 0):
        self.path, self.size, self.start, self._file = path, size, start, None

    def fetch(self, at: int, n: int) -> bytes:
        if self._file is None:
            self._file = opened(self.path)
        self._file.seek(self.start + at)
        return self._file.read(n)

    def window(self, at: int, n: int) -> Image:
        super().window(at, n)
        return Image(self.path, n, self.start + at)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_file": None}


class Window(Source):
    def __init__(self, source: Source, start: int, size: int):
        self.source, self.start, self.size = source, start, size

    def fetch(self, at: int, n: int) -> bytes:
        return self.source.read(self.start + at, n)


class Cursor(io.RawIOBase):
    """A seekable file over a source."""

    def __init__(self, source: Source):
        self.source, self.at = source, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.at, self.source.size)[whence]
        if to < 0:
            raise ImageError("a seek to before the start")
        self.at = to
        return to

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.source.size - self.at))
        buffer[:n] = self.source.read(self.at, n) if n else b""
        self.at += n
        return n


class Sectors(Source):
    """An image whose sectors of 512 bytes are sealed each for itself under a key of 64 bytes."""

    def __init__(self, source: Source, key: bytes):
        if not source.size or source.size % 512:
            raise ImageError("a sealed image of no whole sectors")
        self.source, self.key, self.size = source, key, source.size

    def fetch(self, at: int, n: int) -> bytes:
        first, end = at // 512, -(-(at + n) // 512)
        data = aes.xts(self.key, self.source.read(first * 512, (end - first) * 512), first)
        return data[at - first * 512 :][:n]


class Mapped(Source):
    """A source made of units of one length, each somewhere below it or nowhere (zeros)."""

    unit: int

    def piece(self, k: int, at: int, n: int) -> bytes:
        """n bytes from place `at` of unit k on."""
        raise NotImplementedError

    def fetch(self, at: int, n: int) -> bytes:
        out = []
        while n:
            k, off = divmod(at, self.unit)
            take = min(n, self.unit - off)
            out.append(self.piece(k, off, take))
            at, n = at + take, n - take
        return b"".join(out)


class Qcow2(Mapped):
    """A QCOW2 image, version 2 or 3, that stands for itself: no backing file, encryption or external data."""

    def __init__(self, source: Source):
        head = source.read(0, min(112, source.size)).ljust(112, b"\0")
        if head[:4] != b"QFI\xfb":
            raise ImageError("no QCOW2 image")
        version, backing, _, bits, size, crypt, entries, table = struct.unpack_from(">IQIIQIIQ", head, 4)
        if version not in (2, 3):
            raise ImageError(f"QCOW version {version}")
        features = struct.unpack_from(">Q", head, 72)[0] if version == 3 else 0
        if backing or crypt or features & ~0b1011 or not 9 <= bits <= 21 or entries > 1 << 22:
            raise ImageError("a QCOW2 image with a backing file, encryption or features that are not supported")
        self.zstd = bool(features & 8) and head[104] == 1
        self.source, self.size, self.unit, self.bits = source, size, 1 << bits, bits
        if entries << (2 * bits - 3) < size:
            raise ImageError("the QCOW2 tables do not cover the disk")
        self.first = struct.unpack(f">{entries}Q", source.read(table, 8 * entries))
        self._second: tuple[int, tuple[int, ...]] = (-1, ())
        self._unpacked: tuple[int, bytes] = (-1, b"")

    def piece(self, k: int, at: int, n: int) -> bytes:
        top, low = divmod(k, self.unit // 8)
        place = self.first[top] & 0x00FFFFFFFFFFFE00
        if not place:
            return bytes(n)
        if self._second[0] != place:
            self._second = place, struct.unpack(f">{self.unit // 8}Q", self.source.read(place, self.unit))
        word = self._second[1][low]
        if word >> 62 & 1:
            if self._unpacked[0] != word:
                self._unpacked = word, self._unpack(word)
            return self._unpacked[1][at : at + n]
        place = word & 0x00FFFFFFFFFFFE00
        return bytes(n) if word & 1 or not place else self.source.read(place + at, n)

    def _unpack(self, word: int) -> bytes:
        x = 62 - (self.bits - 8)
        place = word & (1 << x) - 1
        length = (word >> x & (1 << self.bits - 8) - 1) * 512 + 512 - place % 512
        data = self.source.read(place, min(length, self.source.size - place))
        out = zstandard.ZstdDecompressor().decompressobj().decompress(data) if self.zstd else zlib.decompressobj(-15).decompress(data, self.unit)
        if len(out) != self.unit:
            raise ImageError("a compressed cluster of the wrong length")
        return out


class Vmdk(Mapped):
    """A sparse VMDK extent that stands for itself, with plain or compressed grains."""

    def __init__(self, source: Source):
        head = source.read(0, 512)
        if head[:4] != b"KDMV":
            raise ImageError("no VMDK extent")
        version, self.flags, capacity, grain, descriptor, described, per, _, table = struct.unpack_from("<IIQQQQIQQ", head, 4)
        if table == (1 << 64) - 1:  # the header's copy at the end knows better
            foot = source.read(source.size - 1024, 512)
            table = struct.unpack_from("<Q", foot, 56)[0] if foot[:4] == b"KDMV" else table
        if version not in (1, 2, 3) or not capacity or not grain or grain & (grain - 1) or grain > 1 << 16 or not 0 < per <= 1 << 16:
            raise ImageError("the VMDK header's numbers are out of range")
        if described and b"createType" in (text := source.read(descriptor * 512, min(described, 128) * 512)) and b'"monolithicSparse"' not in text and b'"streamOptimized"' not in text:
            raise ImageError("a VMDK whose data stands in other files")
        self.source, self.size, self.unit, self.per = source, capacity * 512, grain * 512, per
        count = -(-capacity // (grain * per))
        if count > 1 << 22:
            raise ImageError("a VMDK directory of that many tables")
        self.first = struct.unpack(f"<{count}I", source.read(table * 512, 4 * count))
        self._second: tuple[int, tuple[int, ...]] = (-1, ())
        self._unpacked: tuple[int, bytes] = (-1, b"")

    def piece(self, k: int, at: int, n: int) -> bytes:
        top, low = divmod(k, self.per)
        place = self.first[top]
        if not place:
            return bytes(n)
        if self._second[0] != place:
            self._second = place, struct.unpack(f"<{self.per}I", self.source.read(place * 512, 4 * self.per))
        place = self._second[1][low]
        if place == 0 or (place == 1 and self.flags & 4):
            return bytes(n)
        if not self.flags & 1 << 16:
            return self.source.read(place * 512 + at, n)
        if self._unpacked[0] != place:
            (size,) = struct.unpack("<I", self.source.read(place * 512 + 8, 4))
            data = zlib.decompressobj().decompress(self.source.read(place * 512 + 12, size), self.unit)
            self._unpacked = place, data.ljust(self.unit, b"\0")
        return self._unpacked[1][at : at + n]


def container(source: Source) -> tuple[str, Source]:
    """What a source is, by its first bytes, and the disk that it holds: qcow2, vmdk or raw."""
    head = source.read(0, min(512, source.size))
    if head[:4] == b"QFI\xfb":
        return "qcow2", Qcow2(source)
    if head[:4] == b"KDMV":
        return "vmdk", Vmdk(source)
    if head.startswith(b"# Disk DescriptorFile") or b"createType" in head:
        raise ImageError("a VMDK descriptor whose data stands in other files")
    return "raw", source


class Segment(NamedTuple):
    """Bytes lo to hi of an object, shown by the write that begins at `begins`, whose payload stands at a place."""

    lo: int
    hi: int
    begins: int
    path: str
    at: int
    payload_length: int
    how: str
    codec: int
    etype: int
    logical: int
    packed: int
    window: int
    crc: int | None


class Replayed(Source):
    """An object of a change stream as it stands after replay: payloads are decoded when they are read.

    A payload that is not what it was when the map was made is an error. One decoded payload is kept.
    """

    def __init__(self, size: int, segments: list[Segment]):
        self.size, self.segments = size, sorted(segments)
        self.starts = [s.lo for s in self.segments]
        self._last: tuple[tuple, bytes] = ((), b"")

    def _decoded(self, s: Segment) -> bytes:
        key = s.path, s.at
        if self._last[0] != key:
            with opened(s.path) as f:
                f.seek(s.at + wire.RECORD)
                body = f.read(s.payload_length)
            if s.crc is not None and zlib.crc32(body) != s.crc:
                raise ImageError(f"the payload at {s.at} of {s.path} has changed")
            if s.how == "WRITE_EMBEDDED":
                data = codecs.decode_embedded(s.etype, s.codec, body, s.logical, s.packed)
            else:
                data = codecs.decode(codecs.name_of(s.codec, replay=True), body, s.window)
            self._last = key, data
        return self._last[1]

    def fetch(self, at: int, n: int) -> bytes:
        out = bytearray(n)
        for k in range(max(0, bisect_right(self.starts, at) - 1), len(self.segments)):
            s = self.segments[k]
            if s.lo >= at + n:
                break
            lo, hi = max(at, s.lo), min(at + n, s.hi)
            if lo < hi:
                out[lo - at : hi - at] = self._decoded(s)[lo - s.begins : hi - s.begins]
        return bytes(out)


class Extent(NamedTuple):
    """Bytes of a file: where they begin in it, where they stand in the volume (-1: zeros), how many, or themselves."""

    lo: int
    at: int
    length: int
    data: bytes | None = None


class FileBytes(Source):
    """A file of a volume as a source."""

    def __init__(self, volume: Source, size: int, extents: list[Extent]):
        self.volume, self.size, self.extents = volume, size, sorted(extents, key=lambda e: e.lo)
        self.starts = [e.lo for e in self.extents]

    def fetch(self, at: int, n: int) -> bytes:
        out = bytearray(n)
        for k in range(max(0, bisect_right(self.starts, at) - 1), len(self.extents)):
            e = self.extents[k]
            if e.lo >= at + n:
                break
            lo, hi = max(at, e.lo), min(at + n, e.lo + e.length)
            if lo < hi and (e.data is not None or e.at >= 0):
                out[lo - at : hi - at] = e.data[lo - e.lo : hi - e.lo] if e.data is not None else self.volume.read(e.at + lo - e.lo, hi - lo)
        return bytes(out)
