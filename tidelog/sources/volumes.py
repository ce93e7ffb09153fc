"""File systems within a volume: FAT and exFAT, NTFS, ext2 to ext4. Read only; nothing is replayed or repaired.

Each has a root, entries(node) in its own order, find(node, name) and extents(node): where a file's bytes stand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from tidelog.functions.text import inner_parts
from tidelog.sources.images import Extent, FileBytes, ImageError, Source

DIRECTORY, FILE, LINK, OTHER = 4, 8, 10, 0
MOST_DIRECTORY = 64 << 20


class VolumeError(ValueError):
    """A file system that breaks its format, or a file that it cannot give."""


class NotFound(VolumeError):
    """No such path."""


class Node(NamedTuple):
    """A file or directory: its number, name, kind and size, and what its file system needs to find its bytes."""

    number: int
    name: str
    kind: int
    size: int
    place: tuple = ()


class FileSystem:
    name: str
    root: Node

    def __init__(self, source: Source):
        self.source = source

    def entries(self, node: Node) -> list[Node]:
        raise NotImplementedError

    def extents(self, node: Node) -> list[Extent]:
        raise NotImplementedError

    def find(self, node: Node, name: str) -> Node:
        found = [n for n in self.entries(node) if n.name == name]
        if not found:
            raise NotFound(name)
        return found[0]

    def resolve(self, path: str) -> Node:
        node = self.root
        for part in inner_parts(path):
            if node.kind != DIRECTORY:
                raise NotFound(f"{path}: {node.name} is no directory")
            try:
                node = self.find(node, part)
            except NotFound:
                raise NotFound(f"no {path} in the volume") from None
        return node

    def listed(self, path: str) -> list[Node]:
        node = self.resolve(path)
        if node.kind != DIRECTORY:
            raise VolumeError(f"{path} is no directory")
        return self.entries(node)

    def file(self, path: str) -> tuple[Node, list[Extent]]:
        node = self.resolve(path)
        if node.kind != FILE:
            raise VolumeError(f"{path} is no regular file")
        size, extents = self.sized(node)
        return node._replace(size=size), extents

    def sized(self, node: Node) -> tuple[int, list[Extent]]:
        """A node's length, as its own record has it, and its extents."""
        return node.size, self.extents(node)

    def bytes_of(self, node: Node) -> FileBytes:
        return FileBytes(self.source, *self.sized(node))


def joined(runs: Iterator[tuple[int, int, int]]) -> list[Extent]:
    """Extents of runs (lo, at, length), neighbours that stand one after another made one."""
    out: list[Extent] = []
    for lo, at, length in runs:
        last = out[-1] if out else None
        if last and last.lo + last.length == lo and (last.at + last.length == at if at >= 0 else last.at < 0):
            out[-1] = last._replace(length=last.length + length)
        else:
            out.append(Extent(lo, at, length))
    return out


class Fat(FileSystem):
    """FAT12, FAT16, FAT32 and exFAT. Names are found as they are, else whatever their case, also by their short form;
    a name that several entries then have is an error. Listings are by lower-cased name."""

    def __init__(self, source: Source):
        super().__init__(source)
        boot = source.read(0, 512)
        self.ex = boot[3:11] == b"EXFAT   "
        if self.ex:
            fat, _, heap, self.clusters, first = struct.unpack_from("<IIIII", boot, 80)
            sector, per = 1 << boot[108], 1 << boot[109]
            if not 9 <= boot[108] <= 12 or boot[108] + boot[109] > 25:
                raise VolumeError("an exFAT boot sector whose numbers are out of range")
            self.name, self.fat_at, self.data_at, self.unit = "exfat", fat * sector, heap * sector, sector * per
            self.width = 32
            self.root = Node(first, "", DIRECTORY, 0, (first, False))
            return
        sector, per, reserved, fats, roots, small = struct.unpack_from("<HBHBHH", boot, 11)
        fat16, large, fat32 = struct.unpack_from("<H", boot, 22)[0], *struct.unpack_from("<II", boot, 32)
        total, length = small or large, fat16 or fat32
        if sector not in (512, 1024, 2048, 4096) or not per or per & (per - 1) or not reserved or fats not in (1, 2) or not length:
            raise VolumeError("a FAT boot sector whose numbers are out of range")
        self.fat_at = reserved * sector
        self.root_at, self.root_size = self.fat_at + fats * length * sector, roots * 32
        data = reserved + fats * length + -(-roots * 32 // sector)
        self.clusters = (total - data) // per
        if self.clusters <= 0:
            raise VolumeError("a FAT volume without clusters")
        self.data_at, self.unit = data * sector, sector * per
        self.width = 12 if self.clusters < 4085 else 16 if self.clusters < 65525 else 32
        self.name = f"fat{self.width}"
        first = struct.unpack_from("<I", boot, 44)[0] if self.width == 32 else 0
        self.root = Node(first, "", DIRECTORY, 0, (first, False))

    def _next(self, cluster: int) -> int:
        if self.width == 12:
            (word,) = struct.unpack("<H", self.source.read(self.fat_at + cluster * 3 // 2, 2))
            return word >> 4 if cluster & 1 else word & 0xFFF
        if self.width == 16:
            return struct.unpack("<H", self.source.read(self.fat_at + 2 * cluster, 2))[0]
        return struct.unpack("<I", self.source.read(self.fat_at + 4 * cluster, 4))[0] & (0xFFFFFFFF if self.ex else 0x0FFFFFFF)

    def _chain(self, first: int, most: int | None) -> Iterator[int]:
        end = (1 << min(self.width, 28 if not self.ex else 32)) - 8
        cluster, seen = first, 0
        while 2 <= cluster < min(self.clusters + 2, end) and (most is None or seen < most):
            if seen > self.clusters:
                raise VolumeError("a chain of clusters that is a loop")
            yield cluster
            seen += 1
            cluster = self._next(cluster)
        if most is not None and seen < most:
            raise VolumeError(f"a chain of {seen} clusters, not {most}")

    def extents(self, node: Node) -> list[Extent]:
        first, whole = node.place
        if node.kind == DIRECTORY and not self.ex and self.width < 32 and node.number == 0:
            return [Extent(0, self.root_at, self.root_size)]
        count = -(-node.size // self.unit) if node.kind == FILE or node.size else None
        at = lambda c: self.data_at + (c - 2) * self.unit
        if whole:  # exFAT: clusters one after another, and no chain
            return [Extent(0, at(first), (count or 0) * self.unit)] if count else []
        return joined((k * self.unit, at(c), self.unit) for k, c in enumerate(self._chain(first, count)))

    def _raw(self, node: Node) -> bytes:
        found = self.extents(node)
        size = sum(e.length for e in found)
        if size > MOST_DIRECTORY:
            raise VolumeError("a directory that large")
        return b"".join(self.source.read(e.at, e.length) for e in found)

    def _all(self, node: Node) -> list[tuple[Node, str]]:
        return list(self._exfat(self._raw(node)) if self.ex else self._short(self._raw(node)))

    def _short(self, data: bytes) -> Iterator[tuple[Node, str]]:
        """Entries with their 8.3 names; long names stand in the entries before, last part first."""
        long: dict[int, bytes] = {}
        check = None
        for at in range(0, len(data) - 31, 32):
            e = data[at : at + 32]
            if e[0] == 0:
                return
            if e[0] == 0xE5:
                long = {}
                continue
            if e[11] & 0x3F == 0x0F:
                if e[0] & 0x40:
                    long, check = {}, e[13]
                if e[13] == check:
                    long[e[0] & 0x1F] = e[1:11] + e[14:26] + e[28:32]
                continue
            if e[11] & 0x08:
                long = {}
                continue
            raw = (b"\xe5" if e[0] == 5 else e[:1]) + e[1:11]
            stem, tail = (raw[:8].rstrip(b" ").decode("cp437"), raw[8:].rstrip(b" ").decode("cp437"))
            shown = (stem.lower() if e[12] & 8 else stem) + ("." + (tail.lower() if e[12] & 16 else tail) if tail else "")
            short = stem + ("." + tail if tail else "")
            total = 0
            for b in e[:11]:
                total = ((total >> 1) + ((total & 1) << 7) + b) & 0xFF
            if long and check == total and sorted(long) == list(range(1, len(long) + 1)):
                shown = b"".join(long[k] for k in sorted(long)).decode("utf-16-le", "replace").split("\0")[0]
            long = {}
            if short in (".", ".."):
                continue
            low, size = struct.unpack_from("<HI", e, 26)
            first = low | (struct.unpack_from("<H", e, 20)[0] << 16 if self.width == 32 else 0)
            folder = bool(e[11] & 0x10)
            yield Node(first, shown, DIRECTORY if folder else FILE, 0 if folder else size, (first, False)), short

    def _exfat(self, data: bytes) -> Iterator[tuple[Node, str]]:
        at = 0
        while at + 32 <= len(data) and data[at]:
            if data[at] != 0x85:
                at += 32
                continue
            more = data[at + 1]
            stream = data[at + 32 : at + 64]
            if len(stream) == 32 and stream[0] == 0xC0:
                (first,), (size,) = struct.unpack_from("<I", stream, 20), struct.unpack_from("<Q", stream, 24)
                names = [data[at + 32 * k : at + 32 * k + 32] for k in range(2, more + 1)]
                name = b"".join(n[2:] for n in names if n[:1] == b"\xc1").decode("utf-16-le", "replace")[: stream[3]]
                folder = bool(struct.unpack_from("<H", data, at + 4)[0] & 0x10)
                yield Node(first, name, DIRECTORY if folder else FILE, size, (first, bool(stream[1] & 2))), name
            at += 32 * (more + 1)

    def entries(self, node: Node) -> list[Node]:
        return sorted((n for n, _ in self._all(node)), key=lambda n: n.name.lower())

    def find(self, node: Node, name: str) -> Node:
        found = self._all(node)
        exact = [n for n, _ in found if n.name == name]
        folded = [n for n, short in found if name.lower() in (n.name.lower(), short.lower())]
        if exact:
            return exact[0]
        if len(folded) > 1:
            raise VolumeError(f"several entries are called {name}")
        if not folded:
            raise NotFound(name)
        return folded[0]


class Ext(FileSystem):
    """ext2, ext3 and ext4. Links are entries of their own and are never followed. Listings are by name."""

    # Incompatible features that reading can do with: file types, recovery, extents, 64-bit, flexible
    # groups, checksum seeds and large directories.
    FINE = 0x2 | 0x4 | 0x40 | 0x80 | 0x200 | 0x2000 | 0x4000

    def __init__(self, source: Source):
        super().__init__(source)
        s = source.read(1024, 1024)
        if s[56:58] != b"\x53\xef":
            raise VolumeError("no ext superblock")
        (shift,), (self.first,) = struct.unpack_from("<I", s, 24), struct.unpack_from("<I", s, 20)
        (self.per,), (self.inodes,) = struct.unpack_from("<I", s, 40), struct.unpack_from("<I", s)
        (revision,), (features,) = struct.unpack_from("<I", s, 76), struct.unpack_from("<I", s, 96)
        if features & ~self.FINE or shift > 6 or not self.per:
            raise VolumeError(f"an ext file system with features {features & ~self.FINE:#x}")
        self.block = 1024 << shift
        self.inode_size = struct.unpack_from("<H", s, 88)[0] if revision else 128
        self.wide = bool(features & 0x80)
        self.group = max(32, struct.unpack_from("<H", s, 254)[0]) if self.wide else 32
        self.name = "ext4" if features & 0x40 else "ext2"
        self.root = self._node(2, "")

    def _inode(self, number: int) -> bytes:
        if not 1 <= number <= self.inodes:
            raise VolumeError(f"inode {number} is out of range")
        group, k = divmod(number - 1, self.per)
        at = (self.first + 1) * self.block + group * self.group
        table = struct.unpack("<I", self.source.read(at + 8, 4))[0]
        if self.wide and self.group >= 64:
            table |= struct.unpack("<I", self.source.read(at + 40, 4))[0] << 32
        return self.source.read(table * self.block + k * self.inode_size, 128)

    def _node(self, number: int, name: str) -> Node:
        raw = self._inode(number)
        (mode,) = struct.unpack_from("<H", raw)
        kind = {0x4000: DIRECTORY, 0x8000: FILE, 0xA000: LINK}.get(mode & 0xF000, OTHER)
        size = struct.unpack_from("<I", raw, 4)[0] | (struct.unpack_from("<I", raw, 108)[0] << 32 if kind in (FILE, DIRECTORY) else 0)
        return Node(number, name, kind, size, (raw,))

    def extents(self, node: Node) -> list[Extent]:
        raw = node.place[0]
        flags, words = struct.unpack_from("<I", raw, 32)[0], raw[40:100]
        if flags & 0x10000000:
            raise VolumeError("a file within its inode")
        if flags & 0x800:
            raise VolumeError("an encrypted file")
        runs = self._tree(words, 0) if flags & 0x80000 else self._pointers(words, -(-node.size // self.block))
        return joined(sorted(runs))

    def _tree(self, data: bytes, depth: int) -> Iterator[tuple[int, int, int]]:
        magic, count, _, level = struct.unpack_from("<HHHH", data)
        if magic != 0xF30A or depth > 5 or 12 + 12 * count > len(data):
            raise VolumeError("a broken tree of extents")
        for k in range(count):
            at = 12 + 12 * k
            if level:
                _, low, high = struct.unpack_from("<IIH", data, at)
                yield from self._tree(self.source.read((low | high << 32) * self.block, self.block), depth + 1)
            else:
                first, length, high, low = struct.unpack_from("<IHHI", data, at)
                fresh = length > 32768  # not written yet: zeros
                yield first * self.block, -1 if fresh else (low | high << 32) * self.block, (length - 32768 if fresh else length) * self.block

    def _pointers(self, words: bytes, blocks: int) -> Iterator[tuple[int, int, int]]:
        per = self.block // 4
        place = 0

        def down(pointer: int, level: int) -> Iterator[tuple[int, int, int]]:
            nonlocal place
            if place >= blocks:
                return
            if not pointer:
                place += per**level
            elif level == 0:
                yield place * self.block, pointer * self.block, self.block
                place += 1
            else:
                for p in struct.unpack(f"<{per}I", self.source.read(pointer * self.block, self.block)):
                    yield from down(p, level - 1)

        for k, pointer in enumerate(struct.unpack("<15I", words)):
            yield from down(pointer, max(0, k - 11))

    def entries(self, node: Node) -> list[Node]:
        if node.size > MOST_DIRECTORY:
            raise VolumeError("a directory that large")
        data, out, at = self.bytes_of(node).read(0, node.size), [], 0
        while at + 8 <= len(data):
            number, length, size = struct.unpack_from("<IHB", data, at)
            if length < 8 or at + length > len(data):
                raise VolumeError("a broken directory")
            name = data[at + 8 : at + 8 + size]
            if number and name not in (b".", b"..") and size:
                try:
                    out.append(self._node(number, name.decode()))
                except UnicodeDecodeError:
                    raise VolumeError(f"a name that is no UTF-8: {name!r}") from None
            at += length
        return sorted(out, key=lambda n: n.name.encode())


class Ntfs(FileSystem):
    """NTFS. Names are found whatever their case, by the volume's own table. Listings are in the order of the index."""

    DATA, ROOT, ALLOCATION, LIST = 0x80, 0x90, 0xA0, 0x20

    def __init__(self, source: Source):
        super().__init__(source)
        boot = source.read(0, 512)
        if boot[3:11] != b"NTFS    ":
            raise VolumeError("no NTFS boot sector")
        self.sector, per = struct.unpack_from("<HB", boot, 11)
        self.unit = self.sector * (per if per < 0x80 else 1 << (256 - per))
        size = lambda b: self.unit * b if b < 0x80 else 1 << (256 - b)
        self.record, self.index = size(boot[64]), size(boot[68])
        if self.sector not in (512, 1024, 2048, 4096) or not self.unit or not 256 <= self.record <= 65536 or not 512 <= self.index <= 1 << 20:
            raise VolumeError("an NTFS boot sector whose numbers are out of range")
        self.name = "ntfs"
        at = struct.unpack_from("<Q", boot, 48)[0] * self.unit
        self.mft = FileBytes(source, self.record * 16, [Extent(0, at, self.record * 16)])
        head = self._attributes(0)
        runs = self._runs(head, self.DATA, "")
        self.mft = FileBytes(source, runs[1], runs[0])
        case = self._runs(self._attributes(10), self.DATA, "")
        table = FileBytes(source, case[1], case[0]).read(0, min(case[1], 131072))
        self.upper = struct.unpack(f"<{len(table) // 2}H", table)
        self.root = Node(5, "", DIRECTORY, 0)

    def _fixed(self, data: bytes, mark: bytes) -> bytes:
        """A record with the ends of its sectors put back."""
        if data[:4] != mark:
            raise VolumeError(f"no {mark.decode()} record")
        at, count = struct.unpack_from("<HH", data, 4)
        out = bytearray(data)
        for k in range(1, count):
            end = k * 512 - 2
            if end + 2 > len(out) or at + 2 * k + 2 > len(data) or out[end : end + 2] != data[at : at + 2]:
                raise VolumeError("a record that was only written in part")
            out[end : end + 2] = data[at + 2 * k : at + 2 * k + 2]
        return bytes(out)

    def _own(self, number: int) -> tuple[int, list[tuple[int, str, bytes]]]:
        """A record's flags and its attributes: type, name, bytes."""
        data = self._fixed(self.mft.read(number * self.record, self.record), b"FILE")
        at, flags = struct.unpack_from("<HH", data, 20)
        out = []
        while at + 8 <= len(data):
            kind, length = struct.unpack_from("<II", data, at)
            if kind == 0xFFFFFFFF:
                break
            if length < 16 or at + length > len(data):
                raise VolumeError("a broken attribute")
            a = data[at : at + length]
            name_at = struct.unpack_from("<H", a, 10)[0]
            out.append((kind, a[name_at : name_at + 2 * a[9]].decode("utf-16-le", "replace"), a))
            at += length
        return flags, out

    def _attributes(self, number: int) -> list[tuple[int, str, bytes]]:
        """All attributes of a file, those in further records too."""
        _, own = self._own(number)
        listed = next((a for kind, _, a in own if kind == self.LIST), None)
        if listed is None:
            return own
        if listed[8]:
            runs, size = self._joined([listed])
            data = FileBytes(self.source, size, runs).read(0, size)
        else:
            data = self._resident(listed)
        more, at = {number}, 0
        while at + 26 <= len(data):
            length = struct.unpack_from("<H", data, at + 4)[0]
            if length < 26:
                raise VolumeError("a broken list of attributes")
            more.add(struct.unpack_from("<Q", data, at + 16)[0] & (1 << 48) - 1)
            at += length
        return [*own, *[a for m in sorted(more - {number}) for a in self._own(m)[1]]]

    @staticmethod
    def _resident(a: bytes) -> bytes:
        length, at = struct.unpack_from("<IH", a, 16)
        return a[at : at + length]

    def _joined(self, parts: list[bytes]) -> tuple[list[Extent], int]:
        """Extents and length of an attribute that stands outside its record, in one or several parts."""
        parts = sorted(parts, key=lambda a: struct.unpack_from("<Q", a, 16)[0])
        (size,), (valid,) = struct.unpack_from("<Q", parts[0], 48), struct.unpack_from("<Q", parts[0], 56)

        def runs() -> Iterator[tuple[int, int, int]]:
            for a in parts:
                lo = struct.unpack_from("<Q", a, 16)[0] * self.unit
                at, cluster = struct.unpack_from("<H", a, 32)[0], 0
                while at < len(a) and a[at]:
                    n, m = a[at] & 15, a[at] >> 4
                    length = int.from_bytes(a[at + 1 : at + 1 + n], "little") * self.unit
                    step = int.from_bytes(a[at + 1 + n : at + 1 + n + m], "little", signed=True)
                    cluster += step
                    if lo < valid:
                        shown = min(length, valid - lo)
                        yield lo, cluster * self.unit if m else -1, shown
                        if shown < length:
                            yield lo + shown, -1, length - shown
                    else:
                        yield lo, -1, length
                    lo, at = lo + length, at + 1 + n + m

        return joined(runs()), size

    def _runs(self, attributes: list[tuple[int, str, bytes]], kind: int, name: str) -> tuple[list[Extent], int]:
        own = [a for k, n, a in attributes if k == kind and n == name]
        if not own:
            raise VolumeError("no data of that name")
        flags = struct.unpack_from("<H", own[0], 12)[0]
        if flags & 0x4000:
            raise VolumeError("an encrypted file")
        if flags & 0xFF:
            raise VolumeError("a compressed file")
        if own[0][8]:
            return self._joined(own)
        data = self._resident(own[0])
        return [Extent(0, -1, len(data), data)], len(data)

    def extents(self, node: Node) -> list[Extent]:
        return self.sized(node)[1]

    def sized(self, node: Node) -> tuple[int, list[Extent]]:
        extents, size = self._runs(self._attributes(node.number), self.DATA, "")
        return size, extents

    def entries(self, node: Node) -> list[Node]:
        attributes = self._attributes(node.number)
        top = next((self._resident(a) for k, n, a in attributes if k == self.ROOT and n == "$I30"), None)
        if top is None:
            raise VolumeError("a directory without an index")
        blocks = None
        if any(k == self.ALLOCATION and n == "$I30" for k, n, _ in attributes):
            runs, size = self._runs(attributes, self.ALLOCATION, "$I30")
            blocks = FileBytes(self.source, size, runs)
        step = self.unit if self.unit <= self.index else 512
        seen: set[int] = set()

        def walk(data: bytes, head: int) -> Iterator[Node]:
            at, end = head + struct.unpack_from("<I", data, head)[0], head + struct.unpack_from("<I", data, head + 4)[0]
            while at + 16 <= min(end, len(data)):
                ref, length, _, flags = struct.unpack_from("<QHHI", data, at)
                if length < 16:
                    raise VolumeError("a broken index")
                if flags & 1:
                    below = struct.unpack_from("<Q", data, at + length - 8)[0]
                    if blocks is None or below in seen:
                        raise VolumeError("a broken index")
                    seen.add(below)
                    yield from walk(self._fixed(blocks.read(below * step, self.index), b"INDX"), 24)
                if flags & 2:
                    return
                key = data[at + 16 : at + length]
                name = key[66 : 66 + 2 * key[64]].decode("utf-16-le", "replace")
                folder = bool(struct.unpack_from("<I", key, 56)[0] & 0x10000000)
                if name not in (".", ".."):
                    yield Node(ref & (1 << 48) - 1, name, DIRECTORY if folder else FILE, 0 if folder else struct.unpack_from("<Q", key, 48)[0])
                at += length

        return list(walk(top, 16))

    def _folded(self, name: str) -> tuple[int, ...]:
        raw = name.encode("utf-16-le")
        return tuple(self.upper[u] if u < len(self.upper) else u for u in struct.unpack(f"<{len(raw) // 2}H", raw))

    def find(self, node: Node, name: str) -> Node:
        folded = self._folded(name)
        found = [n for n in self.entries(node) if self._folded(n.name) == folded]
        if not found:
            raise NotFound(name)
        return next((n for n in found if n.name == name), found[0])


def opened(source: Source, kind: str) -> FileSystem:
    """The file system of a volume that was found to be of a kind."""
    if kind == "ntfs":
        return Ntfs(source)
    if kind.startswith("ext") or kind == "exfat" or kind.startswith("fat"):
        return Fat(source) if kind == "exfat" or kind.startswith("fat") else Ext(source)
    raise VolumeError(f"no reader for {kind}")


def probed(source: Source, kind: str | None) -> tuple[str | None, str | None]:
    """The file system that opens, and why one that was announced does not."""
    if kind is None:
        return None, "no known file system"
    try:
        return opened(source, kind).name, None
    except (VolumeError, ImageError, struct.error) as e:
        return None, f"invalid {kind}: {e}"


def path_id(path: str) -> int:
    """A number for a path, for display only: the 64-bit FNV-1a hash of its bytes."""
    out = 0xCBF29CE484222325
    for b in path.encode():
        out = (out ^ b) * 0x100000001B3 & (1 << 64) - 1
    return out
