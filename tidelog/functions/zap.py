"""Attribute tables of the on-disk format: names and numbers of one object's bytes, small (one block) or large."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Block kinds, magic numbers and chunk kinds of the format.
LEAF, HEADER, MICRO = 1 << 63, (1 << 63) + 1, (1 << 63) + 3
HEADER_MAGIC, LEAF_MAGIC = 0x2F52AB2AB, 0x2AB1EAF
ENTRY, ARRAY = 252, 251
MICRO_ENTRY, CHUNK, ARRAY_BYTES, LEAF_HEAD = 64, 24, 21, 48
NO_CHUNK = 0xFFFF
#: Bytes that a table may have.
MOST = 64 << 20

Entry = tuple[str, int, list[int]]


class TableError(ValueError):
    """An attribute table that breaks its format."""


def parsed(data: bytes, block: int = 0) -> list[Entry]:
    """(name, bytes of a number, numbers) of a table in its stored order; block: bytes of its blocks, if known."""
    if len(data) > MOST:
        raise TableError(f"a table of {len(data)} bytes")
    if len(data) < 8:
        raise TableError("a table without a header")
    (kind,) = struct.unpack_from("<Q", data)
    if kind == MICRO:
        return list(_micro(data))
    if kind == HEADER:
        return list(_large(data, block))
    raise TableError(f"no attribute table: block kind {kind:#x}")


def _micro(data: bytes) -> Iterator[Entry]:
    for at in range(MICRO_ENTRY, len(data) - MICRO_ENTRY + 1, MICRO_ENTRY):
        name = data[at + 14 : at + MICRO_ENTRY].split(b"\0")[0]
        if name:
            yield name.decode("utf-8", "replace"), 8, [*struct.unpack_from("<Q", data, at)]


def _large(data: bytes, block: int) -> Iterator[Entry]:
    """The header's block names the format; every other block that begins as a leaf is one."""
    if len(data) < 72 or struct.unpack_from("<Q", data, 8)[0] != HEADER_MAGIC:
        raise TableError("a large table without its magic number")
    step = block or next((1 << s for s in range(10, 25) if 1 << s < len(data) and struct.unpack_from("<Q", data, 1 << s)[0] == LEAF and struct.unpack_from("<I", data, (1 << s) + 24)[0] == LEAF_MAGIC), 0)
    if not step:
        return
    for at in range(step, len(data) - step + 1, step):
        if struct.unpack_from("<Q", data, at)[0] == LEAF and struct.unpack_from("<I", data, at + 24)[0] == LEAF_MAGIC:
            yield from _leaf(data[at : at + step])


def _leaf(leaf: bytes) -> Iterator[Entry]:
    """Chunks follow the header and a hash table of one 16-bit word per 32 bytes of the leaf."""
    first = LEAF_HEAD + 2 * (len(leaf) // 32)
    chunks = (len(leaf) - first) // CHUNK

    def joined(chunk: int, size: int) -> bytes:
        out, seen = bytearray(), 0
        while len(out) < size:
            at = first + chunk * CHUNK
            if chunk >= chunks or leaf[at] != ARRAY or seen > chunks:
                raise TableError("a broken chain of chunks")
            out += leaf[at + 1 : at + 1 + ARRAY_BYTES]
            (chunk,) = struct.unpack_from("<H", leaf, at + 1 + ARRAY_BYTES)
            seen += 1
        return bytes(out[:size])

    for k in range(chunks):
        at = first + k * CHUNK
        if leaf[at] != ENTRY:
            continue
        width, _, name_at, name_n, value_at, value_n = struct.unpack_from("<BHHHHH", leaf, at + 1)
        if width not in (1, 2, 4, 8):
            raise TableError(f"numbers of {width} bytes")
        name = joined(name_at, name_n).split(b"\0")[0].decode("utf-8", "replace")
        value = joined(value_at, value_n * width)
        yield name, width, [int.from_bytes(value[i : i + width], "big") for i in range(0, len(value), width)]


def micro(entries: dict[str, int]) -> bytes:
    """A small table."""
    out = bytearray(struct.pack("<Q", MICRO).ljust(MICRO_ENTRY, b"\0"))
    for name, value in entries.items():
        raw = name.encode()
        if len(raw) > 49:
            raise TableError("a name too long for a small table")
        out += struct.pack("<QIH", value, 0, 0) + raw.ljust(50, b"\0")
    return bytes(out).ljust(-(-len(out) // 512) * 512, b"\0")


def large(entries: dict[str, tuple[int, list[int]]], block: int = 16384) -> bytes:
    """A large table of (bytes of a number, numbers); as many leaves as it takes."""
    head = bytearray(block)
    struct.pack_into("<QQ", head, 0, HEADER, HEADER_MAGIC)
    first = LEAF_HEAD + 2 * (block // 32)
    room = (block - first) // CHUNK
    leaves: list[bytearray] = []
    used = room
    for name, (width, numbers) in entries.items():
        raw, value = name.encode() + b"\0", b"".join(n.to_bytes(width, "big") for n in numbers)
        need = 1 + -(-len(raw) // ARRAY_BYTES) + -(-len(value) // ARRAY_BYTES)
        if used + need > room:
            leaf = bytearray(block)
            struct.pack_into("<QQQI", leaf, 0, LEAF, 0, 0, LEAF_MAGIC)
            for k in range(room):
                leaf[first + k * CHUNK] = 253
            leaves.append(leaf)
            used = 0
        leaf, entry = leaves[-1], used
        used += 1
        starts = []
        for part in (raw, value):
            starts.append(used if part else NO_CHUNK)
            for i in range(0, len(part), ARRAY_BYTES):
                at = first + used * CHUNK
                leaf[at] = ARRAY
                leaf[at + 1 : at + 1 + ARRAY_BYTES] = part[i : i + ARRAY_BYTES].ljust(ARRAY_BYTES, b"\0")
                used += 1
                struct.pack_into("<H", leaf, at + 1 + ARRAY_BYTES, used if i + ARRAY_BYTES < len(part) else NO_CHUNK)
        struct.pack_into("<BBHHHHH", leaf, first + entry * CHUNK, ENTRY, width, NO_CHUNK, starts[0], len(raw), starts[1], len(numbers))
    return bytes(head) + b"".join(map(bytes, leaves))
