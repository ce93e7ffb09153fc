"""File attributes in an object's bonus and spill: the registry names them, a layout gives their order."""

from __future__ import annotations

import struct
from typing import NamedTuple

# Bonus types, and the magic number of an attribute header.
LAID_OUT, FIXED = 44, 17
MAGIC = 0x2F505A
# Byte offsets of attributes in the older, fixed form.
FIXED_AT = {"atime": 0, "mtime": 16, "ctime": 32, "crtime": 48, "gen": 64, "mode": 72, "size": 80, "parent": 88, "links": 96, "flags": 120, "uid": 128, "gid": 136}
FIXED_SIZE_ENDS = 88
# Names of attributes in the registry.
NAMES = {"mode": "ZPL_MODE", "size": "ZPL_SIZE", "links": "ZPL_LINKS", "uid": "ZPL_UID", "gid": "ZPL_GID", "gen": "ZPL_GEN", "parent": "ZPL_PARENT", "flags": "ZPL_FLAGS", "atime": "ZPL_ATIME", "mtime": "ZPL_MTIME", "ctime": "ZPL_CTIME", "crtime": "ZPL_CRTIME"}
SHOWN = tuple(NAMES)


class Registry(NamedTuple):
    """name -> (id, bytes; 0 for a varying length), and layout -> ids in their order."""

    attributes: dict[str, tuple[int, int]]
    layouts: dict[int, list[int]]

    def length_of(self, number: int) -> int | None:
        return next((n for i, n in self.attributes.values() if i == number), None)


def registry(attributes: list[tuple[str, int]], layouts: list[tuple[str, list[int]]]) -> Registry:
    """From the rows of the two tables: an attribute's word holds its id (16 bits), byte order (8) and length (16)."""
    return Registry({name: (word & 0xFFFF, word >> 24 & 0xFFFF) for name, word in attributes}, {int(name): ids for name, ids in layouts if name.isdigit()})


def offsets(buffer: bytes, known: Registry) -> dict[int, int]:
    """Byte offset of each attribute of a buffer whose place is certain: those up to the first of a varying length."""
    if len(buffer) < 8:
        return {}
    (info,) = struct.unpack_from("<H", buffer, 4)
    at, out = (info >> 10) << 3, {}
    for number in known.layouts.get(info & 0x3FF, []):
        size = known.length_of(number)
        if size is None or at + size > len(buffer):
            break
        out[number] = at
        if size == 0:
            break
        at += size
    return out


def size_offset(bonus_type: int | None, buffer: bytes | None, known: Registry) -> int | None:
    """Where the size stands in a bonus."""
    if buffer is None or bonus_type is None:
        return None
    if bonus_type == FIXED:
        return FIXED_AT["size"] if len(buffer) >= FIXED_SIZE_ENDS else None
    if bonus_type != LAID_OUT or NAMES["size"] not in known.attributes:
        return None
    return offsets(buffer, known).get(known.attributes[NAMES["size"]][0])


def _read(buffer: bytes, at: int, name: str) -> int | None:
    return struct.unpack_from("<Q", buffer, at)[0] if at + 8 <= len(buffer) else None


def decoded(bonus_type: int | None, bonus: bytes | None, spill: bytes | None, known: Registry) -> dict[str, int | None] | None:
    """The attributes of an object, times as seconds; those in the spill take the place of those in the bonus. None if
    the bonus has no attributes of either form."""
    if bonus_type == FIXED and bonus is not None and len(bonus) >= FIXED_SIZE_ENDS:
        return {n: _read(bonus, FIXED_AT[n], n) for n in SHOWN}
    if bonus_type != LAID_OUT or bonus is None or len(bonus) < 8 or struct.unpack_from("<I", bonus)[0] != MAGIC:
        return None
    if struct.unpack_from("<H", bonus, 4)[0] & 0x3FF not in known.layouts:
        return None
    out: dict[str, int | None] = dict.fromkeys(SHOWN)
    for buffer in (bonus, spill):
        if buffer is None or len(buffer) < 8 or struct.unpack_from("<I", buffer)[0] != MAGIC:
            continue
        places = offsets(buffer, known)
        for name, stored in NAMES.items():
            number = known.attributes.get(stored, (None, 0))[0]
            if number in places:
                out[name] = _read(buffer, places[number], name)
    return out


def encoded(values: dict[str, int], layout: int, known: Registry) -> bytes:
    """A buffer in a layout whose attributes have fixed lengths; what is not given is 0."""
    stored = {known.attributes[s][0]: n for n, s in NAMES.items() if s in known.attributes}
    out = struct.pack("<IHH", MAGIC, layout | 1 << 10, 0)
    for number in known.layouts[layout]:
        value = values.get(stored.get(number, ""), 0)
        out += (value & (1 << 64) - 1).to_bytes(8, "little").ljust(known.length_of(number) or 0, b"\0")
    return out
