"""Name-value lists: the two packed encodings, with nested lists and arrays."""

from __future__ import annotations

import struct

# Data types of pairs.
BOOLEAN, BYTE, INT16, UINT16, INT32, UINT32, INT64, UINT64, STRING, BYTES = range(1, 11)
UINT64_ARRAY, STRINGS, NVLIST, NVLIST_ARRAY, BOOLEAN_VALUE, INT8, UINT8, UINT8_ARRAY = 16, 17, 19, 20, 21, 22, 23, 26
NATIVE, XDR = 0, 1
DEEPEST = 32


class NvError(ValueError):
    """A list that is cut short or holds what cannot be read."""


def decode(data: bytes) -> dict:
    """The pairs of a packed list: numbers, strings, bytes, booleans, lists of numbers and nested lists."""
    if len(data) < 4 or data[1] != 1:
        raise NvError("no little-endian packed list")
    if data[0] not in (NATIVE, XDR):
        raise NvError(f"encoding {data[0]}")
    try:
        return _xdr(data, 4, 0)[0] if data[0] == XDR else _native(data, 4, 0)[0]
    except (struct.error, UnicodeDecodeError) as e:
        raise NvError(str(e)) from e


def _take(data: bytes, at: int, n: int) -> bytes:
    if n < 0 or at + n > len(data):
        raise NvError("a value is cut short")
    return data[at : at + n]


def _xdr(data: bytes, at: int, depth: int) -> tuple[dict, int]:
    """Big-endian words of four bytes; each pair states its own encoded size, and a size of zero ends the list."""
    if depth > DEEPEST:
        raise NvError("lists nest too deep")
    if struct.unpack_from(">I", data, at)[0]:
        raise NvError("a list of another version")
    out, at = {}, at + 8  # version and flags
    while True:
        size, _ = struct.unpack_from(">II", data, at)
        if not size:
            return out, at + 8
        end, p = at + size, at + 8
        (n,) = struct.unpack_from(">I", data, p)
        name = _take(data, p + 4, n).decode()
        p += 4 + (n + 3 & ~3)
        kind, count = struct.unpack_from(">II", data, p)
        p += 8
        if kind in (UINT64, INT64):
            out[name] = struct.unpack_from(">Q" if kind == UINT64 else ">q", data, p)[0]
        elif kind in (BYTE, INT8, UINT8, INT16, UINT16, INT32, UINT32, BOOLEAN_VALUE):
            value = struct.unpack_from(">i" if kind in (INT8, INT16, INT32) else ">I", data, p)[0]
            out[name] = bool(value) if kind == BOOLEAN_VALUE else value
        elif kind == BOOLEAN:
            out[name] = True
        elif kind == STRING:
            (n,) = struct.unpack_from(">I", data, p)
            out[name] = _take(data, p + 4, n).decode()
        elif kind == BYTES:
            out[name] = _take(data, p, count)
        elif kind == UINT8_ARRAY:  # a second count, then a word of four bytes for each
            out[name] = bytes(x & 0xFF for x in struct.unpack_from(f">{count}I", data, p + 4))
        elif kind == UINT64_ARRAY:
            out[name] = list(struct.unpack_from(f">{count}Q", data, p + 4))
        elif kind == STRINGS:
            out[name], q = [], p
            for _ in range(count):
                (n,) = struct.unpack_from(">I", data, q)
                out[name].append(_take(data, q + 4, n).decode())
                q += 4 + (n + 3 & ~3)
        elif kind == NVLIST:
            out[name], end = _xdr(data, p, depth + 1)
        elif kind == NVLIST_ARRAY:
            out[name] = []
            for _ in range(count):
                inner, p = _xdr(data, p, depth + 1)
                out[name].append(inner)
            end = p
        else:
            raise NvError(f"type {kind}")
        if end <= at:
            raise NvError("a pair without a size")
        at = end


def _native(data: bytes, at: int, depth: int) -> tuple[dict, int]:
    """Little-endian pairs, each with a head of 16 bytes, padded to eight; a nested list follows its pair."""
    if depth > DEEPEST:
        raise NvError("lists nest too deep")
    out = {}
    if depth == 0:
        if struct.unpack_from("<I", data, at)[0]:
            raise NvError("a list of another version")
        at += 8
    while True:
        (size,) = struct.unpack_from("<i", data, at)
        if not size:
            return out, at + 4
        if size < 16:
            raise NvError("a pair without a size")
        n, _, count, kind = struct.unpack_from("<hhii", data, at + 4)
        name = _take(data, at + 16, n).split(b"\0")[0].decode()
        p, at = at + (16 + n + 7 & ~7), at + size
        if kind in (UINT64, INT64):
            out[name] = struct.unpack_from("<Q" if kind == UINT64 else "<q", data, p)[0]
        elif kind in (INT32, UINT32, BOOLEAN_VALUE):
            value = struct.unpack_from("<i" if kind == INT32 else "<I", data, p)[0]
            out[name] = bool(value) if kind == BOOLEAN_VALUE else value
        elif kind in (INT16, UINT16):
            out[name] = struct.unpack_from("<h" if kind == INT16 else "<H", data, p)[0]
        elif kind in (BYTE, UINT8, INT8):
            out[name] = struct.unpack_from("<b" if kind == INT8 else "<B", data, p)[0]
        elif kind == BOOLEAN:
            out[name] = True
        elif kind == STRING:
            out[name] = _take(data, p, at - p).split(b"\0")[0].decode()
        elif kind in (BYTES, UINT8_ARRAY):
            out[name] = _take(data, p, count)
        elif kind == UINT64_ARRAY:
            out[name] = list(struct.unpack_from(f"<{count}Q", data, p))
        elif kind == NVLIST:
            out[name], at = _native(data, at, depth + 1)
        elif kind == NVLIST_ARRAY:
            out[name] = []
            for _ in range(count):
                inner, at = _native(data, at, depth + 1)
                out[name].append(inner)
        else:
            raise NvError(f"type {kind}")


def encode(pairs: dict) -> bytes:
    """A packed XDR list of numbers (64 bits), strings, byte arrays and nested lists."""
    return bytes([XDR, 1, 0, 0]) + _encoded(pairs)


def _encoded(pairs: dict) -> bytes:
    out = struct.pack(">II", 0, 1)
    for name, value in pairs.items():
        raw = name.encode()
        if isinstance(value, dict):
            kind, count, body = NVLIST, 1, _encoded(value)
        elif isinstance(value, str):
            kind, count, body = STRING, 1, struct.pack(">I", len(value.encode())) + value.encode().ljust(len(value.encode()) + 3 & ~3, b"\0")
        elif isinstance(value, bytes):
            kind, count, body = UINT8_ARRAY, len(value), struct.pack(f">{len(value) + 1}I", len(value), *value)
        elif isinstance(value, list):
            kind, count, body = NVLIST_ARRAY, len(value), b"".join(map(_encoded, value))
        else:
            kind, count, body = UINT64, 1, struct.pack(">Q", value)
        mid = struct.pack(">I", len(raw)) + raw.ljust(len(raw) + 3 & ~3, b"\0") + struct.pack(">II", kind, count) + body
        out += struct.pack(">II", len(mid) + 8, len(mid) + 8) + mid
    return out + bytes(8)
