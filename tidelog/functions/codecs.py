"""Block codecs: bytes to bytes whose length must be the block's logical size."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
import zstandard

# Codec ids of the on-disk format.
IDS = {2: "off", 3: "lzjb", 4: "empty", **{k: "gzip" for k in range(5, 14)}, 14: "zle", 15: "lz4", 16: "zstd"}
WRITERS = ("off", "gzip", "zle", "lz4", "zstd", "lzjb")
ZLE_RUN = 64


class CodecError(ValueError):
    """A block that does not decode to its logical size."""


def name_of(codec: int, replay: bool = False) -> str:
    """A codec's name. In replayed writes 0 stands for data as it is; 0 and 1 (inherit, on) name no codec otherwise."""
    if replay and codec == 0:
        return "off"
    if codec not in IDS:
        raise CodecError(f"codec {codec} names no way to decode a block")
    return IDS[codec]


def _lzjb(data: bytes, size: int) -> bytes:
    """Flag bytes announce eight items each: a literal, or a copy of 6 bits of length (less 3) and 10 of distance."""
    out, at, flags, left = bytearray(), 0, 0, 0
    while len(out) < size:
        if not left:
            flags, left, at = data[at], 8, at + 1
        if flags & 1:
            word = data[at] << 8 | data[at + 1]
            at += 2
            length, back = (word >> 10) + 3, word & 0x3FF
            if not back or back > len(out):
                raise CodecError("a copy from before the block")
            for _ in range(min(length, size - len(out))):
                out.append(out[-back])
        else:
            out.append(data[at])
            at += 1
        flags, left = flags >> 1, left - 1
    return bytes(out)


def _zle(data: bytes, size: int) -> bytes:
    """A byte under 64 announces one literal byte more than it says; others a run of zeros."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at] + 1
        at += 1
        if n <= ZLE_RUN:
            out += data[at : at + n]
            at += n
        else:
            out += bytes(n - ZLE_RUN)
    return bytes(out)


def _lz4_size(data: bytes) -> int:
    """Bytes that an LZ4 block decodes to: each sequence's literals and copy, whose long lengths go on in 255s."""
    at, size = 0, 0
    while at < len(data):
        token = data[at]
        at += 1
        for n, last in ((token >> 4, False), (token & 15, True)):
            if last:
                if at >= len(data):
                    return size
                at, n = at + 2, n + 4
            if n == (19 if last else 15):
                while True:
                    more = data[at]
                    n, at = n + more, at + 1
                    if more < 255:
                        break
            size += n
            if not last:
                at += n
    return size


def decode(codec: str, data: bytes, size: int) -> bytes:
    """The block's bytes; a CodecError unless there are exactly `size`."""
    try:
        if codec == "off":
            out = data
        elif codec == "empty":
            out = bytes(size)
        elif codec == "gzip":
            out = zlib.decompressobj().decompress(data, size + 1)
        elif codec == "zle":
            out = _zle(data, size)
        elif codec == "lzjb":
            out = _lzjb(data, size)
        elif codec == "lz4":
            (n,) = struct.unpack_from(">I", data)
            real = _lz4_size(data[4 : 4 + n])
            out = bytes(real) if real != size or not size else pa.Codec("lz4_raw").decompress(data[4 : 4 + n], size).to_pybytes()
        elif codec == "zstd":
            (n,) = struct.unpack_from(">I", data)
            out = zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(data[8 : 8 + n], max_output_size=size + 1)
        else:
            raise CodecError(f"no codec {codec}")
    except CodecError:
        raise
    except (zlib.error, zstandard.ZstdError, struct.error, IndexError, OSError, ValueError) as e:
        raise CodecError(f"{codec}: {e}") from e
    if len(out) != size:
        raise CodecError(f"{codec}: {len(out)} bytes, not {size}")
    return out


def encode(codec: str, data: bytes) -> bytes:
    """What decode reads, for tests and generated streams. lzjb stores literals alone."""
    if codec == "off":
        return data
    if codec == "gzip":
        return zlib.compress(data, 6)
    if codec == "lz4":
        packed = pa.Codec("lz4_raw").compress(data).to_pybytes()
        return struct.pack(">I", len(packed)) + packed
    if codec == "zstd":
        how = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=True, write_checksum=False)
        packed = zstandard.ZstdCompressor(compression_params=how).compress(data)
        return struct.pack(">II", len(packed), 3) + packed
    if codec == "lzjb":
        return b"".join(b"\0" + data[i : i + 8] for i in range(0, len(data), 8))
    if codec == "zle":
        out, at = bytearray(), 0
        while at < len(data):
            zeros = 0
            while at + zeros < len(data) and zeros < 256 - ZLE_RUN and data[at + zeros] == 0:
                zeros += 1
            if zeros:
                out.append(ZLE_RUN + zeros - 1)
                at += zeros
                continue
            end = at
            while end < len(data) and end - at < ZLE_RUN and data[end]:
                end += 1
            out.append(end - at - 1)
            out += data[at:end]
            at = end
        return bytes(out)
    raise CodecError(f"no writer for {codec}")


def decode_embedded(etype: int, codec: int, payload: bytes, size: int, packed: int) -> bytes:
    """An embedded write's bytes: its type must be 0 and its payload holds `packed` bytes and padding."""
    if etype:
        raise CodecError(f"embedded type {etype}")
    if packed > len(payload):
        raise CodecError("an embedded payload is cut short")
    return decode(name_of(codec, replay=True), payload[:packed], size)
