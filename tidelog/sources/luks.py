"""LUKS containers, versions 1 and 2: a passphrase opens a key slot, whose key opens sectors by AES-XTS.

Slots whose passphrase is stretched by Argon2 are passed over, as there is no implementation of it here.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import struct

from tidelog.functions import aes
from tidelog.functions.keys import MOST_ITERATIONS
from tidelog.sources.images import ImageError, Source

MAGIC = b"LUKS\xba\xbe"
#: Fixed value: what marks a slot of version 1 as used.
USED = 0x00AC71F3
MOST_MATERIAL = 16 << 20


class LuksError(ImageError):
    """A container that breaks its format, or that a passphrase does not open."""


def is_luks(source: Source) -> bool:
    return source.size >= 592 and source.read(0, 6) == MAGIC


def _spread(data: bytes, name: str) -> bytes:
    """Hashes a stripe in pieces, each with its number."""
    size = hashlib.new(name).digest_size
    return b"".join(hashlib.new(name, struct.pack(">I", k) + data[at : at + size]).digest()[: len(data) - at] for k, at in enumerate(range(0, len(data), size)))


def merged(material: bytes, size: int, stripes: int, name: str) -> bytes:
    """The key that is split over stripes: all but the last are folded in, hashed in between."""
    state = bytes(size)
    for k in range(stripes):
        part = bytes(a ^ b for a, b in zip(state, material[k * size : (k + 1) * size], strict=True))
        state = part if k == stripes - 1 else _spread(part, name)
    return state


def split(key: bytes, stripes: int, name: str, filler: bytes) -> bytes:
    """The stripes that merged() makes the key of; the filler gives all but the last."""
    state, out = bytes(len(key)), b""
    for k in range(stripes - 1):
        part = filler[k * len(key) : (k + 1) * len(key)]
        out += part
        state = _spread(bytes(a ^ b for a, b in zip(state, part, strict=True)), name)
    return out + bytes(a ^ b for a, b in zip(state, key, strict=True))


def _stretched(name: str, password: bytes, salt: bytes, rounds: int, size: int) -> bytes:
    if not 0 < rounds <= MOST_ITERATIONS:
        raise LuksError(f"{rounds} iterations")
    try:
        return hashlib.pbkdf2_hmac(name, password, salt, rounds, size)
    except ValueError:
        raise LuksError(f"no hash {name}") from None


class Luks(Source):
    """The plain sectors of a container."""

    def __init__(self, source: Source, start: int, size: int, key: bytes, sector: int, first: int = 0):
        if start + size > source.size or size <= 0 or size % sector:
            raise LuksError("the data lies outside the container")
        self.source, self.start, self.size, self.key, self.sector, self.first = source, start, size, key, sector, first

    def fetch(self, at: int, n: int) -> bytes:
        step = self.sector
        lo, hi = at // step, -(-(at + n) // step)
        data = self.source.read(self.start + lo * step, (hi - lo) * step)
        per = step // 512  # numbers count 512 bytes, whatever a sector has
        if per == 1:
            plain = aes.xts(self.key, data, self.first + lo)
        else:
            plain = b"".join(aes.xts(self.key, data[k * step : (k + 1) * step], self.first + (lo + k) * per, step) for k in range(hi - lo))
        return plain[at - lo * step :][:n]


def unlocked(source: Source, password: bytes) -> tuple[Luks, str]:
    """The plain sectors, and what the container is."""
    if not is_luks(source):
        raise LuksError("no LUKS container")
    (version,) = struct.unpack(">H", source.read(6, 2))
    if version == 1:
        return _first(source, password), "LUKS1 aes-xts-plain64"
    if version == 2:
        return _second(source, password), "LUKS2 aes-xts-plain64"
    raise LuksError(f"LUKS version {version}")


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("ascii", "replace")


def _first(source: Source, password: bytes) -> Luks:
    head = source.read(0, 592)
    cipher, mode, name = (_text(head[8 + 32 * k : 40 + 32 * k]) for k in range(3))
    offset, size = struct.unpack_from(">II", head, 104)
    digest, salt, rounds = head[112:132], head[132:164], struct.unpack_from(">I", head, 164)[0]
    if (cipher, mode) != ("aes", "xts-plain64") or size not in (32, 64):
        raise LuksError(f"cipher {cipher}-{mode} of {size} bytes")
    for k in range(8):
        at = 208 + 48 * k
        used, turns = struct.unpack_from(">II", head, at)
        where, stripes = struct.unpack_from(">II", head, at + 40)
        if used != USED or not 0 < stripes * size <= MOST_MATERIAL:
            continue
        whole = -(-stripes * size // 512) * 512
        material = aes.xts(_stretched(name, password, head[at + 8 : at + 40], turns, size), source.read(where * 512, whole), 0)
        key = merged(material[: stripes * size], size, stripes, name)
        if hmac.compare_digest(_stretched(name, key, salt, rounds, 20), digest):
            return Luks(source, offset * 512, (source.size - offset * 512) // 512 * 512, key, 512)
    raise LuksError("the passphrase opens no slot")


def _second(source: Source, password: bytes) -> Luks:
    (size,) = struct.unpack(">Q", source.read(8, 8))
    if not 4096 < size <= 4 << 20:
        raise LuksError("a header of that size")
    head = source.read(0, size)
    name = _text(head[72:104])
    if hashlib.new(name, head[:448] + bytes(64) + head[512:]).digest() != head[448 : 448 + hashlib.new(name).digest_size]:
        raise LuksError("the header's checksum does not hold")
    try:
        told = json.loads(head[4096:].split(b"\0")[0])
        raw = lambda s: base64.b64decode(s)
        segment = next(s for _, s in sorted(told["segments"].items()) if s["type"] == "crypt")
        if segment["encryption"] != "aes-xts-plain64":
            raise LuksError(f"cipher {segment['encryption']}")
        digests = [(d, raw(d["salt"]), raw(d["digest"])) for d in told["digests"].values() if d["type"] == "pbkdf2"]
        passed = []
        for number, slot in sorted(told["keyslots"].items()):
            kdf, area, af = slot["kdf"], slot["area"], slot["af"]
            if kdf["type"] != "pbkdf2" or area["encryption"] != "aes-xts-plain64":
                passed.append(f"slot {number}: {kdf['type']}, {area['encryption']}")
                continue
            n, stripes = slot["key_size"], af["stripes"]
            if not 0 < n * stripes <= MOST_MATERIAL:
                continue
            own = _stretched(kdf["hash"], password, raw(kdf["salt"]), kdf["iterations"], area["key_size"])
            material = aes.xts(own, source.read(int(area["offset"]), -(-n * stripes // 512) * 512), 0)
            key = merged(material[: n * stripes], n, stripes, af["hash"])
            for d, salt, said in digests:
                if number in d["keyslots"] and hmac.compare_digest(_stretched(d["hash"], key, salt, d["iterations"], len(said)), said):
                    start, step = int(segment["offset"]), segment.get("sector_size", 512)
                    length = source.size - start if segment["size"] == "dynamic" else int(segment["size"])
                    return Luks(source, start, length // step * step, key, step, int(segment.get("iv_tweak", 0)))
    except (KeyError, TypeError, ValueError, StopIteration) as e:
        if isinstance(e, LuksError):
            raise
        raise LuksError(f"the header is malformed: {e!r}") from None
    raise LuksError("the passphrase opens no slot" + (f" ({'; '.join(passed)})" if passed else ""))
