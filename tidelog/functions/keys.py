"""Keys: derivation of wrapping and block keys, message codes, and key material from files. Driver-side values only."""

from __future__ import annotations

import hashlib
import hmac
import re

MOST_ITERATIONS = 10_000_000
#: Bytes of a key file.
MOST_FILE = 64 << 10
# Key lengths of the suites, CCM then GCM at 128, 192 and 256 bits.
KEY_BYTES = {3: 16, 4: 24, 5: 32, 6: 16, 7: 24, 8: 32}
FORMATS = {1: "raw", 2: "hex", 3: "passphrase"}


class KeyError_(ValueError):
    """Key material that does not fit its format."""


def wrapping_key(form: str, material: bytes, salt: int = 0, iterations: int = 0) -> bytes:
    """The 32-byte wrapping key of raw, hexadecimal or passphrase material."""
    if form == "raw":
        if len(material) != 32:
            raise KeyError_("a raw key has 32 bytes")
        return material
    if form == "hex":
        text = material.strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{64}", text):
            raise KeyError_("a hexadecimal key has 64 digits")
        return bytes.fromhex(text.decode())
    if form == "passphrase":
        if not 8 <= len(material) <= 512 or b"\0" in material:
            raise KeyError_("a passphrase has 8 to 512 bytes, none of them zero")
        if not 0 < iterations <= MOST_ITERATIONS:
            raise KeyError_(f"{iterations} iterations")
        return hashlib.pbkdf2_hmac("sha1", material, salt.to_bytes(8, "little"), iterations, 32)
    raise KeyError_(f"no key format {form}")


def trimmed(form: str, material: bytes) -> bytes:
    """A key file's material: text formats lose one line end."""
    return material if form == "raw" else re.sub(rb"\r?\n\Z", b"", material)


def block_key(master: bytes, salt: bytes, suite: int) -> bytes:
    """HKDF with SHA-512, no salt of its own and the block's salt as info."""
    if suite not in KEY_BYTES:
        raise KeyError_(f"no suite {suite}")
    drawn = hmac.new(bytes(64), master, hashlib.sha512).digest()
    return hmac.new(drawn, salt + b"\x01", hashlib.sha512).digest()[: KEY_BYTES[suite]]


#: Bytes that a message code may be cut to.
CODE_BYTES = (16, 32, 64)


def code_holds(key: bytes, data: bytes, said: bytes) -> bool:
    """Whether an HMAC-SHA512, cut to one of the lengths in use, is what is said; compared in constant time."""
    if len(said) not in CODE_BYTES:
        raise KeyError_(f"a code of {len(said)} bytes")
    return hmac.compare_digest(hmac.new(key, data, hashlib.sha512).digest()[: len(said)], said)


def material_of(form: str, path: str) -> bytes:
    """Key material from a file: text forms lose one line end; a raw key may stand there in 64 hexadecimal digits."""
    with open(path, "rb") as f:
        found = f.read(MOST_FILE + 1)
    if len(found) > MOST_FILE:
        raise KeyError_(f"a key file of more than {MOST_FILE} bytes")
    if form == "raw" and len(found) != 32:
        digits = found.strip()
        if re.fullmatch(rb"[0-9a-fA-F]{64}", digits):
            return bytes.fromhex(digits.decode())
    return trimmed(form, found)
