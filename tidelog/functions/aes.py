"""The block cipher AES and its modes CCM, GCM and XTS, where Spark's own functions have none or cannot be reached.

Counter modes and XTS work on all blocks of a message at once. The tables follow from the cipher's definition.
"""

from __future__ import annotations

import hmac

import numpy as np


class SealError(ValueError):
    """A message that its key, code or associated data does not fit."""


def _tables() -> tuple[list[int], list[int], list[list[int]], list[list[int]]]:
    """The substitution and its inverse, and words of a substituted byte times the columns of the mixing matrices."""
    times = lambda a, b: 0 if not b else (a if b & 1 else 0) ^ times((a << 1 ^ (0x11B if a & 0x80 else 0)) & 0x1FF & 0xFF, b >> 1)
    box, x, y = [0] * 256, 1, 1
    while True:  # x runs through the powers of 3, y through those of its inverse
        x = times(x, 3)
        y = times(y, 0xF6)
        s = y
        for k in range(1, 5):
            s ^= (y << k | y >> (8 - k)) & 0xFF
        box[x] = s ^ 0x63
        if x == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, s in enumerate(box):
        back[s] = i
    mix = [[times(s, 2) << 24 | s << 16 | s << 8 | times(s, 3) for s in box]]
    unmix = [[times(s, 14) << 24 | times(s, 9) << 16 | times(s, 13) << 8 | times(s, 11) for s in back]]
    for t in (mix, unmix):
        for _ in range(3):
            t.append([w >> 8 | (w & 0xFF) << 24 for w in t[-1]])
    return box, back, mix, unmix


BOX, BACK, MIX, UNMIX = _tables()
_BOX, _BACK = np.array(BOX, np.uint32), np.array(BACK, np.uint32)
_MIX, _UNMIX = np.array(MIX, np.uint32), np.array(UNMIX, np.uint32)


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        if len(key) not in (16, 24, 32):
            raise SealError(f"a key of {len(key)} bytes")
        self.rounds = n + 6
        w = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
        sub = lambda x: BOX[x >> 24] << 24 | BOX[x >> 16 & 255] << 16 | BOX[x >> 8 & 255] << 8 | BOX[x & 255]
        step = 1
        for i in range(n, 4 * (self.rounds + 1)):
            x = w[-1]
            if i % n == 0:
                x = sub((x << 8 | x >> 24) & 0xFFFFFFFF) ^ step << 24
                step = step << 1 ^ (0x11B if step & 0x80 else 0)
            elif n > 6 and i % n == 4:
                x = sub(x)
            w.append(w[i - n] ^ x)
        self.words = w
        inner = [UNMIX[0][BOX[x >> 24]] ^ UNMIX[1][BOX[x >> 16 & 255]] ^ UNMIX[2][BOX[x >> 8 & 255]] ^ UNMIX[3][BOX[x & 255]] for x in w]
        self.undo = [(w if r in (0, self.rounds) else inner)[4 * r : 4 * r + 4] for r in range(self.rounds, -1, -1)]

    def one(self, block: int) -> int:
        """A single block, as a number."""
        w, (t0, t1, t2, t3) = self.words, MIX
        a, b, c, d = (block >> 96) ^ w[0], (block >> 64 & 0xFFFFFFFF) ^ w[1], (block >> 32 & 0xFFFFFFFF) ^ w[2], (block & 0xFFFFFFFF) ^ w[3]
        for k in range(4, 4 * self.rounds, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ w[k], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ w[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ w[k + 2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ w[k + 3],
            )
        s, k, out = BOX, 4 * self.rounds, 0
        for i, (p, q, r, t) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
            out = out << 32 | ((s[p >> 24] << 24 | s[q >> 16 & 255] << 16 | s[r >> 8 & 255] << 8 | s[t & 255]) ^ w[k + i])
        return out

    def _all(self, blocks: np.ndarray, keys: list[list[int]], tables: np.ndarray, last: np.ndarray, turn: int) -> np.ndarray:
        x = np.ascontiguousarray(blocks).view(">u4").astype(np.uint32).reshape(-1, 4)
        x = x ^ np.array(keys[0], np.uint32)
        part = lambda k: [(x[:, (i + turn * k) % 4] >> np.uint32(24 - 8 * k) & np.uint32(255)) for i in range(4)]
        for key in keys[1:-1]:
            cut = [part(k) for k in range(4)]
            x = np.stack([tables[0][cut[0][i]] ^ tables[1][cut[1][i]] ^ tables[2][cut[2][i]] ^ tables[3][cut[3][i]] ^ np.uint32(key[i]) for i in range(4)], axis=1)
        cut = [part(k) for k in range(4)]
        x = np.stack([(last[cut[0][i]] << np.uint32(24) | last[cut[1][i]] << np.uint32(16) | last[cut[2][i]] << np.uint32(8) | last[cut[3][i]]) ^ np.uint32(keys[-1][i]) for i in range(4)], axis=1)
        return x.astype(">u4").view(np.uint8).reshape(-1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        """Blocks (n x 16 bytes), each for itself."""
        return self._all(blocks, [self.words[4 * r : 4 * r + 4] for r in range(self.rounds + 1)], _MIX, _BOX, 1)

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        return self._all(blocks, self.undo, _UNMIX, _BACK, 3)


def _xor(a: bytes, b: np.ndarray) -> bytes:
    x = np.frombuffer(a, np.uint8)
    return (x ^ b.ravel()[: len(x)]).tobytes()


def _counted(aes: Aes, head: bytes, first: int, n: int, width: int) -> np.ndarray:
    """The key stream of n counters of `width` bytes behind a head."""
    blocks = np.zeros((n, 16), np.uint8)
    blocks[:, : len(head)] = np.frombuffer(head, np.uint8)
    blocks[:, 16 - width :] = (first + np.arange(n, dtype=np.uint64)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width :]
    return aes.encrypt(blocks)


def _code_ccm(aes: Aes, iv: bytes, aad: bytes, data: bytes) -> int:
    """The chained code of a message under a nonce of 12 bytes and a code of 16."""
    length = 15 - len(iv)
    head = bytes([(64 if aad else 0) | 7 << 3 | length - 1]) + iv + len(data).to_bytes(length, "big")
    if aad:
        told = len(aad).to_bytes(2, "big") if len(aad) < 0xFF00 else b"\xff\xfe" + len(aad).to_bytes(4, "big")
        head += told + aad
        head = head.ljust(-(-len(head) // 16) * 16, b"\0")
    whole = head + data.ljust(-(-len(data) // 16) * 16, b"\0")
    code, one = 0, aes.one
    for k in range(0, len(whole), 16):
        code = one(code ^ int.from_bytes(whole[k : k + 16], "big"))
    return code


def ccm(key: bytes, iv: bytes, aad: bytes, data: bytes, mac: bytes | None) -> tuple[bytes, bytes]:
    """Opens a message (mac given) or seals one (mac None): its other form, and its code."""
    aes = Aes(key)
    if len(data) >= 1 << 8 * (15 - len(iv)):
        raise SealError("a message too long for its nonce")
    stream = _counted(aes, bytes([14 - len(iv)]) + iv, 0, 1 + -(-len(data) // 16), 15 - len(iv))
    other = _xor(data, stream[1:])
    code = _code_ccm(aes, iv, aad, data if mac is None else other) ^ int.from_bytes(stream[0].tobytes(), "big")
    return _checked(other, code.to_bytes(16, "big"), mac)


def _checked(other: bytes, code: bytes, mac: bytes | None) -> tuple[bytes, bytes]:
    if mac is not None and not (len(mac) == 16 and hmac.compare_digest(code, mac)):
        raise SealError("the message does not fit its code")
    return other, code


def _hash(h: int, aad: bytes, data: bytes) -> int:
    """The polynomial code of GCM; eight bits at a time by a table of multiples of h."""
    poly = 0xE1 << 120
    bit = [h]
    for _ in range(7):
        bit.append(bit[-1] >> 1 ^ (poly if bit[-1] & 1 else 0))
    table = [0] * 256
    for i in range(256):
        for k in range(8):
            if i >> (7 - k) & 1:
                table[i] ^= bit[k]
    low = []
    for i in range(256):
        x = i
        for _ in range(8):
            x = x >> 1 ^ (poly if x & 1 else 0)
        low.append(x)
    pad = lambda b: b.ljust(-(-len(b) // 16) * 16, b"\0")
    whole = pad(aad) + pad(data) + (8 * len(aad)).to_bytes(8, "big") + (8 * len(data)).to_bytes(8, "big")
    y = 0
    for k in range(0, len(whole), 16):
        x = (y ^ int.from_bytes(whole[k : k + 16], "big")).to_bytes(16, "big")
        y = 0
        for b in reversed(x):
            y = y >> 8 ^ low[y & 255] ^ table[b]
    return y


def gcm(key: bytes, iv: bytes, aad: bytes, data: bytes, mac: bytes | None) -> tuple[bytes, bytes]:
    """As ccm; the nonce has 12 bytes."""
    aes = Aes(key)
    if len(iv) != 12:
        raise SealError(f"a nonce of {len(iv)} bytes")
    stream = _counted(aes, iv, 1, 1 + -(-len(data) // 16), 4)
    other = _xor(data, stream[1:])
    code = _hash(aes.one(0), aad, other if mac is None else data) ^ int.from_bytes(stream[0].tobytes(), "big")
    return _checked(other, code.to_bytes(16, "big"), mac)


def xts(key: bytes, data: bytes, first: int, sector: int = 512, seal: bool = False) -> bytes:
    """Opens (or seals) whole sectors, numbered from `first` on; the key's halves are for data and for numbers."""
    if len(data) % sector or sector % 16:
        raise SealError("no whole sectors")
    own, numbers = Aes(key[: len(key) // 2]), Aes(key[len(key) // 2 :])
    n, per = len(data) // sector, sector // 16
    starts = np.zeros((n, 16), np.uint8)
    starts[:, :8] = (first + np.arange(n, dtype=np.uint64)).astype("<u8").view(np.uint8).reshape(n, 8)
    halves = numbers.encrypt(starts).view("<u8").astype(np.uint64).reshape(n, 2)
    lo, hi = halves[:, 0].copy(), halves[:, 1].copy()
    tweaks = np.empty((n, per, 2), np.uint64)
    for k in range(per):
        tweaks[:, k, 0], tweaks[:, k, 1] = lo, hi
        carry = hi >> np.uint64(63)
        hi = hi << np.uint64(1) | lo >> np.uint64(63)
        lo = lo << np.uint64(1) ^ carry * np.uint64(0x87)
    mask = tweaks.astype("<u8").view(np.uint8).reshape(-1, 16)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ mask
    return ((own.encrypt(blocks) if seal else own.decrypt(blocks)) ^ mask).tobytes()


def opened(suite: int, key: bytes, iv: bytes, aad: bytes, data: bytes, mac: bytes) -> bytes:
    """A message's plain bytes under suites 3 to 5 (CCM) and 6 to 8 (GCM), at 128, 192 and 256 bits."""
    if suite not in range(3, 9):
        raise SealError(f"no suite {suite}")
    return (ccm if suite < 6 else gcm)(key, iv, aad, data, mac)[0]


def sealed(suite: int, key: bytes, iv: bytes, aad: bytes, data: bytes) -> tuple[bytes, bytes]:
    """A message's sealed bytes and its code."""
    return (ccm if suite < 6 else gcm)(key, iv, aad, data, None)
