"""CRC-32C (Castagnoli) of bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_POLYNOMIAL = 0x82F63B78  # reversed
_WIDTH = 256  # bytes of a lane


def _tables() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1))
    return t


_TABLE = _tables()
_LIST = _TABLE.tolist()


def _apply(columns: list[int], x: int) -> int:
    """A matrix over bits, given by what it makes of each bit, times ``x``."""
    out = 0
    while x:
        low = x & -x
        out ^= columns[low.bit_length() - 1]
        x ^= low
    return out


@lru_cache(1)
def _zeros(n: int) -> list[list[int]]:
    """What ``n`` zero bytes do to a register, as a table for each of its four bytes."""
    def times(a, b):
        return [_apply(a, c) for c in b]

    byte = [(1 << i) >> 8 ^ _LIST[(1 << i) & 255] for i in range(32)]
    power, out = byte, [1 << i for i in range(32)]
    while n:
        if n & 1:
            out = times(power, out)
        power, n = times(power, power), n >> 1
    return [[_apply(out, v << (8 * k)) for v in range(256)] for k in range(4)]


def crc32c(data: bytes) -> int:
    """The checksum of ``data``; long data is taken in lanes side by side, whose registers are then joined."""
    register, done = 0xFFFFFFFF, 0
    if len(data) >= 32 * _WIDTH:
        n = len(data) // _WIDTH
        lanes = np.frombuffer(data, np.uint8, n * _WIDTH).reshape(n, _WIDTH).T.copy()
        state = np.zeros(n, np.uint32)
        state[0] = register
        for row in lanes:
            state = _TABLE[(state ^ row) & np.uint32(255)] ^ (state >> np.uint32(8))
        a, b, c, d = _zeros(_WIDTH)
        register = 0
        for s in state.tolist():
            register = a[register & 255] ^ b[register >> 8 & 255] ^ c[register >> 16 & 255] ^ d[register >> 24] ^ s
        done = n * _WIDTH
    for x in data[done:]:
        register = _LIST[(register ^ x) & 255] ^ register >> 8
    return register ^ 0xFFFFFFFF
