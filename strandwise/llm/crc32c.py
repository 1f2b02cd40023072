"""CRC-32C (Castagnoli) of many byte strings at once, and its masked form."""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # fixed value, reflected
MASK_DELTA = 0xA282EAD8  # fixed value of the masked form
BLOCK = 64


@cache
def _tables() -> np.ndarray:
    """Row j: what a byte at place j of a block adds to the block's remainder."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    rows = [one]
    for _ in range(BLOCK - 1):
        rows.append(one[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    return np.array(rows[::-1])


@cache
def _shift(level: int) -> np.ndarray:
    """Tables that move a remainder past BLOCK << level zero bytes, one per byte of the remainder."""
    start = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if level:
        return _moved(_moved(start, level - 1), level - 1)
    one = _tables()[-1]
    for _ in range(BLOCK):
        start = one[start & 0xFF] ^ (start >> 8)
    return start


def _moved(c: np.ndarray, level: int) -> np.ndarray:
    s = _shift(level)
    return s[0][c & 0xFF] ^ s[1][(c >> 8) & 0xFF] ^ s[2][(c >> 16) & 0xFF] ^ s[3][c >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The checksum of each part as uint32.

    The parts are cut into blocks from their ends, so that the zeros that fill a first block add
    nothing; block remainders are then joined two by two.
    """
    out = np.zeros(len(parts), dtype=np.uint32)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    levels = np.ceil(np.log2(np.maximum(1, -(-sizes // BLOCK)))).astype(int)
    tables = _tables()
    for level in np.unique(levels):
        rows = np.flatnonzero(levels == level)
        width = BLOCK << int(level)
        data = np.zeros((len(rows), width), dtype=np.uint8)
        for r, i in enumerate(rows):
            n = len(parts[i])
            data[r, width - n :] = np.frombuffer(parts[i], dtype=np.uint8)
            head = min(4, n)
            data[r, width - n : width - n + head] ^= 0xFF  # the initial remainder of all ones
        blocks = data.reshape(-1, BLOCK)
        c = np.zeros(len(blocks), dtype=np.uint32)
        for j in range(BLOCK):
            c ^= tables[j][blocks[:, j]]
        c = c.reshape(len(rows), -1)
        for k in range(int(level)):
            c = _moved(c[:, 0::2], k) ^ c[:, 1::2]
        out[rows] = c[:, 0]
    short = sizes < 4  # all ones reach past a part of under 4 bytes
    for i in np.flatnonzero(short):
        c = 0xFFFFFFFF
        for b in parts[i]:
            c = int(tables[-1][(c ^ b) & 0xFF]) ^ (c >> 8)
        out[i] = c
    return ~out


def masked(c: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of data that holds checksums stays strong."""
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK_DELTA)
