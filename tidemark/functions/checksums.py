"""Checksums Spark has no function for: CRC-64/ECMA (reflected, as Go's hash/crc64 counts it) and CRC-32C."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reversed polynomials.
ECMA64, CASTAGNOLI = 0xC96C5795D7870F42, 0x82F63B78


@lru_cache
def _table(poly: int) -> tuple[int, ...]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ poly if n & 1 else n >> 1
        out.append(n)
    return tuple(out)


@lru_cache
def _array(poly: int) -> np.ndarray:
    return np.array(_table(poly), np.uint64)


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The linear map with these images of single bits, of each value."""
    out = np.zeros_like(v)
    for bit, image in enumerate(matrix):
        out ^= np.where(v >> np.uint64(bit) & np.uint64(1), image, np.uint64(0))
    return out


@lru_cache(maxsize=64)
def _zeros(poly: int, bits: int, n: int) -> np.ndarray:
    """What n zero bytes do to a register, as images of its single bits."""
    out = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    step = _array(poly)[(out & np.uint64(255)).astype(np.int64)] ^ out >> np.uint64(8)
    while n:
        if n & 1:
            out = _times(step, out)
        step = _times(step, step)
        n >>= 1
    return out


def _update(value: int, data: bytes, poly: int, mask: int) -> int:
    if len(data) >= 1024:
        return _update_wide(value, data, poly, mask)
    table, c = _table(poly), value ^ mask
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ mask


def _update_wide(value: int, data: bytes, poly: int, mask: int) -> int:
    """Many equal pieces of the data side by side, then pairs of neighbours put together.

    A register that is empty stays so over zeros, which fill up the first piece; what was in it before is moved on separately.
    """
    bits, n = mask.bit_length(), len(data)
    lanes = 1 << n.bit_length() // 2
    length = -(-n // lanes)
    pieces = np.zeros(lanes * length, np.uint8)
    pieces[lanes * length - n :] = np.frombuffer(data, np.uint8)
    pieces, table = np.ascontiguousarray(pieces.reshape(lanes, length).T), _array(poly)
    c = np.zeros(lanes, np.uint64)
    for row in pieces:
        c = table[((c ^ row) & np.uint64(255)).astype(np.int64)] ^ c >> np.uint64(8)
    move = _zeros(poly, bits, length)
    while len(c) > 1:
        c = _times(move, c[::2]) ^ c[1::2]
        move = _times(move, move)
    before = _times(_zeros(poly, bits, n), np.array([value ^ mask], np.uint64))
    return int(c[0] ^ before[0]) ^ mask


def crc64_update(value: int, data: bytes) -> int:
    return _update(value, data, ECMA64, 0xFFFFFFFFFFFFFFFF)


def crc32c_update(value: int, data: bytes) -> int:
    return _update(value, data, CASTAGNOLI, 0xFFFFFFFF)


@F.pandas_udf(T.StringType())
def crc64(data: pd.Series) -> pd.Series:
    """16 hex digits: the sum does not fit into a signed long."""
    return data.map(lambda x: None if x is None else f"{crc64_update(0, bytes(x)):016x}")


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else crc32c_update(0, bytes(x))).astype("Int64")
