"""Hashes and the seeded generator that Spark doesn't have, as Arrow functions over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CASTAGNOLI = 0x82F63B78


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _columns(values: pd.Series):
    """(byte matrix column by column, which rows reach it) of the values, the longest first."""
    raw = [b"" if v is None else bytes(v) if not isinstance(v, str) else v.encode() for v in values]
    n = np.array([len(r) for r in raw], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint8)
    starts = np.cumsum(n[order]) - n[order]
    for i in range(int(n.max(initial=0))):
        alive = int((n[order] > i).sum())
        yield order[:alive], flat[starts[:alive] + i]


def fnv1a_many(values: pd.Series) -> np.ndarray:
    h = np.full(len(values), FNV_OFFSET, dtype=np.uint64)
    for rows, byte in _columns(values):
        h[rows] = (h[rows] ^ byte) * np.uint64(FNV_PRIME)
    return h


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


_CRC = _table()


def crc32c_many(values: pd.Series) -> np.ndarray:
    c = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    for rows, byte in _columns(values):
        c[rows] = _CRC[(c[rows] ^ byte) & np.uint32(0xFF)] ^ (c[rows] >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(LongType())
def fnv1a64(values: pd.Series) -> pd.Series:
    """FNV-1a of bytes, as the bit pattern of a 64-bit number; null counts as empty."""
    return pd.Series(fnv1a_many(values).view(np.int64))


@F.pandas_udf(LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C of bytes; null counts as empty."""
    return pd.Series(crc32c_many(values).astype(np.int64))


class Stream:
    """xoshiro256++ seeded by SplitMix64; stream(domain) is an independent generator."""

    mask = 0xFFFFFFFFFFFFFFFF

    def __init__(self, seed: int):
        self.seed, self.state = seed & self.mask, []
        x = self.seed
        for _ in range(4):
            x = (x + 0x9E3779B97F4A7C15) & self.mask
            z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & self.mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & self.mask
            self.state.append(z ^ (z >> 31))

    @staticmethod
    def turn(x: int, k: int) -> int:
        return ((x << k) | (x >> (64 - k))) & Stream.mask

    def u64(self) -> int:
        s = self.state
        out = (self.turn((s[0] + s[3]) & self.mask, 23) + s[0]) & self.mask
        t = (s[1] << 17) & self.mask
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = self.turn(s[3], 45)
        return out

    def below(self, n: int) -> int:
        return self.u64() % n

    def chance(self, p16: int) -> bool:
        return (self.u64() >> 48) < p16

    def stream(self, domain: str) -> Stream:
        return Stream(self.seed ^ fnv1a(domain.encode()))
