"""Hashes with wrapping 32- and 64-bit arithmetic, as vectorised functions: built-in arithmetic raises on overflow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
LOW32 = U(0xFFFFFFFF)

# Multipliers of the mixing hashes, the seed of the tie hash, offset and prime of the byte hash.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SPLIT_STEP = 0x9E3779B97F4A7C15
SPLIT = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHARD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
TIE_SEED = 11
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """The hash that orders s-mers and thins keys."""
    x = x.astype(U)
    for m in MIX:
        x = (x ^ (x >> U(33))) * U(m)
    return x ^ (x >> U(33))


def split_mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U) + U(SPLIT_STEP)
    for shift, m in zip((30, 27), SPLIT, strict=True):
        x = (x ^ (x >> U(shift))) * U(m)
    return x ^ (x >> U(31))


def shard_mix(x: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one mix of keys of `bits` bits, 3 or more."""
    mask, first, second = U((1 << bits) - 1), U(bits // 3), U(bits // 2)
    x = x.astype(U) & mask
    for shift, m in ((first, SHARD[0]), (second, SHARD[1])):
        x = ((x ^ (x >> shift)) * U(m)) & mask
    return x ^ (x >> first)


def wang64(x: np.ndarray) -> np.ndarray:
    x = x.astype(U)
    x = ~x + (x << U(21))
    x ^= x >> U(24)
    x = x * U(265)
    x ^= x >> U(14)
    x = x * U(21)
    x ^= x >> U(28)
    return x + (x << U(31))


def wang32(x: np.ndarray) -> np.ndarray:
    x = x.astype(U) & LOW32
    x = (x + (~(x << U(15)) & LOW32)) & LOW32
    x ^= x >> U(10)
    x = (x * U(9)) & LOW32
    x ^= x >> U(6)
    x = (x + (~(x << U(11)) & LOW32)) & LOW32
    return x ^ (x >> U(16))


def byte_hash(texts: pd.Series) -> np.ndarray:
    """FNV-1a of the upper-cased bytes; all texts go forward together, one byte a step."""
    raw = [t.encode() for t in texts]
    out = np.full(len(raw), FNV_OFFSET, dtype=U)
    size = np.array([len(b) for b in raw])
    order = np.argsort(-size, kind="stable")
    for at in range(int(size.max(initial=0))):
        some = order[: np.searchsorted(-size[order], -at)]
        byte = np.array([raw[i][at] for i in some], dtype=U)
        byte = np.where((byte >= 97) & (byte <= 122), byte - U(32), byte)
        out[some] = (out[some] ^ byte) * U(FNV_PRIME)
    return out


def log2_bits(x: np.ndarray) -> np.ndarray:
    """log2 of positive single-precision numbers from their exponent bits and a parabola over the fraction."""
    bits = x.astype(np.float32).view(np.uint32)
    exponent = ((bits >> 23) & 255).astype(np.float32) - np.float32(128)
    fraction = ((bits & np.uint32(0x807FFFFF)) | np.uint32(127 << 23)).view(np.float32)
    return exponent + ((np.float32(-0.34484843) * fraction + np.float32(2.02466578)) * fraction - np.float32(0.67487759))


def _numbers(f) -> Column:
    """f over the uint64 values of a long column, as decimal text: Spark has no unsigned type."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy().astype(np.int64).view(U)).astype(str), dtype=object)

    return run


def order_hash(key: Column) -> Column:
    return _numbers(mix)(key)


def split_hash(key: Column) -> Column:
    return _numbers(split_mix)(key)


def shard_hash(key: Column, bits: int) -> Column:
    return _numbers(lambda x: shard_mix(x, bits))(key)


def identity(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(byte_hash(t.fillna("")).astype(str), dtype=object)

    return run(text)


def approximate_log2(x: Column) -> Column:
    @F.pandas_udf("float")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(log2_bits(v.to_numpy()))

    return run(x)


def read_seed(name_hash: Column, length: Column) -> Column:
    """The tie seed of a query, from the hash of its name (0 without one) and its length."""

    @F.pandas_udf("long")
    def run(name: pd.Series, size: pd.Series) -> pd.Series:
        own = wang32(size.to_numpy()) + wang32(np.array([TIE_SEED]))
        return pd.Series(wang32(name.to_numpy().astype(U) ^ (own & LOW32)).astype(np.int64))

    return run(name_hash, length)


def locus_hash(seed: Column, contig: Column, reverse: Column, place: Column) -> Column:
    """The rank of one locus among loci of equal evidence, as decimal text."""

    @F.pandas_udf("string")
    def run(s: pd.Series, c: pd.Series, r: pd.Series, p: pd.Series) -> pd.Series:
        key = (r.to_numpy().astype(U) << U(63)) | ((c.to_numpy().astype(np.int64).view(U) & U(0x7FFFFFFF)) << U(32)) | (p.to_numpy().astype(np.int64).view(U) & LOW32)
        return pd.Series(wang64(wang64(key) ^ s.to_numpy().astype(U)).astype(str), dtype=object)

    return run(seed, contig, reverse, place)


def kept_by_hash(key: Column, n: int) -> Column:
    """Whether the mixing hash of a key is a multiple of n."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(mix(x.to_numpy().astype(np.int64).view(U)) % U(n) == 0)

    return run(key)
