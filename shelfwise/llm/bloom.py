"""Bloom filters as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BloomFilter:
    """One Bloom filter: ``bits`` bits in words of 64, and ``hashes`` places for each key."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        bits = 64 * math.ceil(max(64, -n * math.log(rate) / math.log(2) ** 2) / 64)
        return bits, max(1, min(24, round(bits / max(n, 1) * math.log(2))))

    def accepts(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a literal
        out = F.lit(True)
        for place in places(key, self.bits, self.hashes, self.seed):
            out = out & (F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1)
        return out


def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first, second = F.xxhash64(F.lit(seed), key), F.xxhash64(F.lit(~seed), key)
    return [F.pmod(first + F.lit(i) * F.pmod(second, F.lit((1 << 31) - 1)).bitwiseOR(F.lit(1)), F.lit(bits)) for i in range(hashes)]


def build_filter(keys: DataFrame, n: int, rate: float, seed: int = 1) -> BloomFilter:
    """A filter of the column ``key``; at most ``bits`` / 64 words come to the driver."""
    bits, hashes = BloomFilter.shape(n, rate)
    at = keys.select(F.explode(F.array(*places(F.col("key"), bits, hashes, seed))).alias("at")).distinct()
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
    words = [0] * (bits // 64)
    for row in found.collect():
        words[row.word] = row.value
    return BloomFilter(tuple(words), bits, hashes, seed)
