"""Bloom filters as constants in a plan, built and read by DataFrame functions."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

PER_BYTE = 7  # a byte under 128 is a character of its own, so that SQL functions can read it in constant time
#: A filter is dealt into segments of as many bits at most (1 MB) by a hash of the key; they are gathered one at a time.
SEGMENT_BITS = PER_BYTE << 20


class Level(NamedTuple):
    """One Bloom filter: bits of a segment, hash functions, a seed, and the bits of each segment, 7 in a byte."""

    bits: int
    hashes: int
    seed: int
    segments: tuple[bytes, ...]


def _segment(key: Column, segments: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit("segment")), F.lit(segments)) if segments > 1 else F.lit(0).cast("long")


def _positions(key: Column, bits: int, hashes: int, seed: int) -> Column:
    one, two = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key)
    return F.array(*[F.pmod(F.xxhash64(one, two, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def contains(key: Column, level: Level) -> Column:
    """Whether the filter holds key, perhaps wrongly. The filter is in the plan once."""
    data = F.lit(bytearray(level.segments[0]))
    if len(level.segments) > 1:
        data = F.element_at(F.array(*[F.lit(bytearray(s)) for s in level.segments]), (_segment(key, len(level.segments), level.seed) + 1).cast("int"))

    def bit(p: Column) -> Column:
        byte = F.ascii(F.substring(data, (F.floor(p / PER_BYTE) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.call_function("shiftright", byte, (p % PER_BYTE).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(_positions(key, level.bits, level.hashes, level.seed), bit)


def fill(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n keys (column key), which takes others wrongly at about this rate. It has about
    1.44 * log2(1 / rate) bits a key, at any n."""
    wanted = max(8, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    segments = -(-wanted // SEGMENT_BITS)
    bits = -(-wanted // segments)
    hashes = max(1, round(math.log2(1 / rate)))
    at = keys.select(_segment(F.col("key"), segments, seed).alias("s"), F.explode(_positions(F.col("key"), bits, hashes, seed)).alias("p"))
    at = at.groupBy("s", F.floor(F.col("p") / PER_BYTE).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % PER_BYTE).cast("int"))).alias("b"))
    if segments > 1:
        at = materialize(at, "bloom")
    out = []
    for s in range(segments):
        found = at.where(F.col("s") == s).select("i", "b").toArrow()
        data = bytearray(math.ceil(bits / PER_BYTE))
        np.frombuffer(data, np.uint8)[found.column("i").to_numpy()] = found.column("b").to_numpy()
        out.append(bytes(data))
    if segments > 1:
        discard(at)
    return Level(bits, hashes, seed, tuple(out))
