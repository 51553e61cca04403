"""Keyed permutations computed in the row: a Feistel network over two digits, without a sort, a join or a shuffle.

A number below n is written as two digits of radix a and b with a * b just above n. Each round adds to one digit a function of the
other and of the key, which is undone by taking it away again, so the whole is a bijection whatever the function. Results
of n and more are sent through again; there are a * b - n such numbers, so that is how often it can be needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infotraj.sources.trajectory import TYPES

#: A prime below 2^31: products of two remainders fit into 64 bits. What each round mixes the key with.
PRIME = 2147483647
MIX = [(48271, 11), (69621, 257), (16807, 65537), (630360016, 7919), (742938285, 104729), (950706376, 1299709)]
ROUNDS = len(MIX)
#: Radices tried for a product close to n.
TRIED = 2000


def radices(n: int) -> tuple[int, int]:
    """Two radices near the root of n whose product is the least one that is not below n."""
    root = max(1, math.isqrt(n))
    off = min(TRIED // 2, root // 2)  # a digit of one value would mix nothing
    return min(((a, max(1, -(-n // a))) for a in range(root - off, root + off + 1)), key=lambda r: (r[0] * r[1], abs(r[0] - r[1])))


def key_of(seed: int, *parts: Column) -> Column:
    """A key below PRIME from a seed and numbers of the row."""
    key = F.lit(seed % PRIME).cast("long")
    for p in parts:
        key = (key * 48271 + p.cast("long") + 12345) % PRIME
    return key


def permuted_number(x: Column, n: int, key: Column) -> Column:
    """Where x goes, of the numbers 0 to n - 1. Numbers outside stay as they are."""
    a, b = radices(n)
    if a > 1 << 31 or b > 1 << 31:
        raise ValueError("a permutation of at most 2^62 numbers")
    mixes = [F.array(*[F.lit(m[i]).cast("long") for m in MIX]) for i in (0, 1)]

    def step(d: Column, k: Column) -> Column:
        times, plus = F.element_at(mixes[0], k + 1), F.element_at(mixes[1], k + 1)
        add = lambda v: F.transform(F.array((v + (key * times + plus) % PRIME) % PRIME), lambda y: (y * y) % PRIME * times % PRIME)[0]
        odd = k % 2 == 1
        return F.struct(F.when(odd, d["h"]).otherwise((d["h"] + add(d["l"])) % a).alias("h"), F.when(odd, (d["l"] + add(d["h"])) % b).otherwise(d["l"]).alias("l"))

    def once(v: Column) -> Column:  # the digits are a lambda's variable, so that each is computed once and not for every time it is used
        start = F.struct(F.floor((v - v % b) / b).cast("long").alias("h"), (v % b).cast("long").alias("l"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda d: d["h"] * b + d["l"])

    x = x.cast("long")
    out = once(x)
    if a * b > n:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), out, lambda got, _: F.when(got >= n, once(got)).otherwise(got))
    return F.when((x >= 0) & (x < n), out).otherwise(x)


def shuffled_frames(df: DataFrame, n_frames: int, seed: int, per_dof: bool = False) -> DataFrame:
    """df(dof_type, dof, frame, ...) with a column `to`: one permutation of the frames for all, or one for each degree of freedom."""
    place = F.array_position(F.array(*map(F.lit, TYPES)), F.col("dof_type"))
    key = key_of(seed, place, F.col("dof")) if per_dof else key_of(seed)
    return df.withColumn("to", permuted_number(F.col("frame"), n_frames, key))


def shuffled_blocks(df: DataFrame, n_frames: int, blocks: int, seed: int) -> DataFrame:
    """df(frame, ...) with a column `to`: blocks of successive frames change places, frames within one stay together.

    Frames beyond a multiple of the block stay where they are.
    """
    size = max(1, n_frames // max(1, blocks))
    to = permuted_number(F.floor(F.col("frame") / size), min(blocks, n_frames), key_of(seed)) * size + F.col("frame") % size
    return df.withColumn("to", F.when(F.col("frame") < size * blocks, to).otherwise(F.col("frame")).cast("long"))


def plain_permutation(x: int, n: int, key: int) -> int:
    """The same for one number, in Python."""
    a, b = radices(n)
    while True:
        high, low = divmod(x, b)
        for k, (times, plus) in enumerate(MIX):
            y = ((high if k % 2 else low) + (key * times + plus) % PRIME) % PRIME
            mixed = (y * y) % PRIME * times % PRIME
            high, low = (high, (low + mixed) % b) if k % 2 else ((high + mixed) % a, low)
        x = high * b + low
        if x < n:
            return x
