"""Keyed pseudo-random values that depend on data, never on its layout.

``rand(seed)`` follows partition order, so a recomputed plan may deal
different numbers. Both keys here are functions of a seed and a value: the
same input gets the same key under any partitioning, retry or engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier of the public 32-bit integer finaliser, the 32-bit
# mask, and the two stream constants. 32 x 27 bits cannot overflow a long.
MULTIPLIER = 0x45D9F3B
MASK32 = 0xFFFFFFFF
STREAM_A = 0x1B873593
STREAM_B = 0x2545F491


def row_key(seed: int, value: Column) -> Column:
    """32 hex digits for one row, in uniformly random order.

    Uses its input once, so it stays cheap where Spark inlines it into a
    filter, which has no common-subexpression elimination.
    """
    return F.md5(F.concat_ws("|", F.lit(seed), value))


def row_hash(columns) -> Column:
    """16 hex digits over all given columns: equal for copies of a row."""
    return F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")


def _mix32_int(x: int) -> int:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MULTIPLIER) & MASK32
    return x ^ (x >> 16)


def _mix32(x: Column) -> Column:
    for _ in range(2):
        x = ((x.bitwiseXOR(F.shiftright(x, 16))) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK32))
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw_seeds(seed: int) -> tuple[int, int]:
    """Two 32-bit start values for one user seed."""
    return _mix32_int((seed ^ STREAM_A) & MASK32), _mix32_int((seed ^ STREAM_B) & MASK32)


def draw(seed: int, number: Column) -> Column:
    """A 60-bit non-negative number for a draw number (a non-null long).

    Integer arithmetic only, several times cheaper than a digest. It refers
    to its input many times over: project it or aggregate it, where generated
    code evaluates shared parts once, but do not filter on it.
    """
    low = number.bitwiseAND(F.lit(MASK32))
    high = F.shiftrightunsigned(number, 32)
    start_a, start_b = draw_seeds(seed)
    a = _mix32(_mix32(high.bitwiseXOR(F.lit(start_a))).bitwiseXOR(low))
    b = _mix32(_mix32(low.bitwiseXOR(F.lit(start_b))).bitwiseXOR(high))
    return F.shiftleft(F.shiftright(a, 2), 30) + F.shiftright(b, 2)
