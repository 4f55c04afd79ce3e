"""Numbers: rounding, inverse document frequency, the tail rule, and a counter-based random stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Increment and multipliers' set bits of the 32-bit mulberry generator.
STEP = 0x6D2B79F5


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), which takes -0.5 to 0, unlike SQL's round."""
    return F.floor(x + F.lit(0.5))


def idf(docs: Column, holding: Column) -> Column:
    return F.log(F.lit(1.0) + (docs - holding + F.lit(0.5)) / (holding + F.lit(0.5)))


def strict_from_tail(t1: Column, t5: Column, least: Column) -> Column:
    """The 0.1 % point extended log-linearly from the 1 % and 5 % points, never below the smallest value."""
    return F.greatest(least, t1 - (t5 - t1) * F.log(F.lit(10.0)) / F.log(F.lit(5.0)))


def _times32(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of unsigned 32-bit numbers held as longs; the halves keep it within 63 bits."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK))


def uniform(draw: Column, seed: int = 7) -> Column:
    """Draw number ``draw`` (from 0) of the mulberry stream with this seed, in [0, 1).

    The state after k draws is seed + k * STEP modulo 2**32, so any draw is computed alone: the stream is the same
    however rows are partitioned, and no generator has to run through it.
    """
    a = (F.lit(seed & MASK) + _times32((draw + F.lit(1)).bitwiseAND(F.lit(MASK)), F.lit(STEP))).bitwiseAND(F.lit(MASK))
    t = _times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    u = _times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
    t = t.bitwiseXOR((t + u).bitwiseAND(F.lit(MASK)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / F.lit(4294967296.0)


def uniform_array(draws: np.ndarray, seed: int) -> np.ndarray:
    """The same draws for whole arrays of numbers at once."""
    mask = np.uint64(MASK)
    a = (np.uint64(seed & MASK) + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)) & mask
    t = ((a ^ a >> np.uint64(15)) * (a | np.uint64(1))) & mask
    t ^= (t + (((t ^ t >> np.uint64(7)) * (t | np.uint64(61))) & mask)) & mask
    return (t ^ t >> np.uint64(14)) / 4294967296.0


def uniforms(seed: int):
    """The same stream as a Python generator, for steps that depend on the ones before."""
    a = seed & MASK
    while True:
        a = (a + STEP) & MASK
        t = ((a ^ a >> 15) * (a | 1)) & MASK
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & MASK)) & MASK
        yield (t ^ t >> 14) / 4294967296
