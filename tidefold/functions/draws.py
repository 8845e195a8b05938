"""Repeatable draws, the same in column expressions, in numpy and in SQL.

A draw is a 32-bit hash of its place, so any task makes it and a lost task makes
it again. Every step stays below 2**59, so signed 64-bit integers suffice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FACTOR = 0x45D9F3B
MASK = 0xFFFFFFFF


def mixed(h: Column) -> Column:
    """Spread 32 bits (a bijection)."""
    for _ in range(2):
        h = (F.shiftrightunsigned(h, 16).bitwiseXOR(h) * F.lit(FACTOR)).bitwiseAND(F.lit(MASK))
    return F.shiftrightunsigned(h, 16).bitwiseXOR(h)


def draw(n: Column, key: Column, replicate: Column, place: Column) -> Column:
    """A number in 0..n-1 for a place of a replicate; ``key`` holds 32 bits."""
    return F.pmod(mixed(mixed(key.bitwiseXOR(replicate)).bitwiseXOR(place)), n)


def mixed_array(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (((h >> 16) ^ h) * FACTOR) & MASK
    return (h >> 16) ^ h


def draw_array(n: int, key: int, replicates: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Draws of every replicate (rows) at every place (columns)."""
    rows = mixed_array(replicates.astype(np.int64) ^ key)
    return mixed_array(rows[:, None] ^ places.astype(np.int64)[None]) % n
