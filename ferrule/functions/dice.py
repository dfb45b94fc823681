"""Reproducible random numbers that SQL can say too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime below 2**31, so products of two residues fit 64 bits.
PRIME = (1 << 31) - 1


def mixed(a: str | Column, b: str | Column, seed: int = 0) -> Column:
    """An integer in [0, PRIME) of two integers, evenly spread: squares alternate with linear steps."""
    x = F.pmod(F.pmod(_col(a) + 1, F.lit(PRIME)) * 48271 + F.pmod(_col(b) + 1, F.lit(PRIME)) * 69621 + seed, F.lit(PRIME).cast("bigint"))
    for k in range(3):
        x = F.pmod(x * x + F.lit(16807 + k), F.lit(PRIME).cast("bigint"))
        x = F.pmod(x * 742938285 + F.lit(950706376), F.lit(PRIME).cast("bigint"))
    return x


def _col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def mixed_sql(a: str, b: str, seed: int = 0) -> str:
    """mixed() for DuckDB, of non-negative integers."""
    x = f"((({a})::BIGINT + 1) % {PRIME} * 48271 + (({b})::BIGINT + 1) % {PRIME} * 69621 + {seed}) % {PRIME}"
    for k in range(3):
        x = f"list_transform([{x}], lambda z: (z * z + {16807 + k}) % {PRIME})[1]"
        x = f"({x} * 742938285 + 950706376) % {PRIME}"
    return f"({x})"


def mixed_array(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """mixed() of arrays that broadcast against each other."""
    x = (np.mod(a + 1, PRIME) * 48271 + np.mod(b + 1, PRIME) * 69621 + seed) % PRIME
    for k in range(3):
        x = (x * x + 16807 + k) % PRIME
        x = (x * 742938285 + 950706376) % PRIME
    return x
