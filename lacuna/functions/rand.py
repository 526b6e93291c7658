"""Randomness keyed by row, seed and draw: the same under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Sequence[str | Column], seed: int, draw: int = 0) -> Column:
    """In [0, 1), from the top 53 bits of a hash."""
    h = F.xxhash64(F.lit(seed), F.lit(draw), *key)
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def normal(key: Sequence[str | Column], seed: int, draw: int = 0) -> Column:
    """Standard normal, by Box-Muller."""
    u = F.greatest(uniform(key, seed, 2 * draw), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * uniform(key, seed, 2 * draw + 1))


def lattice(key: Column, seed: int, modulus: int = 1000) -> Column:
    """An integer hash below ``modulus`` that plain SQL can repeat: (key * 7919 + seed) mod modulus."""
    return F.pmod(key.cast("long") * 7919 + seed, F.lit(modulus))


def generator(*parts: object) -> np.random.Generator:
    """A numpy generator for a group, seeded by its name and not by its place."""
    import hashlib

    digest = hashlib.blake2b(repr(parts).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "little")))
