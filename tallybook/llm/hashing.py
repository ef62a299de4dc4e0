"""Vectorised 64-bit hashing of pieces of byte strings."""

from __future__ import annotations

import numpy as np

_BYTES = np.random.default_rng(71).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``length`` of them."""
    if len(_powers[0]) < length:
        size = 1 << int(length).bit_length()
        for place, factor in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, np.uint64(factor))
            table[0] = 1
            _powers[place] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``pieces`` takes the hash of any piece of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def pieces(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each piece; equal pieces have equal ones wherever they stand."""
    inverse = power_tables(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
