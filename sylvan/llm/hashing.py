"""Hashes of many substrings at once: polynomial prefix sums modulo 2**64, mixed afterwards."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 16)
        for name, x in (("up", MULTIPLIER), ("down", INVERSE)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], of their bytes alone."""
    _, down = _power_tables(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])
