"""Rolling hashes of runs of neighbours, from unsigned 64-bit hashes of the single items."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse, modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 4096)
        one = np.ones(1, np.uint64)
        known = tuple(
            np.concatenate([one, np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64))
        )
        if size <= 1 << 20:
            _POWERS[base] = known
    return known[0][:n], known[1][:n]


def rolling(hashes: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every run of ``n`` neighbours, from the hashes of the single words (unsigned 64-bit)."""
    up, down = _powers(base, len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
    return (sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1]


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """Values spread over all 64 bits, differently for each seed."""
    x = values ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))
