"""Counter-based uniform numbers for use inside tasks: each depends on its keys only."""
from __future__ import annotations

import numpy as np

# Increment and multipliers of the public splitmix64 generator.
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


def keyed_uniform(ids: np.ndarray, step: int, units: int, seed: int) -> np.ndarray:
    """Matrix (rows x units) of uniform numbers in [0, 1) keyed by row id, step, unit and seed."""
    with np.errstate(over="ignore"):
        base = _mix(np.asarray(ids).astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * _GAMMA)
        at = np.uint64(step) * np.uint64(1 << 20) + np.arange(units, dtype=np.uint64)
        z = _mix(base[:, None] + (at + np.uint64(1)) * _GAMMA)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
