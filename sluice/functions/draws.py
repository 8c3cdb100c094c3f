"""Repeatable draws for use inside Python tasks."""

from __future__ import annotations

import hashlib

import numpy as np

P31 = 2147483647


def hashed_draws(prefix: str, count: int, n: int) -> np.ndarray:
    """The draws of :func:`sluice.functions.exprs.draws`, as an array."""
    base = int(hashlib.md5(prefix.encode()).hexdigest()[:7], 16)
    v = (base + np.arange(1, count + 1, dtype=np.int64) * 1640531527) % P31
    for _ in range(2):
        v = (v ^ (v >> 16)) * 73244475 % P31
    return (v ^ (v >> 16)) % n
