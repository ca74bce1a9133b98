"""Pieces of one array, by place and size."""

from __future__ import annotations

import numpy as np


def gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``pool`` one after the other."""
    upto = np.cumsum(size)
    return pool[np.repeat(at - upto + size, size) + np.arange(upto[-1])] if len(size) else pool[:0]


def equal(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pieces of the same size (at least 1) are equal throughout."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(gather(one, a, size) == gather(two, b, size), np.cumsum(size) - size)
