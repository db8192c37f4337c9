"""The E8 lattice: nearest points and neighbouring cells, for arrays of vectors."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def roots() -> np.ndarray:
    """The 240 shortest vectors: two whole coordinates of size 1, or all coordinates of size 1/2 with an even number of minus signs."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array([*whole, *half])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point of whole coordinates with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=-1) % 2)
    if len(odd):
        rest = x[odd] - near[odd]
        worst = np.abs(rest).argmax(axis=-1)
        near[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points of rows of eight coordinates: the better of the even points and those shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=-1) <= ((x - b) ** 2).sum(axis=-1)
    return np.where(closer[:, None], a, b)
