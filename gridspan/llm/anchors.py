"""Winnowed anchors: the places that two equal stretches of symbols are sure to share."""

from __future__ import annotations

import numpy as np


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + width] for every full window, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(hashes: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys of all places): places of the smallest key, the hash and then the
    leftmost of equal hashes, in each run of ``width`` places.

    ``valid`` says whether the run that starts at a place counts (it lies within one
    document). Equal stretches of at least ``width`` hashes choose the same places, for the
    choice looks at nothing outside the run.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), hashes
    bits = np.uint64(max(24, int(n - 1).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    least = _sliding(keys, width, np.minimum)
    least[~valid[: len(least)]] = 0
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, width, np.maximum) == keys), keys
