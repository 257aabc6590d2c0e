"""A small logistic model over hashed features, fitted on a bounded sample and sent to tasks as one array."""

from __future__ import annotations

from zlib import crc32

import numpy as np

BITS = 18
MASK = (1 << BITS) - 1


def index(feature: str) -> int:
    return crc32(feature.encode("utf-8", "replace")) & MASK


def hashed(features: list[str]) -> list[int]:
    return [crc32(f.encode("utf-8", "replace")) & MASK for f in features]


def matrix(rows: list[list[int]]) -> np.ndarray:
    """Rows of indexes, padded with the index of an unused weight."""
    wide = max((len(r) for r in rows), default=1)
    out = np.full((len(rows), wide), MASK + 1, dtype=np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def fit(rows: list[list[int]], labels: np.ndarray, epochs: int = 6, rate: float = 0.25, decay: float = 2e-6, seed: int = 1) -> np.ndarray:
    """Weights of a logistic regression by AdaGrad over shuffled batches."""
    x, y = matrix(rows), np.asarray(labels, dtype=np.float64)
    w, seen = np.zeros(MASK + 2), np.full(MASK + 2, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            xi = x[part]
            error = y[part] - 1 / (1 + np.exp(-w[xi].sum(1)))
            step = np.repeat(error / len(part) * 16, xi.shape[1])
            flat = xi.ravel()
            np.add.at(seen, flat, step * step)
            np.add.at(w, flat, rate * step / np.sqrt(seen[flat]))
            w[MASK + 1] = 0.0
        w *= 1 - decay * len(x)
    return w.astype(np.float32)


def score(w: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """Log odds of each row."""
    return w[matrix(rows)].sum(1) if rows else np.zeros(0, dtype=np.float32)
