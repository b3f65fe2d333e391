"""A regularised logistic regression on sparse hashed features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from quern.llm.canon import canonical

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")


def text_features(text: str | None, size: int, pairs: bool = True) -> np.ndarray:
    """Hashed words, signs and neighbouring words of a text's consistent form, each once."""
    t = _TOKEN.findall(canonical(text).lower()) if text else []
    keys = set(t)
    if pairs:
        keys.update(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))
    return np.fromiter({xxhash.xxh3_64_intdigest(k) % size for k in keys}, np.int32, -1)


class Sparse:
    """Rows of 0/1 features, as flat indexes and offsets."""

    def __init__(self, rows: list[np.ndarray], scale: float | None = None) -> None:
        """scale: one for all rows; by the row's length if null."""
        n = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), n)
        self.at = np.concatenate(rows).astype(np.int64) if len(rows) and n.sum() else np.empty(0, np.int64)
        self.scale = 1 / np.sqrt(np.maximum(n, 1)) if scale is None else np.full(len(rows), scale)
        self.norm = float((n * self.scale**2).max(initial=1.0))
        self.rows = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.rows) * self.scale

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, (g * self.scale)[self.row], size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, size: int, l2: float, steps: int = 60, start: tuple[np.ndarray, float] | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias for targets between 0 and 1, by accelerated gradient steps."""
    w, b = start or (np.zeros(size), 0.0)
    if not x.rows:
        return w, b
    weight = np.ones(x.rows) if weight is None else weight
    total = weight.sum()
    rate = 1 / (0.25 * (x.norm + 1) + l2 / total)  # bounds the curvature
    pw, pb = w, b
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        g = (sigmoid(x.dot(vw) + vb) - y) * weight
        pw, pb = w, b
        w = vw - rate * (x.back(g, size) + l2 * vw) / total
        b = vb - rate * g.sum() / total
    return w, b


def log_ratios(x: Sparse, y: np.ndarray, size: int, weight: np.ndarray, least: int = 2) -> np.ndarray:
    """Smoothed log ratio of each feature's frequency for y = 1 against y = 0; 0 for features of fewer than ``least`` rows."""
    one, two = np.bincount(x.at, (weight * y)[x.row], size), np.bincount(x.at, (weight * (1 - y))[x.row], size)
    n1, n0 = max((weight * y).sum(), 1e-9), max((weight * (1 - y)).sum(), 1e-9)
    r = np.log((one + n1 / (n1 + n0)) / n1) - np.log((two + n0 / (n1 + n0)) / n0)
    return np.where(np.bincount(x.at, minlength=size) >= least, r, 0.0)


def fit_scaled(x: Sparse, y: np.ndarray, size: int, l2: float, steps: int, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """As ``fit``, with each feature scaled by its log ratio, so that telling features are learnt at once.

    Weights count by their proportions, with a mean of 1: what a sample gives
    doesn't depend on how large a table it stands for. Else smoothing and
    ``l2`` would be lost beside the weights of a large one.
    """
    if not x.rows:
        return np.zeros(size), 0.0
    weight = weight / weight.mean()
    r = log_ratios(x, y, size, weight)
    used = np.flatnonzero(r)
    v, total = np.full(size, 0.3), weight.sum()
    z = x.dot(r * v)
    b = -float(np.average(z, weights=weight)) + float(np.log((weight * y).sum() + 1e-3) - np.log((weight * (1 - y)).sum() + 1e-3))
    one, two = np.zeros(len(used) + 1), np.zeros(len(used) + 1)  # Adam's moments, the bias last
    for k in range(1, steps + 1):
        g = (sigmoid(x.dot(r * v) + b) - y) * weight
        d = np.append((r * x.back(g, size) + l2 * v)[used], g.sum()) / total
        one, two = 0.9 * one + 0.1 * d, 0.99 * two + 0.01 * d * d
        move = 0.05 * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-12)
        v[used] -= move[:-1]
        b -= float(move[-1]) * 4
    return r * v, b


def score_rows(rows: list[np.ndarray], w: np.ndarray, b: float, scale: float | None = None) -> np.ndarray:
    return Sparse(rows, scale).dot(w) + b if rows else np.empty(0)
