"""Similarities and T-norms of ``degrees`` over NumPy arrays, for meetings of blocks. NaN is an unknown value; an unknown degree is 1."""

from __future__ import annotations

import numpy as np

from .degrees import _range, _sd

T_NORMS = {
    "algebraic": lambda a, b: a * b,
    "min": np.minimum,
    "lukasiewicz": lambda a, b: np.maximum(a + b - 1, 0.0),
}
SIMILARITIES = {
    "linear": lambda x, y, s: np.maximum(0.0, 1 - np.abs(x - y) / _range(s)),
    "gaussian": lambda x, y, s: np.exp(-((x - y) * (x - y)) / (2 * _sd(s) ** 2)),
    "tolerance": lambda x, y, s: np.maximum(np.minimum((y - (x - _sd(s))) / _sd(s), ((x + _sd(s)) - y) / _sd(s)), 0.0),
    "slope": lambda x, y, s: np.maximum(0.0, np.minimum(1.0, s.get("beta", 1.0) - s.get("alpha", 0.5) * np.abs(x - y) / _range(s))),
    "equal": lambda x, y, s: np.where(np.isnan(x) | np.isnan(y), np.nan, x == y),
    "squared": lambda x, y, s: (x - y) * (x - y),
}
IMPLICATORS = {
    "lukasiewicz": lambda a, b: np.minimum(1.0, 1 - a + b),
    "kleene_dienes": lambda a, b: np.maximum(1 - a, b),
    "reichenbach": lambda a, b: 1 - a + a * b,
    "goedel": lambda a, b: np.where(a <= b, 1.0, b),
    "gaines": lambda a, b: np.where(a <= b, 1.0, b / np.where(a == 0, 1.0, a)),
}


def quantifier(x: np.ndarray, alpha: float = 0.2, beta: float = 1.0) -> np.ndarray:
    mid, width = (alpha + beta) / 2, (beta - alpha) ** 2
    return np.where(x <= alpha, 0.0, np.where(x <= mid, 2 * (x - alpha) ** 2 / width, np.where(x <= beta, 1 - 2 * (x - beta) ** 2 / width, 1.0)))


def similarities(x: np.ndarray, y: np.ndarray, kind: str, norm: str, stats: list[dict]) -> np.ndarray:
    """Of each row of ``x`` and each of ``y`` the norm of their columns' similarities; 1 without columns."""
    out = np.ones((len(x), len(y)))
    for c, s in enumerate(stats):
        one = SIMILARITIES[kind](x[:, c, None], y[None, :, c], s)
        one = np.where(np.isnan(one), 1.0, one)
        out = one if c == 0 else T_NORMS[norm](out, one)
    return out
