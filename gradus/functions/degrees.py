"""T-norms, S-norms, implicators, fuzzy sets and attribute similarities as Column expressions.

Nulls: ``least`` and ``greatest`` skip nulls, so degrees that may be null are made 1 by ``known`` first, as the measures
want it (an unknown value is similar to everything).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def known(degree: Column) -> Column:
    return F.coalesce(degree, F.lit(1.0))


T_NORMS: dict[str, Callable[[Column, Column], Column]] = {
    "algebraic": lambda a, b: a * b,
    "min": lambda a, b: F.least(a, b),
    "lukasiewicz": lambda a, b: F.greatest(a + b - 1, F.lit(0.0)),
}
S_NORMS: dict[str, Callable[[Column, Column], Column]] = {
    "algebraic": lambda a, b: a + b - a * b,
    "max": lambda a, b: F.greatest(a, b),
    "lukasiewicz": lambda a, b: F.least(F.lit(1.0), a + b),
    "einstein": lambda a, b: (a + b) / (1 + a * b),
    "drastic": lambda a, b: F.when(a == 0, b).when(b == 0, a).otherwise(F.lit(1.0)),
    "sum": lambda a, b: a + b,
}
IMPLICATORS: dict[str, Callable[[Column, Column], Column]] = {
    "lukasiewicz": lambda a, b: F.least(F.lit(1.0), 1 - a + b),
    "kleene_dienes": lambda a, b: F.greatest(1 - a, b),
    "reichenbach": lambda a, b: 1 - a + a * b,
    "goedel": lambda a, b: F.when(a <= b, F.lit(1.0)).otherwise(b),
    "gaines": lambda a, b: F.when(a <= b, F.lit(1.0)).otherwise(F.try_divide(b, a)),
}
DUAL = {"algebraic": "algebraic", "min": "max", "lukasiewicz": "lukasiewicz"}


def t_norm_generalised(alpha: float):
    return lambda a, b: F.pow(F.greatest(F.lit(0.0), F.pow(a, F.lit(alpha)) + F.pow(b, F.lit(alpha)) - 1), F.lit(1 / alpha))


def s_norm_generalised(alpha: float):
    return lambda a, b: F.pow(F.least(F.lit(1.0), F.pow(a, F.lit(alpha)) + F.pow(b, F.lit(alpha))), F.lit(1 / alpha))


def implicator_generalised(alpha: float):
    return lambda a, b: F.pow(F.least(F.lit(1.0), 1 - F.pow(a, F.lit(alpha)) + F.pow(b, F.lit(alpha))), F.lit(1 / alpha))


def fold(norm: str | Callable, degrees: list[Column]) -> Column:
    """The T-norm of all degrees; 1 for none."""
    return reduce(T_NORMS[norm] if isinstance(norm, str) else norm, degrees) if degrees else F.lit(1.0)


def triangular(x: Column, a: float, b: float, c: float) -> Column:
    return F.greatest(F.lit(0.0), F.least((x - a) / (b - a), (c - x) / (c - b)))


def trapezoidal(x: Column, a: float, b: float, c: float, d: float) -> Column:
    return F.greatest(F.lit(0.0), F.least((x - a) / (b - a), F.lit(1.0), (d - x) / (d - c)))


def left_shoulder(x: Column, a: float, b: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b - x) / (b - a)))


def right_shoulder(x: Column, a: float, b: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))


def gaussian(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * sd * sd))


def _range(stats: dict) -> float:
    spread = (stats["max"] or 0) - (stats["min"] or 0)
    return float(spread) or 1.0


def _sd(stats: dict) -> float:
    return float(stats["sd"] or 0) or 1e-6


def _of_both(x: Column, y: Column, degree: Column) -> Column:
    """``degree``, null where a value is: ``least`` and ``greatest`` alone would make a number of it."""
    return F.when(x.isNotNull() & y.isNotNull(), degree)


#: Similarity of two values of an attribute with statistics min, max, sd, null where one of them is; equality for labels.
SIMILARITIES: dict[str, Callable[[Column, Column, dict], Column]] = {
    "linear": lambda x, y, s: _of_both(x, y, F.greatest(F.lit(0.0), 1 - F.abs(x - y) / _range(s))),
    "gaussian": lambda x, y, s: F.exp(-((x - y) * (x - y)) / (2 * _sd(s) ** 2)),
    "tolerance": lambda x, y, s: _of_both(x, y, F.greatest(F.least((y - (x - _sd(s))) / _sd(s), ((x + _sd(s)) - y) / _sd(s)), F.lit(0.0))),
    "slope": lambda x, y, s: _of_both(x, y, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.get("beta", 1.0) - s.get("alpha", 0.5) * F.abs(x - y) / _range(s)))),
    "equal": lambda x, y, s: (x == y).cast("double"),
    "squared": lambda x, y, s: (x - y) * (x - y),
}


def quantifier(x: Column, alpha: float = 0.2, beta: float = 1.0) -> Column:
    """Vague 'most': 0 up to alpha, a quadratic S to 1 at beta."""
    mid, width = (alpha + beta) / 2, (beta - alpha) ** 2
    return F.when(x <= alpha, F.lit(0.0)).when(x <= mid, 2 * (x - alpha) * (x - alpha) / width).when(x <= beta, 1 - 2 * (x - beta) * (x - beta) / width).otherwise(F.lit(1.0))
