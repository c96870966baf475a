"""Synthetic mean functions of predictors in [-1, 1], as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which of the parts of the first function each level gets in the third mixture; other levels get
#: the two-regime function.
PARTS = {0: (1,), 1: (2,), 2: (3,), 3: (1, 2), 4: (1, 3), 5: (2, 3), 6: (1, 2, 3)}
#: Levels that get the Friedman function in the first mixture and in the second.
FIRST, SECOND = (0, 2, 4, 8), (1, 2, 3, 4, 5, 6, 7, 8, 9)


def unit(x: Column) -> Column:
    """From [-1, 1] to [0, 1]."""
    return (x + 1) / 2


def friedman_part(x: list[Column], part: int) -> Column:
    z = [unit(c) for c in x]
    bend = 10 * (z[2] - 0.5) * (z[2] - 0.5)
    return {1: 10 * F.sin(F.pi() * z[0] * z[1]), 2: bend, 3: bend + 10 * z[3] + 5 * z[4]}[part]


def friedman(x: list[Column]) -> Column:
    """The Friedman function of the first five predictors."""
    return friedman_part(x, 1) + friedman_part(x, 2) + friedman_part(x, 3)


def two_regime(x: list[Column], offset: float = 0.0, scale: float = 1.0) -> Column:
    z0, high = unit(x[0]), (unit(x[1]) > 0.5).cast("int")
    return offset + scale * (3 * z0 + (2 - 5 * high) * F.sin(F.pi() * z0) - 2 * high)


def mixture(kind: int, x: list[Column], level: Column) -> Column:
    """Mean functions 1 to 4, which mix the two above by a level from 0 to 9."""
    if kind in (1, 2):
        return F.when(level.isin(*(FIRST if kind == 1 else SECOND)), friedman(x)).otherwise(two_regime(x))
    if kind == 3:
        cases = [(k, sum((friedman_part(x, p) for p in parts), F.lit(0.0))) for k, parts in PARTS.items()]
        return reduce(lambda out, c: F.when(level == c[0], c[1]).otherwise(out), cases, two_regime(x))
    if kind == 4:
        return (level + 1) / 10 * friedman(x) + (9 - level) / 10 * two_regime(x)
    raise ValueError("a mixture is 1 to 4")
