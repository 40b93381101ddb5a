"""Recursions that need no rows, as SQL folds over a horizon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def open_loop_variance(a: float, q: float, v0: float, horizon: Column) -> Column:
    """v <- a*a*v + q, ``horizon`` times."""
    return F.aggregate(F.sequence(F.lit(1), horizon), F.lit(float(v0)), lambda v, _: v * (a * a) + q)
