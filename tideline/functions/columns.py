"""Column helpers shared by the operators: value semantics of the scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within [low, high]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def nz(x: Column) -> Column:
    """Negative zero becomes zero, so that equal values are equal bits."""
    return x + F.lit(0.0)


def band(x: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """The name of the first step that x is below."""
    out = None
    for limit, name in steps:
        out = F.when(x < limit, name) if out is None else out.when(x < limit, name)
    return F.when(x.isNotNull(), out.otherwise(top))


def severity(x: Column) -> Column:
    return band(x, [(0.35, "low"), (0.6, "medium"), (0.85, "high")], "critical")


def tier(x: Column) -> Column:
    return band(x, [(0.3, "internal"), (0.6, "agent"), (0.8, "public")], "headline")
