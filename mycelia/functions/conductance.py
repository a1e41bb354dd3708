"""Edge strength as a function of the number of sightings: g(1) = 0.1, g(n + 1) = g(n) + 0.1 / (1 + g(n))."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 0.1
#: Up to so many sightings the recurrence is folded, beyond it is continued in closed form (within 1e-6 of the recurrence).
FOLDED = 2048


def _square() -> float:
    """(1 + g)^2 at ``FOLDED`` sightings."""
    g = STEP
    for _ in range(FOLDED - 1):
        g += STEP / (1 + g)
    return (1 + g) ** 2


_SQUARE = _square()


def folded(repetitions: Column) -> Column:
    """The recurrence as a fold inside the expression; nought or fewer sightings give null."""
    n = F.greatest(repetitions - 1, F.lit(0)).cast("int")
    return F.when(repetitions >= 1, F.aggregate(F.array_repeat(F.lit(0), n), F.lit(STEP), lambda g, _: g + STEP / (1 + g)))


def continued(repetitions: Column) -> Column:
    """The recurrence beyond ``FOLDED``: x = (1 + g)^2 grows by 2 STEP + STEP^2 / x a sighting, summed by its integral with the end correction."""
    base = F.lit(_SQUARE) + (repetitions - FOLDED) * (2 * STEP)
    x = base
    for _ in range(4):
        x = base + STEP / 2 * F.log((2 * x + STEP) / (2 * _SQUARE + STEP)) + STEP**2 / 2 * (1 / _SQUARE - 1 / x)
    return F.sqrt(x) - 1


def conductance(repetitions: Column) -> Column:
    """The strength after so many sightings, in time that does not grow with them."""
    return F.when(repetitions > FOLDED, continued(repetitions)).otherwise(folded(F.least(repetitions, F.lit(FOLDED))))


def with_conductance(edges: DataFrame, repetitions: str = "repetitions") -> DataFrame:
    """``edges`` with ``conductance``."""
    return edges.withColumn("conductance", conductance(F.col(repetitions)))
