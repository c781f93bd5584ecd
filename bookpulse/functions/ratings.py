"""Rating ladder arithmetic. A grade off the ladder (NR) has no ordinal."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookpulse.schemas import RATING_LADDER


def _ladder() -> Column:
    return F.split(F.lit(",".join(RATING_LADDER)), ",")


def ordinal(rating: Column) -> Column:
    """1 for the best grade; NULL off the ladder."""
    return F.nullif(F.array_position(_ladder(), rating), F.lit(0).cast("bigint"))


def grade(position: Column) -> Column:
    """The grade at an ordinal, clamped to the ends of the ladder."""
    clamped = F.least(F.greatest(position, F.lit(1)), F.lit(len(RATING_LADDER)))
    return F.when(position.isNotNull(), F.element_at(_ladder(), clamped.cast("int")))


def notch(rating: Column, steps: int) -> Column:
    """Move down (positive) or up the ladder."""
    return grade(ordinal(rating) + F.lit(steps))


def is_downgrade(old: Column, new: Column) -> Column:
    return F.coalesce(ordinal(new) > ordinal(old), F.lit(False))
