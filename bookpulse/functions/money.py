"""Mark and P&L arithmetic in exact decimals."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_CENT = Decimal("0.01")


def mark_change_bps(mark: Column, baseline: Column) -> Column:
    return (mark - baseline) * F.lit(100)


def pnl(mark: Column, baseline: Column, par: Column) -> Column:
    """Marks are prices per 100 of par."""
    return (mark - baseline) * par * F.lit(_CENT)


def rounded(amount: Column, digits: int = 0) -> Column:
    """Round half up in decimals, hand out as double."""
    return F.round(amount, digits).cast("double")


def share(part: Column, total: Column, digits: int = 1) -> Column:
    """Percentage of a total; NULL when the total is zero."""
    whole = F.nullif(total.cast("double"), F.lit(0.0))
    return F.round(part.cast("double") / whole * 100, digits)
