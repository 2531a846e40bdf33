"""Keeping costly expressions in one place of a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """``value``, marked so that the optimizer does not copy it into filters and lambdas above."""
    return F.when(F.monotonically_increasing_id() < 0, None).otherwise(value)
