"""Sums of doubles that do not depend on the order of addition: added as decimals, rounded once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places after the point that each number keeps before it is added; 20 digits before it.
PLACES = 8
KIND = f"decimal(28,{PLACES})"


def exact_sum(value: Column | str, digits: int) -> Column:
    """Sum of the known values, rounded half up to ``digits``; null when there is none.

    Values are added exactly, so equal multisets have equal sums wherever their rows lie. Values that are no finite number
    of at most 20 digits before the point are left out.
    """
    return F.round(F.sum((F.col(value) if isinstance(value, str) else value).try_cast(KIND)), digits).cast("double")


def exact_sum_sql(value: str, digits: int) -> str:
    return f"CAST(round(sum(CAST({value} AS {KIND})), {digits}) AS DOUBLE)"
