"""A column that is computed once where an expression names it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row: inside lambdas and branches it would be computed wherever it is named."""
    return F.get(F.transform(F.array(value), use), 0)
