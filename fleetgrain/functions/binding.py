"""Binding of an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    Inside higher-order functions there is no projection to name a value in,
    and repeating it would multiply the work at every use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
