"""Expression helpers for array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas.

    A column that a lambda refers to may be inlined and computed again for each
    element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
