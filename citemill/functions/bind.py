"""Names for intermediate values within one expression.

A Column that is used twice is evaluated, and written into the plan, twice; a long formula over its own parts grows out of all bounds.
``let`` binds a value to the parameter of a lambda, so that all uses refer to one evaluation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
