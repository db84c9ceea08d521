"""Name an intermediate value inside one expression, so that it is written and computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
