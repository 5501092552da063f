"""Values that are computed once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it
    several times or inside the functions given to transform, filter and the like."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)
