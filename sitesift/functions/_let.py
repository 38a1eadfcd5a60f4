"""Bind a column value once and use it many times inside one expression.

Column helpers that refer to an intermediate value several times would
otherwise copy its whole expression tree at every reference, and nested
helpers multiply those copies.  ``let(v, fn)`` evaluates ``v`` once per row
as a lambda variable of a higher-order function and passes it to ``fn``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)
