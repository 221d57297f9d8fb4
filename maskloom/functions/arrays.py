"""Column helpers for arrays, in Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: a lambda's variable, where an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """For each element the combination of all up to it, by doubling: in step s each takes in the one 2^s before (null: none)."""
    steps = lambda xs: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)).cast("double"))).cast("int"))
    before = lambda a, i, s: F.get(a, i - F.call_function("shiftleft", F.lit(1), s))
    return let(values, lambda xs: F.aggregate(steps(xs), xs, lambda a, s: F.transform(a, lambda x, i: combine(x, before(a, i, s)))))


def running_sum(values: Column) -> Column:
    return running(values, lambda x, y: x + F.coalesce(y, F.lit(0)))
