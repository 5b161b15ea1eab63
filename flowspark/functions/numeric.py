"""Finite binary64 arithmetic, as columns and as Python scalars with the same results.

Every operand and result must be finite; a negative zero becomes zero. Columns raise on a violation; NULL stays NULL. Those
built under ``quiet()`` do not raise but give NaN (a comparison gives NULL), which every further operation hands on, so that a
job over many runs can tell which of them fail. Sums of doubles depend on their order, so they are folds over sorted arrays, never ``sum``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F


class NumericError(ValueError):
    """A non-finite operand or result, or bounds that exclude each other."""


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


_QUIET: ContextVar[bool] = ContextVar("quiet", default=False)


@contextmanager
def quiet() -> Iterator[None]:
    """Columns that are built inside give NaN where others raise."""
    before = _QUIET.set(True)
    try:
        yield
    finally:
        _QUIET.reset(before)


def _fail(message: str) -> Column:
    return F.lit(math.nan) if _QUIET.get() else F.raise_error(F.lit(message)).cast("double")


def finite(x, what: str = "result") -> Column:
    """x, checked; -0 as 0. NaN is above every number in Spark, so one comparison finds both NaN and infinities."""
    x = _column(x)
    if _QUIET.get():
        return F.when(F.abs(x) <= _MOST, x + F.lit(0.0)).otherwise(F.lit(math.nan))
    return F.when(F.abs(x) > _MOST, _fail(f"NON_FINITE: {what}")).otherwise(x + F.lit(0.0))


_MOST = sys.float_info.max


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


# Sums, differences and products of non-finite numbers are non-finite, so a check of the whole is enough for them. Where
# an operation could hide one (a quotient, a power, a comparison, a choice), its operands are checked. This keeps each
# operand's expression from being repeated at every node.


def _checked(x) -> Column:
    return finite(x, "operand") if isinstance(x, Column) else F.lit(float(x))


def add(a, b) -> Column:
    return _column(a) + _column(b)


def subtract(a, b) -> Column:
    return _column(a) - _column(b)


def multiply(a, b) -> Column:
    return _column(a) * _column(b)


def divide(a, b) -> Column:
    """Division by zero is an error."""
    if not isinstance(b, Column) and b:
        return _column(a) / F.lit(float(b))
    b = _checked(b)
    return _column(a) / F.when(b == 0, _fail("NON_FINITE: divide")).otherwise(b)


def power(a, b) -> Column:
    a, b = _checked(a), _checked(b)
    if _QUIET.get():  # NaN ** 0 is 1
        return F.when(~F.isnan(a) & ~F.isnan(b), F.pow(a, b)).otherwise(F.lit(math.nan))
    return F.pow(a, b)


def _least(a: Column, b: Column) -> Column:
    """The lesser; NaN, which is the greatest number, if either is NaN and columns are quiet."""
    return -F.greatest(-a, -b) if _QUIET.get() else F.least(a, b)


def minimum(a, b) -> Column:
    return _least(_checked(a), _checked(b))


def maximum(a, b) -> Column:
    return F.greatest(_checked(a), _checked(b))


def clamp(v, lo, hi) -> Column:
    lo, hi = _checked(lo), _checked(hi)
    return F.when(lo > hi, _fail("CLAMP_BOUNDS")).otherwise(_least(F.greatest(_checked(v), lo), hi))


_COMPARE = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less_than": lambda a, b: a < b,
    "less_than_or_equal": lambda a, b: a <= b,
    "greater_than": lambda a, b: a > b,
    "greater_than_or_equal": lambda a, b: a >= b,
}
COMPARISONS = tuple(_COMPARE)


def compare(op: str, a, b) -> Column:
    a, b = _checked(a), _checked(b)
    out = _COMPARE[op](a, b)
    return F.when(~F.isnan(a) & ~F.isnan(b), out) if _QUIET.get() else out


def select(condition: Column, a, b) -> Column:
    """Only the chosen side is evaluated."""
    if _QUIET.get():
        return F.when(condition.isNull(), F.lit(math.nan)).when(condition, _column(a)).otherwise(_column(b))
    return F.when(condition, _column(a)).otherwise(_column(b))


def truth(x) -> Column:
    return finite(x) != 0


def select_number(condition, a, b) -> Column:
    """The strict form: a number as condition, and all three checked."""
    return F.when(truth(condition), finite(a)).otherwise(finite(b))


def ordered_sum(values: Column) -> Column:
    """Left fold of an array of doubles from 0."""
    return finite(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), "sum")


def linear(x, x0, y0, x1, y1) -> Column:
    """y0 + ((x - x0) / (x1 - x0)) * (y1 - y0), in this order; the knots are numbers."""
    return add(y0, multiply(divide(subtract(x, x0), x1 - x0), y1 - y0))


POLICIES = ("reject", "clamp_to_endpoint", "linear_extrapolate")


def interpolate(x: Column, knots: list[tuple[float, float]], policy: str) -> Column:
    """Piecewise linear through the knots (x ascending): a ladder of conditions, so for small tables."""
    first, last = knots[0], knots[-1]
    x = _checked(x)
    if policy == "reject":
        below = above = _fail("TABLE_BOUNDARY")
    elif policy == "clamp_to_endpoint":
        below, above = F.lit(first[1]), F.lit(last[1])
    else:
        below, above = linear(x, *first, *knots[1]), linear(x, *knots[-2], *last)
    out = F.when(F.isnan(x), x).when(x < first[0], below) if _QUIET.get() else F.when(x < first[0], below)
    out = out.when(x > last[0], above)
    for kx, ky in knots:
        out = out.when(x == kx, F.lit(ky))
    for a, b in zip(knots, knots[1:]):
        out = out.when((x > a[0]) & (x < b[0]), linear(x, *a, *b))
    return out


def interpolate_join(values, knots, x: str, table: str = "table_id", ranges: int = 64, salts: int = 16):
    """values with y, for tables of any size: each row meets the two knots around it, without a range join.

    values and knots share the column table; knots has x, y, policy. A table is cut at up to `ranges` of its knots, rows are
    dealt over its ranges and by `salts`, so neither a single table nor a single range is one task, and the rows and knots of
    each part are ordered together by one window: a row sees the last knot at or before it and the first after it. y is
    NULL where policy rejects, and for tables that have no knots. Cuts and ends are a row a table.
    """
    from pyspark.sql import Window

    sizes = knots.groupBy(table).agg(F.count("*").alias("__n"))
    placed = knots.select(F.col(table), "x", "y", F.row_number().over(Window.partitionBy(table).orderBy("x")).alias("__k")).join(sizes, table)
    edge = F.pmod(F.col("__k") - 1, F.greatest(F.lit(1), F.ceil(F.col("__n") / ranges))) == 0
    pair = lambda where: F.max(F.when(where, F.struct("x", "y")))
    ends = placed.groupBy(table).agg(
        pair(F.col("__k") == 1).alias("__a"), pair(F.col("__k") == 2).alias("__b"), pair(F.col("__k") == F.col("__n") - 1).alias("__c"), pair(F.col("__k") == F.col("__n")).alias("__d"),
        F.array_sort(F.collect_list(F.when(edge, F.col("x")))).alias("__cuts"),
    )
    ends = ends.join(knots.groupBy(table).agg(F.first("policy").alias("__policy")), table)
    part = lambda v: F.size(F.filter("__cuts", lambda c: c <= v))
    own = values.withColumn("__x", F.col(x)).withColumn("__row", F.monotonically_increasing_id()).join(ends, table, "left")
    own = own.withColumn("__part", F.greatest(part(F.col("__x")), F.lit(1))).withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    # a knot at which a range begins also ends the range before
    at = part(F.col("x"))
    marks = placed.join(ends.select(table, "__cuts"), table)
    both = F.when(edge & (F.col("__k") > 1), F.array(at, at - 1)).otherwise(F.array(at))
    marks = marks.select(table, F.col("x").alias("__x"), F.struct("x", "y").alias("__knot"), F.explode(both).alias("__part"))
    marks = marks.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rows = own.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(table, "__part", "__salt").orderBy("__x", F.col("__knot").isNull())
    rows = rows.withColumn("__lo", F.last("__knot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__hi", F.first("__knot", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    v = F.col("__x")
    segment = lambda a, b: F.when(v == F.col(f"{a}.x"), F.col(f"{a}.y")).otherwise(F.col(f"{a}.y") + ((v - F.col(f"{a}.x")) / (F.col(f"{b}.x") - F.col(f"{a}.x"))) * (F.col(f"{b}.y") - F.col(f"{a}.y")))
    outside = lambda end, a, b: F.when(F.col("__policy") == "clamp_to_endpoint", F.col(f"{end}.y")).when(F.col("__policy") == "linear_extrapolate", segment(a, b))
    y = F.when(v < F.col("__a.x"), outside("__a", "__a", "__b")).when(v > F.col("__d.x"), outside("__d", "__c", "__d")).when(v == F.col("__d.x"), F.col("__d.y")).otherwise(segment("__lo", "__hi"))
    return rows.where("__row IS NOT NULL").withColumn("y", y).select(*values.columns, "y")


# Scalar twins, for rules that need a run's state step by step.


def check(x: float, what: str = "result") -> float:
    if not math.isfinite(x):
        raise NumericError(f"non-finite {what}")
    return x + 0.0


def scalar_divide(a: float, b: float) -> float:
    if b == 0:
        raise NumericError("non-finite divide")
    return check(check(a) / check(b))


def scalar_power(a: float, b: float) -> float:
    try:
        return check(math.pow(check(a), check(b)))
    except (ValueError, OverflowError) as e:
        raise NumericError("non-finite power") from e


def scalar_clamp(v: float, lo: float, hi: float) -> float:
    if lo > hi:
        raise NumericError("clamp bounds")
    v = v if v >= lo else lo
    return v if v <= hi else hi


def scalar_compare(op: str, a: float, b: float) -> bool:
    return bool(_COMPARE[op](check(a), check(b)))


def scalar_sum(values) -> float:
    total = 0.0
    for v in values:
        total = check(total + check(v))
    return total


def scalar_linear(x: float, x0: float, y0: float, x1: float, y1: float) -> float:
    return check(y0 + check(check(scalar_divide(x - x0, x1 - x0)) * check(y1 - y0)))


def scalar_interpolate(x: float, knots: list[tuple[float, float]], policy: str) -> float:
    first, last = knots[0], knots[-1]
    if x < first[0] or x > last[0]:
        if policy == "reject":
            raise NumericError("table boundary")
        if policy == "clamp_to_endpoint":
            return first[1] if x < first[0] else last[1]
        return scalar_linear(x, *(first if x < first[0] else knots[-2]), *(knots[1] if x < first[0] else last))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        if x == x0:
            return y0
        if x0 < x < x1:
            return scalar_linear(x, x0, y0, x1, y1)
    return last[1]
