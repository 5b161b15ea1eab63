"""Whole quanta: amounts as integer counts of a quantum, as columns and as scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest count: every integer up to it is a double.
MAX_COUNT = 1 << 53


def to_amount(count: Column, quantum: Column) -> Column:
    return count.cast("double") * quantum


def whole_count(amount: Column, quantum: Column) -> Column:
    """The count whose amount is exactly this double, if just one count is; else NULL."""
    r = F.floor(amount / quantum + F.lit(0.5))
    image = lambda n: n.cast("double") * quantum
    alone = (image(r) == amount) & (image(r + 1) != amount) & ((r == 0) | (image(r - 1) != amount))
    return F.when(_countable(amount, quantum) & alone, r.cast("long"))


def floor_count(amount: Column, quantum: Column) -> Column:
    """The exact count if there is one, else the most quanta not above the amount; NULL outside 0 .. 2**53 quanta."""
    f = F.floor(amount / quantum)
    down = F.when(f.cast("double") * quantum > amount, f - 1).otherwise(f).cast("long")
    return F.when(_countable(amount, quantum), F.coalesce(whole_count(amount, quantum), down))


def _countable(amount: Column, quantum: Column) -> Column:
    return amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount <= quantum * F.lit(float(MAX_COUNT)))


def scalar_whole_count(amount: float, quantum: float) -> int | None:
    if not math.isfinite(amount) or amount < 0 or amount > quantum * MAX_COUNT:
        return None
    r = math.floor(amount / quantum + 0.5)
    alone = r * quantum == amount and (r + 1) * quantum != amount and (r == 0 or (r - 1) * quantum != amount)
    return r if alone else None


def scalar_floor_count(amount: float, quantum: float) -> int | None:
    if not math.isfinite(amount) or amount < 0 or amount > quantum * MAX_COUNT:
        return None
    exact = scalar_whole_count(amount, quantum)
    if exact is not None:
        return exact
    f = math.floor(amount / quantum)
    return f - 1 if f * quantum > amount else f
