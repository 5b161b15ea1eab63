"""Stateful series over ordered facts, as windows and folds over arrays of one series; no series meets another.

A dense series has a row for each timestep of each key. ``initial`` values stand before the first step, oldest first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ordered_sum

BLOCK = 256


def _order(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("timestep")


def _at(values: list, index: Column) -> Column:
    """values[index], from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def bounded_lag(dense: DataFrame, keys: list[str], value: str, steps: int, initial: list, out: str) -> DataFrame:
    """The value `steps` before, and at first the initial ones."""
    if len(initial) != steps:
        raise ValueError("a lag has as many initial values as steps")
    w = _order(keys)
    n = F.row_number().over(w) - 1
    return dense.withColumn("__n", n).withColumn(out, F.when(F.col("__n") < steps, _at(initial, F.least("__n", F.lit(steps - 1)))).otherwise(F.lag(value, steps).over(w))).drop("__n")


def rolling_count(dense: DataFrame, keys: list[str], value: str, window: int, out: str) -> DataFrame:
    """Exact sum of the last `window` counts, this one included."""
    return dense.withColumn(out, F.sum(value).over(_order(keys).rowsBetween(-(window - 1), 0)))


def rolling_sum(dense: DataFrame, keys: list[str], value: str, window: int, initial: list[float], out: str) -> DataFrame:
    """Sum of the last `window` doubles, oldest first; what is missing at first comes from the initial values' end."""
    if len(initial) != window - 1:
        raise ValueError("a rolling sum has window - 1 initial values")
    w = _order(keys)
    got = F.collect_list(value).over(w.rowsBetween(-(window - 1), 0))
    if not initial:
        return dense.withColumn(out, ordered_sum(got))
    rows = dense.withColumn("__got", got)
    have = F.size("__got")
    before = F.slice(F.array(*[F.lit(float(v)) for v in initial]), have, F.greatest(F.lit(window) - have, F.lit(0)))
    return rows.withColumn(out, ordered_sum(F.concat(before, "__got"))).drop("__got")


def recurrence(dense: DataFrame, keys: list[str], facts: list[str] | None, initial: list[float], update: Callable[[list[Column], Column], list[Column]], output: int | Callable[[list[Column]], Column], out: str) -> DataFrame:
    """A finite recurrence: at each step all slots are updated together from the slots before and the step's facts.

    One fold over a key's ordered array gives the outputs of all its steps; the array is that key's series alone. Outputs
    are gathered in blocks of BLOCK steps, so that a series of T steps copies T * BLOCK + (T / BLOCK)**2 of them, not T**2.
    The result has keys, timestep and out; with facts None it has every column of dense, and update may read any of them.
    """
    names = [f"s{k}" for k in range(len(initial))]
    read = [c for c in dense.columns if c not in keys and c != "timestep"] if facts is None else facts
    rows = dense.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("timestep", *[F.col(f"`{c}`") for c in read]))).alias("__steps"))
    told = output if callable(output) else lambda slots: slots[output]
    slots = [F.lit(float(v)).alias(n) for v, n in zip(initial, names)]

    def step(state: Column, x: Column) -> Column:
        new = update([state[n] for n in names], x)
        return F.struct(*[v.cast("double").alias(n) for v, n in zip(new, names)], F.concat(state["out"], F.array(told(new).cast("double"))).alias("out"))

    def block(state: Column, steps: Column) -> Column:
        start = F.struct(*[state[n].alias(n) for n in names], F.array().cast("array<double>").alias("out"))
        ended = F.transform(F.array(F.aggregate(steps, start, step)), lambda r: F.struct(*[r[n].alias(n) for n in names], F.concat(state["out"], F.array(r["out"])).alias("out")))
        return ended[0]  # an array of one binds the block's end, which is then used for each of its fields

    blocks = F.transform(F.sequence(F.lit(0), F.ceil((F.size("__steps") - 1) / BLOCK).cast("int")), lambda k: F.slice("__steps", k * BLOCK + 1, BLOCK))
    outs = F.flatten(F.aggregate(blocks, F.struct(*slots, F.array().cast("array<array<double>>").alias("out")), block, lambda s: s["out"]))
    folded = rows.select(*keys, "__steps", outs.alias("__outs")).select(*keys, F.inline(F.arrays_zip("__steps", "__outs")))
    kept = ["timestep", *read] if facts is None else ["timestep"]
    return folded.select(*keys, *[F.col("__steps").getField(c).alias(c) for c in kept], F.col("__outs").alias(out))
