"""Fan-out of evaluated amounts: one row for each branch, in whole quanta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantum import floor_count


def split(rows: DataFrame, branches: list[tuple[str, Column]], quantum: Column, keep: list[str]) -> DataFrame:
    """keep, branch, amount and count for each branch with a count over 0; an array of structs is exploded, so one pass does all."""
    return _counted(rows, branches, quantum, keep).where("count > 0")


def _counted(rows: DataFrame, branches: list[tuple[str, Column]], quantum: Column, keep: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(b).alias("branch"), amount.cast("double").alias("amount")) for b, amount in sorted(branches, key=lambda x: x[0])]
    out = rows.withColumn("__q", quantum).select(*keep, "__q", F.inline(F.array(*parts)))
    return out.withColumn("count", floor_count(F.col("amount"), F.col("__q"))).drop("__q")


def violations(rows: DataFrame, branches: list[tuple[str, Column]], quantum: Column, keep: list[str]) -> DataFrame:
    """keep, branch, amount and violation of the branches that split() cannot move: amounts that are missing, negative, not finite or
    above the largest count. Their rows have no transfer, so a caller that must not lose them reads these too."""
    return _counted(rows, branches, quantum, keep).where("count IS NULL").select(*keep, "branch", "amount", F.lit("InvalidAmount").alias("violation"))


def retain_all(rows: DataFrame, amount: Column, quantum: Column, keep: list[str]) -> DataFrame:
    """Nothing moves; amounts that are no amounts still show, as violations."""
    return rows.where(floor_count(amount.cast("double"), quantum).isNull()).select(*keep, F.lit("InvalidAmount").alias("violation"))


def release_all(rows: DataFrame, branch: str, amount: Column, quantum: Column, keep: list[str]) -> DataFrame:
    return split(rows, [(branch, amount)], quantum, keep)


def fixed_fraction(rows: DataFrame, fractions: dict[str, float], retained: float, amount: Column, quantum: Column, keep: list[str]) -> DataFrame:
    total = retained
    for _, f in sorted(fractions.items()):
        total += f
    if total != 1.0:
        raise ValueError("InvalidFixedFractionTotal")
    return split(rows, [(b, amount * F.lit(f)) for b, f in fractions.items()], quantum, keep)


def constant_fraction(rows: DataFrame, branch: str, fraction: float, amount: Column, quantum: Column, keep: list[str]) -> DataFrame:
    if not 0 <= fraction <= 1:
        raise ValueError("OutOfRange")
    return split(rows, [(branch, amount * F.lit(fraction))], quantum, keep)


def exogenous(rows: DataFrame, branch: str, series: Column, quantum: Column, keep: list[str]) -> DataFrame:
    return split(rows, [(branch, series)], quantum, keep)


def by_expression(rows: DataFrame, branches: dict[str, Column], quantum: Column, keep: list[str]) -> DataFrame:
    return split(rows, list(branches.items()), quantum, keep)


def retained(rows: DataFrame, moved: DataFrame, available: str, keys: list[str]) -> DataFrame:
    """What stays: available less all that moved, exact; negative where a rule overdraws."""
    out = moved.groupBy(*keys).agg(F.sum("count").alias("__moved"))
    return rows.join(out, keys, "left").select(*keys, available, (F.col(available) - F.coalesce("__moved", F.lit(0))).alias("retained"))
