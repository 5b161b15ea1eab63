"""Dense time series over a log, with three-valued presence: present (zero included), absent, not_modelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ordered_sum

PRESENT, ABSENT, NOT_MODELLED = "present", "absent", "not_modelled"
MAX_RANGE = 10_000_000


def facts(transfers: DataFrame, direction: str, substance: str | None = None, endpoint: str | None = None) -> DataFrame:
    """run_id, timestep, endpoint, substance, count of all transfers into or out of endpoints."""
    if direction not in ("incoming", "outgoing"):
        raise ValueError(f"direction is incoming or outgoing, not {direction}")
    own = F.col("target" if direction == "incoming" else "source")
    rows = transfers if endpoint is None else transfers.where(own == endpoint)
    rows = rows if substance is None else rows.where(F.col("substance") == substance)
    return rows.groupBy("run_id", "timestep", own.alias("endpoint"), "substance").agg(F.sum("count").alias("count"))


def spine(spark: SparkSession, first: int, last: int) -> DataFrame:
    if last < first:
        raise ValueError("a range ends before it begins")
    if last - first + 1 > MAX_RANGE:
        raise ValueError(f"a range has at most {MAX_RANGE} steps")
    return spark.range(first, last + 1).select(F.col("id").alias("timestep"))


def dense_counts(transfers: DataFrame, direction: str, first: int, last: int, keys: DataFrame | None = None) -> DataFrame:
    """Every timestep of the horizon for each (run_id, endpoint, substance) of keys, or that occurs: count, 0 when dry."""
    found = facts(transfers, direction)
    keys = found.select("run_id", "endpoint", "substance").distinct() if keys is None else keys
    steps = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
    full = keys.select("run_id", "endpoint", "substance", steps.alias("timestep"))
    return full.join(found, ["run_id", "endpoint", "substance", "timestep"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def dense_amounts(transfers: DataFrame, direction: str, first: int, last: int) -> DataFrame:
    """The same for amounts, summed in the log's order."""
    own = "target" if direction == "incoming" else "source"
    sums = transfers.groupBy("run_id", F.col(own).alias("endpoint"), "substance", "timestep").agg(F.array_sort(F.collect_list(F.struct("seq", "amount"))).alias("x"))
    sums = sums.select("run_id", "endpoint", "substance", "timestep", ordered_sum(F.transform("x", lambda v: v["amount"])).alias("amount"))
    steps = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
    full = sums.select("run_id", "endpoint", "substance").distinct().select("run_id", "endpoint", "substance", steps.alias("timestep"))
    return full.join(sums, ["run_id", "endpoint", "substance", "timestep"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def presence(modelled: Column, timestep: Column, first: Column, last: Column) -> Column:
    return F.when(~modelled, NOT_MODELLED).when(timestep.between(first, last), PRESENT).otherwise(ABSENT)


def ranged(transfers: DataFrame, direction: str, endpoint: str, substance: str, horizon: tuple[int, int], read: tuple[int, int], quantum: float | None, modelled: bool = True) -> DataFrame:
    """timestep, count, value, presence over [read], which may exceed the horizon; of one run's transfers."""
    steps = spine(transfers.sparkSession, *read)
    found = facts(transfers, direction, substance, endpoint).groupBy("timestep").agg(F.sum("count").alias("count"))
    state = presence(F.lit(modelled), F.col("timestep"), F.lit(horizon[0]), F.lit(horizon[1]))
    out = steps.join(found, "timestep", "left").withColumn("presence", state)
    count = F.when(F.col("presence") == PRESENT, F.coalesce("count", F.lit(0)))
    return out.select("timestep", count.alias("count"), (count.cast("double") * F.lit(quantum)).alias("value"), "presence")


def ranged_runs(transfers: DataFrame, runs: DataFrame, direction: str, endpoint: str, substance: str, horizon: tuple[int, int], read: tuple[int, int], quantum: float | None, modelled: bool = True) -> DataFrame:
    """The same for each run of runs (run_id): run_id, timestep, count, value, presence. A run without transfers is dry, not absent."""
    if read[1] < read[0]:
        raise ValueError("a range ends before it begins")
    if read[1] - read[0] + 1 > MAX_RANGE:
        raise ValueError(f"a range has at most {MAX_RANGE} steps")
    steps = F.explode(F.sequence(F.lit(read[0]).cast("long"), F.lit(read[1]).cast("long"))).alias("timestep")
    found = facts(transfers, direction, substance, endpoint).select("run_id", "timestep", "count")
    state = presence(F.lit(modelled), F.col("timestep"), F.lit(horizon[0]), F.lit(horizon[1]))
    out = runs.select("run_id", steps).join(found, ["run_id", "timestep"], "left").withColumn("presence", state)
    count = F.when(F.col("presence") == PRESENT, F.coalesce("count", F.lit(0)))
    return out.select("run_id", "timestep", count.alias("count"), (count.cast("double") * F.lit(quantum)).alias("value"), "presence")


def instant_of(timestep: Column, origin: int, step: int) -> Column:
    """Unix seconds of a timestep."""
    return F.lit(origin).cast("long") + timestep * F.lit(step).cast("long")


def index_of(instant: Column, origin: int, step: int) -> Column:
    """The timestep of an instant that lies on one; NULL before the origin or off the grid."""
    off = instant - F.lit(origin).cast("long")
    return F.when((off >= 0) & (off % F.lit(step) == 0), (off / F.lit(step)).cast("long"))
