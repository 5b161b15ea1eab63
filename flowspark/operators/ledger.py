"""Replaying a log of transfers: balances, conservation, status and seals, as windows and aggregates.

``transfers``: run_id, seq, timestep, source, target, substance, count (and source_kind, target_kind, amount). Counts are
integers, so every sum is exact and its order does not matter; amounts are counts times the substance's quantum.
Windows partition by run, endpoint and substance: no window runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantum import MAX_COUNT

CELL = ("run_id", "endpoint", "substance")


def signed_legs(transfers: DataFrame) -> DataFrame:
    """Each transfer as a debit of its source and a credit of its target."""
    debit = F.struct(F.col("source").alias("endpoint"), (-F.col("count")).alias("delta"))
    credit = F.struct(F.col("target").alias("endpoint"), F.col("count").alias("delta"))
    return transfers.select("run_id", "seq", "timestep", "substance", F.inline(F.array(debit, credit)))


def seed_cells(endpoints: DataFrame, substances: DataFrame, stocks: DataFrame) -> DataFrame:
    """endpoint x substance with the initial count, 0 where none is given. Both sides are a model's lists."""
    cells = endpoints.select("endpoint", "kind").crossJoin(substances.select("substance"))
    return cells.join(stocks.select("endpoint", "substance", F.col("count").alias("__c")), ["endpoint", "substance"], "left").select("endpoint", "kind", "substance", F.coalesce("__c", F.lit(0)).cast("long").alias("count"))


def replay_records(transfers: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The balance of each touched cell after each record."""
    order = Window.partitionBy(*CELL).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = signed_legs(transfers).withColumn("balance", F.sum("delta").over(order))
    if seeds is None:
        return rows
    start = seeds.select("endpoint", "substance", F.col("count").alias("__start"))
    return rows.join(start, ["endpoint", "substance"], "left").withColumn("balance", F.col("balance") + F.coalesce("__start", F.lit(0))).drop("__start")


def replay_timesteps(transfers: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The balance of each cell after each timestep at which it changes."""
    sums = signed_legs(transfers).groupBy(*CELL, "timestep").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy(*CELL).orderBy("timestep").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumn("balance", F.sum("delta").over(order))
    if seeds is None:
        return rows
    start = seeds.select("endpoint", "substance", F.col("count").alias("__start"))
    return rows.join(start, ["endpoint", "substance"], "left").withColumn("balance", F.col("balance") + F.coalesce("__start", F.lit(0))).drop("__start")


def snapshots(transfers: DataFrame, spine: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Balances at every timestep of the spine (run_id, timestep), for each cell that the run touches, and with seeds each of theirs."""
    sums = signed_legs(transfers).groupBy(*CELL, "timestep").agg(F.sum("delta").alias("delta"))
    cells = sums.select(*CELL).distinct() if seeds is None else _cells(sums, seeds, spine.select("run_id").distinct())
    order = Window.partitionBy(*CELL).orderBy("timestep").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.join(spine, "run_id").join(sums, [*CELL, "timestep"], "left").withColumn("balance", F.sum(F.coalesce("delta", F.lit(0))).over(order)).drop("delta")
    return rows if seeds is None else _started(rows, seeds)


def _cells(touched: DataFrame, seeds: DataFrame, runs: DataFrame) -> DataFrame:
    """The cells that runs touch or that a seed names; seeds are a model's lists."""
    return touched.select(*CELL).unionAll(runs.crossJoin(F.broadcast(seeds.select("endpoint", "substance"))).select(*CELL)).distinct()


def _started(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    start = seeds.select("endpoint", "substance", F.col("count").alias("__start"))
    return rows.join(start, ["endpoint", "substance"], "left").withColumn("balance", F.col("balance") + F.coalesce("__start", F.lit(0))).drop("__start")


def final_stock(transfers: DataFrame, seeds: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """The balance of each cell when all is done; with seeds also of those that never move, of runs (or those with transfers)."""
    sums = signed_legs(transfers).groupBy(*CELL).agg(F.sum("delta").alias("balance"))
    if seeds is None:
        return sums
    runs = transfers.select("run_id").distinct() if runs is None else runs.select("run_id").distinct()
    return _started(_cells(sums, seeds, runs).join(sums, list(CELL), "left").withColumn("balance", F.coalesce("balance", F.lit(0))), seeds)


def overdrafts(transfers: DataFrame, seeds: DataFrame | None = None, finite: str = "source_kind = 'finite'") -> DataFrame:
    """Records after which a finite source's balance is negative; the first of a run is where it would stop."""
    debit = F.struct(F.col("source").alias("endpoint"), (-F.col("count")).alias("delta"), F.expr(finite).alias("__finite"))
    credit = F.struct(F.col("target").alias("endpoint"), F.col("count").alias("delta"), F.lit(False).alias("__finite"))
    legs = transfers.select("run_id", "seq", "timestep", "substance", F.inline(F.array(debit, credit)))
    order = Window.partitionBy(*CELL).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = legs.withColumn("balance", F.sum("delta").over(order))
    return (rows if seeds is None else _started(rows, seeds)).where("__finite AND balance < 0 AND delta < 0").drop("__finite")


def conservation_totals(transfers: DataFrame) -> DataFrame:
    """Sum of all legs for each run and substance: 0, unless something is lost."""
    return signed_legs(transfers).groupBy("run_id", "substance").agg(F.sum("delta").alias("net"), F.sum(F.abs("delta")).alias("moved"))


def run_status(transfers: DataFrame, seals: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """complete with a seal that fits the log, seal_mismatch, or resumable with the last timestep reached. runs: those that
    began, with or without transfers; else those with a transfer or a seal."""
    found = transfers.groupBy("run_id").agg(F.count("*").alias("transfers"), F.max("timestep").alias("last_timestep"))
    sealed = seals.select("run_id", "final_timestep", "transfer_count")
    out = found.join(sealed, "run_id", "full")
    if runs is not None:
        out = out.join(runs.select("run_id").distinct(), "run_id", "full")
    out = out.withColumn("transfers", F.coalesce("transfers", F.lit(0)))
    fits = (F.col("transfer_count") == F.col("transfers")) & (F.coalesce("last_timestep", F.col("final_timestep")) <= F.col("final_timestep"))
    return out.withColumn("status", F.when(F.col("transfer_count").isNull(), "resumable").when(fits, "complete").otherwise("seal_mismatch"))


def seal(transfers: DataFrame, last: int | None = None) -> DataFrame:
    """The completion seal of each run."""
    final = F.max("timestep") if last is None else F.lit(last).cast("long")
    return transfers.groupBy("run_id").agg(final.alias("final_timestep"), F.count("*").alias("transfer_count"), F.sum("count").alias("moved"))


def order_violations(transfers: DataFrame, by: str = "seq") -> DataFrame:
    """Records whose timestep is before that of the record before them."""
    order = Window.partitionBy("run_id").orderBy(by)
    return transfers.withColumn("previous", F.lag("timestep").over(order)).where("timestep < previous")


def undeclared(transfers: DataFrame, edges: DataFrame) -> DataFrame:
    return transfers.join(edges.select("source", "target"), ["source", "target"], "left_anti")


def declared(transfers: DataFrame, edges: DataFrame) -> DataFrame:
    return transfers.join(edges.select("source", "target"), ["source", "target"], "left_semi")


def inexact(transfers: DataFrame, substances: DataFrame) -> DataFrame:
    """Records whose amount is not exactly count * quantum."""
    return transfers.join(substances.select("substance", "quantum"), "substance").where(F.col("amount") != F.col("count").cast("double") * F.col("quantum"))


def over_ceiling(transfers: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Records after which a cell's balance is over the ceiling. Upper and lower halves of counts are summed apart, so no sum
    leaves 64 bits; a balance that does is over the ceiling, and null."""
    half, low = 32, (1 << 32) - 1
    order = Window.partitionBy(*CELL).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = signed_legs(transfers).withColumn("__hi", F.sum(F.shiftright("delta", half)).over(order)).withColumn("__lo", F.sum(F.col("delta").bitwiseAND(F.lit(low))).over(order))
    if seeds is not None:
        start = seeds.select("endpoint", "substance", F.coalesce("count", F.lit(0)).alias("__start"))
        rows = rows.join(start, ["endpoint", "substance"], "left").withColumn("__start", F.coalesce("__start", F.lit(0)))
        rows = rows.withColumn("__hi", F.col("__hi") + F.shiftright("__start", half)).withColumn("__lo", F.col("__lo") + F.col("__start").bitwiseAND(F.lit(low))).drop("__start")
    rows = rows.withColumn("__hi", F.col("__hi") + F.shiftright("__lo", half)).withColumn("__lo", F.col("__lo").bitwiseAND(F.lit(low)))
    fits = F.col("__hi").between(-(1 << 31), (1 << 31) - 1)
    rows = rows.withColumn("balance", F.when(fits, F.shiftleft("__hi", half).bitwiseOR(F.col("__lo"))))
    return rows.where(~fits | (F.col("balance") > MAX_COUNT) | (F.col("balance") < -MAX_COUNT)).drop("__hi", "__lo")


def divergence(prefix: DataFrame, generated: DataFrame) -> DataFrame:
    """For each run the first seq at which a stored prefix differs from what the model generates; none if it is a prefix."""
    fields = ("timestep", "source", "target", "substance", "count")
    a = prefix.select("run_id", "seq", F.struct(*fields).alias("a"))
    b = generated.select("run_id", "seq", F.struct(*fields).alias("b"))
    differs = a.join(b, ["run_id", "seq"], "left").where(F.col("b").isNull() | (F.col("a") != F.col("b")))
    return differs.groupBy("run_id").agg(F.min("seq").alias("seq"))
