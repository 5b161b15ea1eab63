"""Logs of runs as evidence: a genesis, transfers and at most one seal a run, read back, verified, replayed and resumed.

``genesis`` has a row for each cell of a run: run_id, model_digest, numerical_semantics, endpoint, substance, count, amount.
``seals``: run_id, final_timestep, transfer_count, log_digest. A digest covers the genesis and every field of every transfer,
amounts by their bits. All checks are aggregates, windows by run, and joins with a model's lists, which a document bounds; each
gives rows of run_id, seq (NULL where the run as a whole is meant) and violation.

A run is complete if it has a seal that fits, resumable (a prefix, read up to its last transfer) if it has none, and invalid
otherwise; runs without transfers are runs all the same.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantum import MAX_COUNT
from ..plans.model import Model
from ..sources import log
from ..sources.documents import tables_of
from . import execute, ledger, series, validate

SEMANTICS = "v1"
GENESIS = "run_id string, model_digest string, numerical_semantics string, endpoint string, substance string, count long, amount double"
COMPLETE, RESUMABLE, INVALID = "complete", "resumable", "invalid"


def model_digests(model: Model, params: DataFrame) -> DataFrame:
    """run_id, model_digest: of the model with each run's own parameters."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = {(r.compartment, r.substance, r.parameter): float(r.value) for r in rows[rows["given"]].itertuples()}
        return pd.DataFrame([(key[0], (model.substitute(own) if own else model).digest)], columns=["run_id", "model_digest"])

    return params.withColumn("given", F.col("parameter").isNotNull() & F.col("value").isNotNull()).groupBy("run_id").applyInPandas(one, "run_id string, model_digest string")


def genesis(spark: SparkSession, model: Model, digests: DataFrame) -> DataFrame:
    """The first record of each run of digests (run_id, model_digest): a row for each finite cell, with its initial stock."""
    t = tables_of(spark, model)
    cells = ledger.seed_cells(t["endpoints"].where("kind = 'finite'"), t["substances"], t["initial_stocks"]).join(t["substances"].select("substance", "quantum"), "substance")
    cells = cells.select("endpoint", "substance", "count", (F.col("count").cast("double") * F.col("quantum")).alias("amount"))
    return digests.select("run_id", "model_digest", F.lit(SEMANTICS).alias("numerical_semantics")).crossJoin(F.broadcast(cells)).select(*[f.split()[0] for f in GENESIS.split(", ")])


def seals(genesis_rows: DataFrame, transfers: DataFrame, last: int) -> DataFrame:
    """The seal of each run that a genesis begins; one that moves nothing has a seal too."""
    digests = log.digests(genesis_rows, transfers)
    return digests.select("run_id", F.lit(last).cast("long").alias("final_timestep"), "transfer_count", "log_digest")


def _found(rows: DataFrame, violation: str | Column, seq: Column | None = None) -> DataFrame:
    violation = F.lit(violation) if isinstance(violation, str) else violation
    return rows.select("run_id", (F.lit(None) if seq is None else seq).cast("long").alias("seq"), violation.alias("violation"))


def log_violations(genesis_rows: DataFrame, transfers: DataFrame, seal_rows: DataFrame, runs: DataFrame | None = None, digests: DataFrame | None = None) -> DataFrame:
    """What breaks the order of records or the evidence of a seal. digests: run_id, log_digest and transfer_count of the log as
    it is, if not by log.digests. (A count of transfers is a long, so that it cannot overflow.)"""
    begun = genesis_rows.select("run_id").distinct()
    used = transfers.select("run_id").unionAll(seal_rows.select("run_id")).distinct()
    out = [_found(used.join(begun, "run_id", "left_anti"), "GenesisNotFirst")]
    if runs is not None:
        out.append(_found(runs.select("run_id").distinct().join(begun, "run_id", "left_anti").join(used, "run_id", "left_anti"), "MissingGenesis"))
    twice = genesis_rows.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("endpoint", "substance").alias("cells"), F.count_distinct("model_digest", "numerical_semantics").alias("heads"))
    out.append(_found(twice.where("n > cells OR heads > 1"), "RepeatedGenesis"))
    out.append(_found(ledger.order_violations(transfers), "TimestepOrder", F.col("seq")))
    out.append(_found(seal_rows.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1"), "AlreadySealed"))
    first = seal_rows.groupBy("run_id").agg(F.min("transfer_count").alias("declared"), F.min_by("log_digest", "transfer_count").alias("digest"), F.min_by("final_timestep", "transfer_count").alias("final"))
    base = transfers.groupBy("run_id").agg(F.min("seq").alias("first"), F.max("timestep").alias("reached"))
    after = transfers.join(first.join(base, "run_id"), "run_id").where(F.col("seq") - F.col("first") >= F.col("declared"))
    out.append(_found(after, "RecordAfterSeal", F.col("seq")))
    actual = log.digests(genesis_rows, transfers) if digests is None else digests
    sealed = first.join(actual, "run_id", "left").join(base, "run_id", "left").withColumn("actual", F.coalesce("transfer_count", F.lit(0)))
    code = F.when(F.col("actual") < F.col("declared"), "SealTransferCount").when((F.col("actual") == F.col("declared")) & ~F.col("digest").eqNullSafe(F.col("log_digest")), "SealDigest")
    code = code.when(F.col("reached") > F.col("final"), "SealFinalTimestep")
    out.append(_found(sealed.withColumn("code", code).where("code IS NOT NULL"), F.col("code")))
    return reduce(DataFrame.unionByName, out)


def genesis_violations(genesis_rows: DataFrame, cells: DataFrame, model_digests: DataFrame | None = None) -> DataFrame:
    """Where a run's genesis is not that of its model. cells: endpoint, substance, count; model_digests: run_id, model_digest."""
    out = [_found(genesis_rows.where(F.col("numerical_semantics") != SEMANTICS).select("run_id").distinct(), "NumericalSemanticsMismatch")]
    if model_digests is not None:
        held = genesis_rows.select("run_id", "model_digest").distinct().join(model_digests.withColumnRenamed("model_digest", "expected"), "run_id", "left")
        out.append(_found(held.where(~F.col("model_digest").eqNullSafe(F.col("expected"))), F.when(F.col("expected").isNull(), "ModelArtifactNotFound").otherwise("ModelDigestMismatch")))
    known = F.broadcast(cells.select("endpoint", "substance", F.col("count").alias("__count")))
    ends, registry = (F.broadcast(cells.select(c).distinct().withColumn(f"__{c}", F.lit(True))) for c in ("endpoint", "substance"))
    rows = genesis_rows.join(known, ["endpoint", "substance"], "left").join(ends, "endpoint", "left").join(registry, "substance", "left")
    code = F.when(F.col("__endpoint").isNull(), "GenesisTopologyMismatch").when(F.col("__substance").isNull(), "GenesisRegistryMismatch").when(~F.col("count").eqNullSafe(F.col("__count")), "GenesisStocksMismatch")
    out.append(_found(rows.withColumn("code", code).where("code IS NOT NULL").select("run_id", "code").distinct(), F.col("code")))
    sizes = genesis_rows.groupBy("run_id").agg(F.count_distinct("endpoint", "substance").alias("n")).crossJoin(F.broadcast(cells.agg(F.count("*").alias("__n"))))
    out.append(_found(sizes.where("n < __n"), "GenesisTopologyMismatch"))
    return reduce(DataFrame.unionByName, out).distinct()


def transfer_violations(model: Model, transfers: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Transfers that the model could not have made, record by record."""
    spark = transfers.sparkSession
    t = tables_of(spark, model)
    seeds = ledger.seed_cells(t["endpoints"].where("kind = 'finite'"), t["substances"], t["initial_stocks"]) if seeds is None else seeds
    seq = F.col("seq")
    units = F.broadcast(t["substances"].select("substance", "quantum"))
    out = [
        _found(transfers.where(~F.col("timestep").between(model.first, model.last)), "TimestepOutsideHorizon", seq),
        _found(validate.endpoint_kinds(transfers, F.broadcast(t["endpoints"])), F.col("violation"), seq),
        _found(ledger.undeclared(transfers.where("source <> target"), F.broadcast(t["edges"])), "UndeclaredConnection", seq),
        _found(transfers.join(units, "substance", "left_anti"), "TransferRegistryMismatch", seq),
        _found(ledger.inexact(transfers, units), "NonQuantumTransfer", seq),
        _found(transfers.where((F.col("count") < 0) | (F.col("count") > MAX_COUNT)), "CountAboveCeiling", seq),
        _found(ledger.overdrafts(transfers, seeds), "Overdraw", seq),
        _found(ledger.over_ceiling(transfers, seeds), "NumericalConservationLoss", seq),
    ]
    return reduce(DataFrame.unionByName, out).distinct()


def read(model: Model, genesis_rows: DataFrame, transfers: DataFrame, seal_rows: DataFrame, model_digests: DataFrame | None = None) -> DataFrame:
    """run_id, status, last_timestep (the horizon's end, or a prefix's last transfer), transfers and violation (the first by record) of every run."""
    spark = transfers.sparkSession
    t = tables_of(spark, model)
    cells = ledger.seed_cells(t["endpoints"].where("kind = 'finite'"), t["substances"], t["initial_stocks"])
    expected = genesis_rows.select("run_id").distinct().withColumn("model_digest", F.lit(model.digest)) if model_digests is None else model_digests
    bad = log_violations(genesis_rows, transfers, seal_rows).unionByName(genesis_violations(genesis_rows, cells, expected)).unionByName(transfer_violations(model, transfers))
    worst = bad.groupBy("run_id").agg(F.min(F.struct("seq", "violation"))["violation"].alias("violation"))
    runs = genesis_rows.select("run_id").unionAll(transfers.select("run_id")).unionAll(seal_rows.select("run_id")).distinct()
    sums = transfers.groupBy("run_id").agg(F.count("*").alias("transfers"), F.max("timestep").alias("reached"))
    out = runs.join(sums, "run_id", "left").join(seal_rows.groupBy("run_id").agg(F.min("final_timestep").alias("final")), "run_id", "left").join(worst, "run_id", "left")
    status = F.when(F.col("violation").isNotNull(), INVALID).when(F.col("final").isNull(), RESUMABLE).otherwise(COMPLETE)
    return out.select("run_id", status.alias("status"), F.coalesce("final", "reached").alias("last_timestep"), F.coalesce("transfers", F.lit(0)).cast("long").alias("transfers"), "violation")


def read_completed(model: Model, genesis_rows: DataFrame, transfers: DataFrame, seal_rows: DataFrame, model_digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The transfers of the runs that are complete, and run_id and violation of all others (a prefix lacks MissingCompletionSeal)."""
    states = read(model, genesis_rows, transfers, seal_rows, model_digests)
    refused = states.where(F.col("status") != COMPLETE).select("run_id", F.coalesce("violation", F.lit("MissingCompletionSeal")).alias("violation"))
    return transfers.join(states.where(F.col("status") == COMPLETE).select("run_id"), "run_id", "left_semi"), refused


def replay_against(genesis_rows: DataFrame, model: Model) -> DataFrame:
    """Runs that another model began: run_id, model_digest."""
    return genesis_rows.select("run_id", "model_digest").distinct().where(F.col("model_digest") != model.digest)


def resume(spark: SparkSession, model: Model, stored: DataFrame, params: DataFrame | None = None, forcings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs are made again and what is stored of each is compared, record by record: the whole logs of the runs whose prefix
    agrees, in place of the prefixes, and run_id and seq of the first difference of the others."""
    return replaced(stored, execute.run(spark, model, params, forcings=forcings))


def replaced(stored: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    differs = ledger.divergence(stored, generated)
    return generated.join(differs, "run_id", "left_anti"), differs


def state_at(transfers: DataFrame, cells: DataFrame, states: DataFrame, timestep: int, first: int) -> DataFrame:
    """run_id, endpoint, substance, balance and presence at the end of a timestep, for each run of states (run_id, last_timestep)
    and each of cells (endpoint, substance, count, modelled): absent outside what the run covers, and there without a balance."""
    moved = ledger.signed_legs(transfers.where(F.col("timestep") <= timestep)).groupBy(*ledger.CELL).agg(F.sum("delta").alias("moved"))
    rows = states.select("run_id", "last_timestep").crossJoin(F.broadcast(cells.select("endpoint", "substance", "count", "modelled"))).join(moved, list(ledger.CELL), "left")
    state = series.presence(F.col("modelled"), F.lit(timestep), F.lit(first), F.coalesce("last_timestep", F.lit(first - 1)))
    rows = rows.withColumn("presence", state)
    return rows.select(*ledger.CELL, F.when(F.col("presence") == series.PRESENT, F.col("count") + F.coalesce("moved", F.lit(0))).alias("balance"), "presence")
