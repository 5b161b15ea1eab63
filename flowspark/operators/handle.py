"""One handle on all runs of a model: what completed, its log and evidence, and its series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Model
from ..sources import log
from . import execute, runlog, series


@dataclass(frozen=True)
class Runs:
    """Runs of a model by their parameters (as execute.run takes them); every table has the completed runs alone, but status()."""

    spark: SparkSession
    model: Model
    params: DataFrame | None = None
    forcings: DataFrame | None = None

    def _given(self) -> DataFrame:
        return execute._params(self.spark, self.params)

    def status(self) -> DataFrame:
        return execute.outcomes(self.spark, self.model, self.params, forcings=self.forcings)

    def completed(self) -> DataFrame:
        return self.status().where(F.col("status") == execute.COMPLETED).select("run_id")

    def transfers(self) -> DataFrame:
        return execute.run(self.spark, self.model, self.params, forcings=self.forcings)

    def model_digests(self) -> DataFrame:
        """run_id, model_digest: of the model with the run's parameters."""
        return runlog.model_digests(self.model, self._given().join(self.completed(), "run_id", "left_semi"))

    def genesis(self) -> DataFrame:
        return runlog.genesis(self.spark, self.model, self.model_digests())

    def authoritative_log(self) -> tuple[DataFrame, DataFrame]:
        """The records of each run (genesis, transfers, seal), and run_id, log_digest and transfer_count."""
        begun, moves = self.genesis(), self.transfers()
        seals = runlog.seals(begun, moves, self.model.last)
        return log.records(begun.select("run_id", "model_digest").distinct(), moves, seals), seals.select("run_id", "log_digest", "transfer_count")

    def replay_against(self, other: Model) -> DataFrame:
        """Runs that another model than this one began: run_id, model_digest."""
        return runlog.replay_against(self.genesis(), other)

    def quantum(self, substance: str) -> float:
        return self.model.quantum(substance)

    def series(self, direction: str, compartment: str, substance: str, read: tuple[int, int] | None = None) -> DataFrame:
        """run_id, timestep, count, value and presence over read (or the horizon); not modelled where the model has no such cell."""
        horizon = (self.model.first, self.model.last)
        modelled = compartment in self.model.topology.kinds and substance in self.model.substances
        quantum = self.quantum(substance) if modelled else None
        return series.ranged_runs(self.transfers(), self.completed(), direction, compartment, substance, horizon, read or horizon, quantum, modelled)
