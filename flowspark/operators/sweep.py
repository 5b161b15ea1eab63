"""Parameter sweeps: one row for each run and parameter, to run a held model many times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Model


def sweep(spark: SparkSession, runs: int, target: tuple[str, str, str], value) -> DataFrame:
    """value: a column of id (0 .. runs - 1)."""
    c, s, p = target
    return spark.range(runs).select(F.format_string("run-%06d", "id").alias("run_id"), F.lit(c).alias("compartment"), F.lit(s).alias("substance"), F.lit(p).alias("parameter"), value.cast("double").alias("value"))


def violations(model: Model, params: DataFrame) -> DataFrame:
    """Substitutions that name no declared parameter, are not finite, or name one twice in a run."""
    known = params.sparkSession.createDataFrame([(c, s, p) for (c, s), r in model.rules.items() for p in r.parameters] or [("", "", "")], "compartment string, substance string, parameter string")
    key = ["compartment", "substance", "parameter"]
    unknown = params.join(known, key, "left_anti").select("run_id", *key, F.lit("ParameterNotDeclared").alias("violation"))
    odd = params.where(F.isnan("value") | (F.abs("value") == float("inf"))).select("run_id", *key, F.lit("NonFiniteValue").alias("violation"))
    twice = params.groupBy("run_id", *key).agg(F.count("*").alias("n")).where("n > 1").select("run_id", *key, F.lit("DuplicateTarget").alias("violation"))
    return unknown.unionByName(odd).unionByName(twice)
