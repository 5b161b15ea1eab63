"""Model documents as JSON files, and forcing series and interpolation tables from tables of any size."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Model, ModelError


def read_models(spark: SparkSession, path: str) -> dict[str, Model]:
    """By file, the models of the JSON documents under path; documents are driver-sized."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").collect()
    return {r.file: Model.from_document(json.loads(r.value)) for r in rows}


def write_document(spark: SparkSession, model: Model, path: str) -> None:
    text = json.dumps(model.document, sort_keys=True, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def tables_of(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """The model's lists as DataFrames."""
    t = model.topology
    make = spark.createDataFrame
    stocks = [(e, s, model.initial_count(e, s), a) for (e, s), a in model.stocks.items()]
    steps = range(model.first, model.last + 1)
    return {
        "endpoints": make([(e, t.kinds[e], t.rank[e]) for e in t.order], "endpoint string, kind string, topo_rank int"),
        "edges": make(t.edges or [("", "")], "source string, target string").where("source <> ''"),
        "substances": make([(s, *model.units[s]) for s in model.substances], "substance string, unit string, quantum double"),
        "initial_stocks": make(stocks or [("", "", 0, 0.0)], "endpoint string, substance string, count long, amount double").where("endpoint <> ''"),
        "forcing": make([(n, k, v) for n, vs in model.forcings.items() for k, v in zip(steps, vs)] or [("", 0, 0.0)], "forcing_id string, timestep long, value double").where("forcing_id <> ''"),
        "knots": make([(t.id, k, x, y, t.policy) for t in model.tables.values() for k, (x, y) in enumerate(t.knots)] or [("", 0, 0.0, 0.0, "")], "table_id string, idx int, x double, y double, policy string").where("table_id <> ''"),
    }


def document_with(document: dict, forcing: DataFrame | None = None, knots: DataFrame | None = None) -> dict:
    """The document with forcings (forcing_id, timestep, value) and tables (table_id, x, y, policy) read from DataFrames in place of
    its own of the same names. They become part of the document, so they must be of its size; a run's own series of any
    size go to execute.run(forcings=) instead."""
    out = json.loads(json.dumps(document))
    first, last = out["horizon"]["first"], out["horizon"]["last"]
    if forcing is not None:
        if bad := forcing_violations(forcing, first, last).first():
            raise ModelError(f"ValueCountMismatch: {bad.forcing_id}")
        rows = forcing.groupBy("forcing_id").agg(F.array_sort(F.collect_list(F.struct("timestep", "value"))).alias("v")).collect()
        new = {r.forcing_id: {"id": r.forcing_id, "horizon": {"first": first, "last": last}, "values": [x.value for x in r.v]} for r in rows}
        out["forcings"] = [f for f in out["forcings"] if f["id"] not in new] + list(new.values())
    if knots is not None:
        rows = knots.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"), F.first("policy").alias("policy")).collect()
        new = {r.table_id: {"id": r.table_id, "numerical_semantics_version": "v1", "boundary_policy": r.policy, "abscissae": [k.x for k in r.k], "ordinates": [k.y for k in r.k]} for r in rows}
        out["interpolation_tables"] = [t for t in out["interpolation_tables"] if t["id"] not in new] + list(new.values())
    return out


def forcing_violations(forcing: DataFrame, first: int, last: int) -> DataFrame:
    """Series with a value missing, repeated, outside the horizon or not finite."""
    odd = F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf"))
    checked = forcing.groupBy("forcing_id").agg(
        F.count("*").alias("n"), F.countDistinct("timestep").alias("steps"), F.count_if(odd).alias("non_finite"), F.count_if(~F.col("timestep").between(first, last)).alias("outside")
    )
    return checked.where((F.col("n") != last - first + 1) | (F.col("steps") != F.col("n")) | (F.col("non_finite") > 0) | (F.col("outside") > 0))


def parse_run_id(text: str | bytes) -> str:
    """32 hexadecimal digits, from 16 bytes or from text in which hyphens are free."""
    if isinstance(text, bytes):
        if len(text) != 16:
            raise ModelError("InvalidRunId")
        return text.hex()
    digits = text.replace("-", "")
    if not re.fullmatch("[0-9a-fA-F]{32}", digits):
        raise ModelError("InvalidRunId")
    return digits.lower()
