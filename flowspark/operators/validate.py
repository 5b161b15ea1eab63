"""Checks as queries: each gives the rows that violate it, with a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMMAR = "^[a-z][a-z0-9_-]*$"


def identity_code(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), "Empty").when(~text.rlike("^[a-z]"), "InvalidStart").when(~text.rlike(GRAMMAR), "InvalidCharacter")


def identities(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("violation", identity_code(F.col(column))).where("violation IS NOT NULL")


def repeated(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("violation", F.lit(code))


def unmatched(rows: DataFrame, known: DataFrame, keys: list[str], code: str) -> DataFrame:
    return rows.join(known.select(*keys), keys, "left_anti").withColumn("violation", F.lit(code))


def amounts(rows: DataFrame, column: str, signed: bool = False) -> DataFrame:
    x = F.col(column)
    code = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "NonFinite")
    code = code if signed else code.when(x < 0, "Negative")
    return rows.withColumn("violation", code).where("violation IS NOT NULL")


def table_order(knots: DataFrame) -> DataFrame:
    """Knots that do not lie after the one before them."""
    w = Window.partitionBy("table_id").orderBy("idx")
    return knots.withColumn("before", F.lag("x").over(w)).where("x <= before").withColumn("violation", F.lit("AbscissaeNotStrictlyIncreasing"))


def endpoint_kinds(transfers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Transfers that name unknown endpoints, or give one the wrong kind, or lead to their own source."""
    e = endpoints.select(F.col("endpoint").alias("__e"), F.col("kind").alias("__k"))
    out = transfers
    for side in ("source", "target"):
        out = out.join(e.withColumnsRenamed({"__e": f"__{side}", "__k": f"__{side}_kind"}), F.col(side) == F.col(f"__{side}"), "left")
    code = F.when(F.col("source") == F.col("target"), "SelfTransfer").when(F.col("__source").isNull() | F.col("__target").isNull(), "UnknownEndpoint")
    code = code.when((F.col("__source_kind") != F.col("source_kind")) | (F.col("__target_kind") != F.col("target_kind")), "EndpointKindMismatch")
    return out.withColumn("violation", code).where("violation IS NOT NULL").select("run_id", "seq", "violation")
