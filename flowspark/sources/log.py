"""Logs as tables and as canonical text, with digests.

A run's digest is the SHA-256 of the digests of its blocks of BLOCK records in order, so a long log is hashed by many
tasks and no task holds more than a block's records or a run's block digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
FIELDS = ("timestep", "source", "target", "substance", "count")


def canonical_rows(transfers: DataFrame) -> DataFrame:
    """run_id, seq, line: each record as text whose parts cannot run into each other."""
    parts = [F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")) for f in FIELDS]
    return transfers.select("run_id", "seq", F.concat_ws(",", *parts).alias("line"))


def log_digests(transfers: DataFrame) -> DataFrame:
    """run_id, log_digest, transfer_count."""
    rows = canonical_rows(transfers).withColumn("block", F.floor(F.col("seq") / BLOCK))
    text = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", x))), lambda r: r[x]), "\n")
    blocks = rows.groupBy("run_id", "block").agg(F.sha2(text("line"), 256).alias("line"), F.count("*").alias("n")).withColumnRenamed("block", "seq")
    return blocks.groupBy("run_id").agg(F.sha2(text("line"), 256).alias("log_digest"), F.sum("n").alias("transfer_count"))


def bits(amount: Column) -> Column:
    """A double as text that no other double has (its binary digits in hexadecimal, with the exponent)."""
    return F.format_string("%a", amount)


def digests(genesis: DataFrame, transfers: DataFrame) -> DataFrame:
    """run_id, log_digest, transfer_count over a run's genesis (run_id, model_digest, numerical_semantics, endpoint, substance,
    count, amount) and its transfers with the bits of their amounts; two runs that begin otherwise digest otherwise."""
    text = lambda *parts: F.concat_ws(",", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])
    head = F.first(text(F.col("model_digest"), F.col("numerical_semantics")))
    cell = text(F.col("endpoint"), F.col("substance"), F.col("count").cast("string"), bits(F.col("amount")))
    begun = genesis.groupBy("run_id").agg(head.alias("head"), F.array_join(F.array_sort(F.collect_list(cell)), "\n").alias("cells"))
    begun = begun.select("run_id", F.sha2(F.concat_ws("\n", "head", "cells"), 256).alias("genesis_digest"))
    rows = transfers.select("run_id", "seq", text(*[F.col(f).cast("string") for f in FIELDS], bits(F.col("amount"))).alias("line")).withColumn("block", F.floor(F.col("seq") / BLOCK))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n")
    blocks = rows.groupBy("run_id", "block").agg(F.sha2(joined(), 256).alias("line"), F.count("*").alias("n")).withColumnRenamed("block", "seq")
    moved = blocks.groupBy("run_id").agg(joined().alias("blocks"), F.sum("n").alias("n"))
    out = begun.join(moved, "run_id", "left")
    return out.select("run_id", F.sha2(F.concat_ws("\n", "genesis_digest", "blocks"), 256).alias("log_digest"), F.coalesce("n", F.lit(0)).cast("long").alias("transfer_count"))


def records(genesis: DataFrame, transfers: DataFrame, seals: DataFrame) -> DataFrame:
    """Genesis, transfers and seal of each run as one table (run_id, seq, record, body)."""
    start = genesis.select("run_id", F.lit(-1).cast("long").alias("seq"), F.lit("genesis").alias("record"), F.to_json(F.struct("model_digest")).alias("body")).distinct()
    moves = transfers.select("run_id", "seq", F.lit("transfer").alias("record"), F.to_json(F.struct(*FIELDS)).alias("body"))
    end = seals.select("run_id", F.col("transfer_count").alias("seq"), F.lit("seal").alias("record"), F.to_json(F.struct("final_timestep", "transfer_count", "log_digest")).alias("body"))
    return start.unionByName(moves).unionByName(end)


def grammar_violations(rows: DataFrame) -> DataFrame:
    """Runs whose records are not genesis, transfers, and at most one seal, in this order."""
    w = Window.partitionBy("run_id").orderBy("seq")
    seen = rows.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("record").over(w))
    code = (
        F.when((F.col("n") == 1) & (F.col("record") != "genesis"), "GenesisNotFirst")
        .when((F.col("n") > 1) & (F.col("record") == "genesis"), "RepeatedGenesis")
        .when((F.col("before") == "seal") & (F.col("record") == "seal"), "AlreadySealed")
        .when(F.col("before") == "seal", "RecordAfterSeal")
    )
    return seen.withColumn("violation", code).where("violation IS NOT NULL").select("run_id", "seq", "violation")


def append(transfers: DataFrame, path: str) -> None:
    """The log as Parquet by run; only ever appended to."""
    transfers.write.mode("append").partitionBy("run_id").parquet(path)


def insert_models(spark, path: str, models: DataFrame) -> None:
    """models (digest, document), less those that path has: content decides, so a repeat adds nothing. Two documents of one
    digest, in models or against what path has, raise."""
    try:
        held = spark.read.parquet(path).select("digest", "document")
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], "digest string, document string")
    own = models.select("digest", "document").distinct()
    clash = own.unionByName(held).groupBy("digest").agg(F.count_distinct("document").alias("n")).where("n > 1").first()
    if clash:
        raise ValueError(f"DigestCollision: {clash.digest}")
    own.join(held.select("digest"), "digest", "left_anti").write.mode("append").parquet(path)
