"""A log that is still being written: running balances, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_log(spark, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_balances(transfers: DataFrame) -> DataFrame:
    """The balance of each cell so far; the state has a row a cell (outputMode "update" or "complete")."""
    debit = F.struct(F.col("source").alias("endpoint"), (-F.col("count")).alias("delta"))
    credit = F.struct(F.col("target").alias("endpoint"), F.col("count").alias("delta"))
    legs = transfers.select("run_id", "substance", F.inline(F.array(debit, credit)))
    return legs.groupBy("run_id", "endpoint", "substance").agg(F.sum("delta").alias("balance"))


def windowed_flow(transfers: DataFrame, instant: str, length: str, late: str) -> DataFrame:
    """Counts by source and window of event time; a window closes once the watermark has passed it, and later records are left out."""
    return transfers.withWatermark(instant, late).groupBy(F.window(instant, length), "source", "substance").agg(F.sum("count").alias("count"))


def start(frame: DataFrame, checkpoint: str, mode: str, name: str):
    """In memory, for tests and dashboards; available data is read and the query ends."""
    return frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
