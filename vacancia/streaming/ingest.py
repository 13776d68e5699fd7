"""Structured Streaming forms: idempotent ingest, folded state, and micro-batches over due rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "events.parquet", files: int = 100) -> DataFrame:
    """The event files of a folder as a stream, times as timestamps so that they can carry a watermark."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "12 hours") -> DataFrame:
    """Events once a key, as far apart as the watermark's delay: bounded state."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rolling_counts(events: DataFrame, time: str = "ts", delay: str = "12 hours") -> DataFrame:
    """Events by type in the 24 hours up to each hour. An extension: the application counts once on request."""
    return events.withWatermark(time, delay).groupBy(F.window(time, "24 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))


class TenantFold(StatefulProcessor):
    """Failures in a row, and the last health, of each tenant over all its results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "failures int, seen long, health string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        failures, seen, health = self.state.get() if self.state.exists() else (0, 0, "healthy")
        for batch in rows:
            for status in batch.sort_values("sequence")["status"]:
                seen += 1
                if status == "skipped":
                    continue
                failures = failures + 1 if status == "error" else 0
                health = "healthy" if not failures else "temporarily_failed" if failures < 3 else "suspected_dead" if failures < 5 else "confirmed_dead"
        self.state.update((failures, seen, health))
        yield pd.DataFrame({"tenant": [key[0]], "failures": [failures], "seen": [seen], "health": [health]})

    def close(self) -> None:
        pass


def fold_tenants(results: DataFrame) -> DataFrame:
    """The state of each tenant after each micro-batch."""
    return results.groupBy("tenant").transformWithStateInPandas(TenantFold(), outputStructType="tenant string, failures int, seen long, health string", outputMode="Update", timeMode="None")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs what is there in micro-batches to the end; ``each`` gets a batch and its id, to be made idempotent by."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its end into Parquet files under ``folder``; a batch that runs again replaces its own files."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    run_available(stream, f"{folder}/checkpoint", each, mode)
    spark = stream.sparkSession
    return spark.read.option("basePath", f"{folder}/table").parquet(f"{folder}/table")
