"""Continuous ingestion into a store, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Store


def watch(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, once: bool = True) -> StreamingQuery:
    """Puts each portion into the table by id; a portion that is replayed after a failure changes nothing."""

    def put(df: DataFrame, _: int) -> None:
        store.upsert(name, prepare(df))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def tumbling(events: DataFrame, at: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark(at, late) if late else events
    return df.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark(at, late) if late else events
    return df.groupBy(F.window(at, width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark(at, late) if late else events
    return df.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def without_repeats(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each id once within the time that late rows may take."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
