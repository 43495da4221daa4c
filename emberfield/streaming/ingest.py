"""Incremental ingest with Structured Streaming: upserts, keyed state, duplicates, daily activity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import shared_folder
from ..sources.keyed import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 4) -> DataStreamReader:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, handing every micro-batch to ``each``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def stream_upsert(
    spark: SparkSession, path: str, schema: T.StructType, shape: Callable[[DataFrame], DataFrame], key: str, changing: tuple[str, ...],
    files: int = 2, folder: str | None = None, time: str = "detected_at", every: int = 8,
) -> DataFrame:
    """Reads files as they come, shapes each micro-batch into events and merges them by key (``KeyedTable``).

    Started again on the same ``folder`` it takes only files that it has not seen.
    """
    folder = folder or shared_folder(spark, "upsert")
    shaped = shape(spark.createDataFrame([], schema)).schema
    table = KeyedTable(spark, f"{folder}/table", shaped, [key], changing, time, every=every)
    drain(file_stream(spark, path, schema, files), lambda b, n: table.append(shape(b), n), f"{folder}/checkpoint")
    return table.read()


class LatestRow(StatefulProcessor):
    """Keeps each key's row and emits it whenever a row changes it.

    A new key is emitted as it is.  Of a known one the columns in ``changing`` follow the latest row, by
    ``time`` and then by all columns in their order; earlier rows change nothing, whenever they come, and a
    row without a time is earlier than any other.  State goes once the watermark is ``keep_ms`` past its
    time, if that is given.
    """

    def __init__(self, key: str, columns: list[str], changing: tuple[str, ...], time: str, kinds: T.StructType, keep_ms: int | None):
        self.key, self.columns, self.changing, self.time, self.kinds, self.keep_ms = key, columns, changing, time, kinds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.kinds)

    def _place(self, row: dict) -> list:
        return [(row[c] is not None, row[c]) for c in (self.time, *self.columns)]

    def _ends(self, row: dict) -> int:
        return int(pd.Timestamp(row[self.time]).timestamp() * 1000) + self.keep_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """One row per key and micro-batch at most, the state after all of its rows."""
        kept = dict(zip(self.columns, self.row.get(), strict=True)) if self.row.exists() else None
        before = kept
        for batch in rows:
            told = [{c: None if pd.isna(r[c]) else r[c] for c in self.columns} for r in batch.to_dict("records")]
            for r in sorted(told, key=self._place):
                if kept is None:
                    kept = r
                elif self._place(r) > self._place(kept):
                    kept = kept | {c: r[c] for c in (*self.changing, self.time)}
        if kept is not None and kept != before:
            self.row.update(tuple(kept[c] for c in self.columns))
            if self.keep_ms is not None and kept[self.time] is not None:
                self.handle.registerTimer(self._ends(kept))
            yield pd.DataFrame([{self.key: key[0], **kept}])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A timer of a former row finds a later one and leaves it."""
        if self.row.exists():
            kept = dict(zip(self.columns, self.row.get(), strict=True))
            if self._ends(kept) <= expiredTimerInfo.getExpiryTimeInMs():
                self.row.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_latest(
    spark: SparkSession, path: str, schema: T.StructType, key: str, changing: tuple[str, ...], time: str, files: int = 2,
    keep_ms: int | None = None, delay: str = "0 seconds", folder: str | None = None,
) -> DataFrame:
    """(key, other columns, batch): the update stream of a keyed table, a row for each change, from state alone.

    No table is read again: the state store holds a row per key, spread by key, and goes on after a
    restart from the checkpoint.  With ``keep_ms`` a key's state expires by event time, ``delay`` being the
    watermark's, and rows later than the watermark are dropped.
    """
    folder = folder or shared_folder(spark, "latest")
    columns = [c for c in schema.names if c != key]
    kinds = T.StructType([schema[c] for c in columns])
    out = T.StructType([schema[key], *kinds.fields])
    processor = LatestRow(key, columns, changing, time, kinds, keep_ms)
    provider = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(provider, None)
    # This operator's state needs a store with several columns.
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = file_stream(spark, path, schema, files)
        stream = stream if keep_ms is None else stream.withWatermark(time, delay)
        updates = stream.groupBy(key).transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="None" if keep_ms is None else "EventTime"
        )
        drain(updates, lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"), f"{folder}/checkpoint", "update")
    finally:
        spark.conf.unset(provider) if former is None else spark.conf.set(provider, former)
    numbered = T.StructType([*out.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(numbered).parquet(f"{folder}/rows")


def stream_dedup(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the watermark's delay."""
    folder = shared_folder(spark, "dedup")
    stream = file_stream(spark, path, schema).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    drain(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"), f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)


def stream_daily_activity(spark: SparkSession, path: str, schema: T.StructType, delay: str) -> DataFrame:
    """Detections and brightest value per cell and day; updated groups replace their former rows."""
    folder = shared_folder(spark, "daily")
    stream = file_stream(spark, path, schema).withWatermark("timestamp", delay)
    sums = stream.groupBy(F.window("timestamp", "1 day"), "grid_id").agg(F.count("*").alias("n"), F.max("brightness").alias("max_brightness"))
    flat = sums.select(F.col("window.start").cast("date").alias("date"), "grid_id", "n", "max_brightness")
    table = KeyedTable(spark, f"{folder}/table", flat.schema, ["date", "grid_id"])
    drain(flat, table.append, f"{folder}/checkpoint", "update")
    return table.read()
