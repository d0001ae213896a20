"""Event streams: windows with watermarks, and a live check of hash-chained journals.

Extensions: the notes themselves come in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def _timed(events: DataFrame, time: Column | str, late: str) -> DataFrame:
    timed = events.withColumn("_at", (F.col(time) if isinstance(time, str) else time).cast("timestamp"))  # watermarks need a zoned time
    return timed.withWatermark("_at", late) if events.isStreaming else timed


def tumbling(events: DataFrame, width: str, *keys: str, time: str = "ts", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Count and sum of each key and window; the same for batches and streams."""
    grouped = _timed(events, time, late).groupBy(F.window("_at", width), *keys)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    grouped = _timed(events, time, late).groupBy(F.session_window("_at", gap), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def journal_stream(entries: DataFrame) -> DataFrame:
    """Entries (run, seq, previous, entry) that don't extend their run's chain; the
    state of a run is its last sequence number and digest."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, digest = state.get if state.exists else (-1, "")
        rows = pd.concat(list(batches)).sort_values("seq")
        bad = []
        for seq, previous, entry in zip(rows["seq"], rows["previous"], rows["entry"]):
            if seq != last + 1 or previous != digest:
                bad.append((key[0], int(seq)))
            last, digest = int(seq), entry
        state.update((last, digest))
        yield pd.DataFrame(bad, columns=["run", "seq"])

    run_type = entries.schema["run"].dataType.simpleString()
    return entries.groupBy("run").applyInPandasWithState(check, f"run {run_type}, seq bigint", "last bigint, digest string", "append", GroupStateTimeout.NoTimeout)
