"""Structured Streaming: windowed counts, incremental ingest, folding of answer tokens.

Watermarks bound the state; events later than the watermark are dropped, as usual.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their values per tumbling window and kind."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions per user: events less than `gap` apart."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.session_window("_at", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_deliveries(rows: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once; repeats that arrive within the watermark are dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def fold_tokens(frames: DataFrame) -> DataFrame:
    """frames(key string, seq long, kind, token) -> (key, text) once the EOS frame and all before it are there."""

    def fold(key, batches, state):
        have = dict(zip(*state.get)) if state.exists else {}
        for pdf in batches:
            have.update({int(s): ("" if k == "SOS" else "\x00" if k == "EOS" else t) for s, k, t in zip(pdf["seq"], pdf["kind"], pdf["token"])})
        end = next((s for s, t in have.items() if t == "\x00"), None)
        if end is not None and len(have) == end + 1:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "text": [" ".join(have[i] for i in range(end) if have[i])]})
        else:
            state.update((list(have), list(have.values())))

    return frames.groupBy("key").applyInPandasWithState(fold, "key string, text string", "seqs array<long>, tokens array<string>", "append", "NoTimeout")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into an in-memory table of the driver; for reports and tests."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there now and append to a parquet table; the checkpoint remembers what was read."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
