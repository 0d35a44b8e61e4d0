"""Windowed, stateful and joined streams, and how a finite stream is drained."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.tables import scratch


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream; the schema comes from the table, as streams don't infer one.

    The pattern fits the table whether it is a folder or a single file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def timed(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """With a watermark; it needs a timestamp with a time zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, width: str, *keys: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """(keys, start, stop, n, total) of tumbling windows, or of sliding ones."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def sessions(events: DataFrame, gap: str, *keys: str, ts: str = "ts") -> DataFrame:
    """(keys, start, stop, n); the stop is the last event's time plus the gap."""
    rows = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def joined(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Pairs of two watermarked streams by key and time: right at or after left by ``within`` at most."""
    x = left.select(F.col("event_id").alias("left_id"), F.col(key).alias("k"), F.col("ts").alias("t0"))
    y = right.select(F.col("event_id").alias("right_id"), F.col(key).alias("j"), F.col("ts").alias("t1"))
    on = (F.col("k") == F.col("j")) & (F.col("t1") >= F.col("t0")) & (F.col("t1") <= F.col("t0") + F.expr(f"INTERVAL {within}"))
    return x.join(y, on).select("left_id", "right_id")


def running_totals(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, total, highest) after each batch, from arbitrary state of three numbers for each key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, highest = state.get if state.exists else (0, 0.0, float("-inf"))
        for x in batches:
            n, total, highest = n + len(x), total + float(x["value"].sum()), max(highest, float(x["value"].max()))
        state.update((n, total, highest))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "highest": [highest]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double, highest double", "n long, total double, highest double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a finite stream to its end and read what it wrote.

    Each batch goes to a folder of its own number, so a batch that is tried again
    replaces itself. Complete mode keeps the last batch; others keep all, with their
    number in the column ``batch`` in update mode.
    """
    spark = stream.sparkSession
    at = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'last' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{at}/out/last")
    out = spark.read.parquet(f"{at}/out")
    return out if mode == "update" else out.drop("batch")
