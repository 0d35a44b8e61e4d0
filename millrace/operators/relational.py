"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides are unioned and carried forward in one window over (time, side): one
    shuffle, linear, with no pairs. ``values`` are right columns; left rows without a
    match, or with a null key or time, have nulls.
    """
    both = F.struct(*values)
    x = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(both.alias("x")).schema["x"].dataType).alias("_r"))
    y = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(x.schema["_l"].dataType).alias("_l"), both.alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    met = x.unionByName(y).withColumn("_m", F.last_value("_r", ignoreNulls=True).over(w)).where("_s = 1")
    return met.select("_l.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_m.{v}")).alias(v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, key: str, ts: str, start: str, stop: str, width_s: int) -> DataFrame:
    """Points with the spans [start, stop] of their key that hold them; time buckets join first.

    A span is dealt to each bucket it touches, so a hot key is split over time.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width_s * 1_000_000))
    x = points.withColumn("_b", bucket(ts))
    y = spans.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(stop)))).withColumnRenamed(key, "_key")
    return x.join(y, (x[key] == y["_key"]) & (x["_b"] == y["_b"]) & (x[ts] >= y[start]) & (x[ts] <= y[stop])).drop(y["_b"]).drop("_b", "_key")


def top_per_group(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def sessions(events: DataFrame, user: str, ts: str, gap_s: int) -> DataFrame:
    """(user, session, start, stop, n): runs of a user's events with gaps under ``gap_s`` seconds."""
    return events.groupBy(F.session_window(F.col(ts).cast("timestamp"), f"{gap_s} seconds").alias("w"), user).agg(F.count("*").alias("n"))


def not_in(left: DataFrame, column: str, right: DataFrame, of: str) -> DataFrame:
    """Rows of ``left`` whose ``column`` is NOT IN the column ``of`` of ``right``, with SQL's rules for nulls.

    Spark's own NOT IN broadcasts the right side whatever its size; here both sides are
    dealt by key, and one row tells whether the right side is empty or holds a null.
    """
    told = right.agg(F.count("*").alias("_n"), F.count_if(F.col(of).isNull()).alias("_nulls"))
    kept = left.join(right.select(F.col(of).alias("_of")), F.col(column) == F.col("_of"), "left_anti").crossJoin(F.broadcast(told))
    return kept.where(F.col("_n").eqNullSafe(0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).select(*left.columns)
