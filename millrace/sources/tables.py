"""Sources and sinks: files of any format that Spark reads, with explicit schemas where it can't know them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Read ``path``; csv and json need a schema, so that no pass is spent on guessing it."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """Write ``df``, in a folder for each value of ``partition_by``."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    import tempfile

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it again: for what several steps need."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def through(df: DataFrame, kind: str, **options) -> DataFrame:
    """Write ``df`` in a format and read it back with its own schema."""
    at = scratch(df.sparkSession, kind)
    write(df, at, kind, **options)
    return read(df.sparkSession, at, kind, None if kind in ("parquet", "orc") else df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), **options)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Save as a table bucketed and sorted by ``keys``; joins of two such tables don't shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
