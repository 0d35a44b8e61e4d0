"""What the training-data operators share: shared storage, bounded Arrow batches, row-wise maps."""

from __future__ import annotations

import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
ITEM_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes and rows of one Arrow batch; a Python worker holds a few batches at a time.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes, so that very long texts don't add up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(at))
    context._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one is set only where none is."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        at = held or tempfile.mkdtemp(prefix="millrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Broadcast a materialised table if its measured size allows, else leave the join to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def packed(df: DataFrame, drop: tuple[str, ...] = (), **needed) -> DataFrame:
    """(row, needed...): all columns of ``df`` but ``drop`` inside one struct, so that no name of theirs clashes."""
    gone = {n.lower() for n in drop}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]
    return df.select(F.struct(*(kept or [F.lit(None).alias("_none")])).alias("row"), *(c.alias(n) for n, c in needed.items()))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: for what several steps need."""
    at = fresh_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def lower_ascii(col):
    """Lower-case A-Z alone; F.lower would touch other alphabets."""
    return F.translate(col, UPPER, UPPER.lower())


def words_of(col, separator: str = SPACE_CLASS):
    """Words between runs of ``separator``; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), separator), lambda w: w != "")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], add: list[tuple[str, T.DataType]], keep: list[str] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Append columns computed from whole Arrow batches.

    ``make()`` runs once in each task and returns the function from a batch to the
    new columns' values. A column of ``df`` with a new column's name is replaced.
    """
    bound_batches(df.sparkSession, batch_bytes)
    ship(df.sparkSession)
    new = {n for n, _ in add}
    folded = {n.lower() for n in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in folded and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in add)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        step = make()
        types = [to_arrow_type(t) for _, t in add]
        try:
            for batch in batches:
                values = step(batch)
                made = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
                made = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in made]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, *(n for n, _ in add)])
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages, beside the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """Texts one at a time; null counts as empty."""
    for x in batch.column(name):
        yield x.as_py() or ""


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that an operator wrote, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path.startswith("/"):
        shutil.rmtree(path, ignore_errors=True)
