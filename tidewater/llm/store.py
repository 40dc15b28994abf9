"""Tables that every executor can read again, and table reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidewater-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and its real size is known to the planner."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Public setting of Spark; off unless the session says otherwise.
_RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when the query ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_RELEASED, "false")
    spark.conf.set(_RELEASED, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASED, before)


#: Public setting of Spark, and bytes of rows that go to a Python worker at once where texts are long.
_BATCH, SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries run inside send rows to Python in batches of about ``SENT_BYTES``, not of whole file splits.

    The JVM, beside its heap, and the worker each hold a batch whole. A longer row is alone.
    """
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, SENT_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def quoted(df: DataFrame) -> list[str]:
    """The columns of df as names that may hold dots and backticks."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column in letters of either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a column holds about ``size`` bytes in each; a longer value is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
