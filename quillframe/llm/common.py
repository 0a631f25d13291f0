"""What the operators of this subpackage share: reading, written tables, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: with texts of up to some 100 kB a batch stays well under 100 MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as keep it off columns."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small: one value for all operators, which the session keeps, for results are lazy; a smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def sliced(it: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; one of our own only where that is unset and all of the session is on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_quillframe_folder", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="quillframe-")
            spark.sparkContext._quillframe_folder = folder
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> list[str]:
    """The column's values, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def batches(schema: pa.Schema, f):
    """A function for mapInArrow: f takes a record batch and returns columns for schema."""

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(f(b), schema.types, strict=True)], schema=schema)

    return over


def trimmed(f):
    """f (batches to batches) that gives freed memory back to the system behind its last batch: Python workers outlive their tasks."""

    def over(it):
        yield from f(it)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to trim
            return

    return over


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
