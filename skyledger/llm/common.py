"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch are worked on in slices of about this many text bytes.
SLICE_BYTES = 2 << 20
#: The session's bound on the bytes of an Arrow batch, and what operators on whole texts set it to.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

#: What a Python worker keeps from task to task, by name.
CACHES: dict = {}


def trim() -> None:
    """Give memory that is free inside this worker back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def release() -> None:
    """Let go of kept caches: called in the tasks of operators that do not need them."""
    CACHES.clear()
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (as in tests) may do without; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skyledger-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of the steps that run now, the innermost last, by thread.
STEPS = threading.local()


def durable(df: DataFrame, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor
    depend on an executor that may be lost. Inside a ``tidy`` step the table goes with the step, but for its ``result``."""
    spark, steps = df.sparkSession, getattr(STEPS, "open", [])
    steps = steps[: len(steps) - result]
    path = f"{steps[-1] if steps else shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step whose first argument and result are DataFrames: the result is written, and the tables that were written on
    the way are deleted."""

    @functools.wraps(step)
    def run(df: DataFrame, *more, **named) -> DataFrame:
        spark = df.sparkSession
        folder = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
        STEPS.open = [*getattr(STEPS, "open", []), folder]
        try:
            return durable(step(df, *more, **named), result=True)
        finally:
            STEPS.open = STEPS.open[:-1]
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            gc.collect()
            spark._jvm.System.gc()  # Spark deletes shuffle files when the driver lets go of what made them

    return run


def schema_with(docs: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    """The schema of kept columns, whatever their names, and those that the DDL text ``more`` adds."""
    return T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(more).fields])


def crc32_mod(column, n: int):
    """crc32 of a value's decimal text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def with_text(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and, last, the text as UTF-8 bytes in ``_text``; a null text is empty. Batches that go to Python are cut by bytes."""
    docs.sparkSession.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))


def runs(batches: Iterator[pa.RecordBatch], column: str = "_text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into runs of rows of about ``most`` bytes of text, so that memory follows bytes and
    not row counts; a longer text comes alone."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(texts).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start), texts.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start), texts.slice(start)


def slices(batches: Iterator[pa.RecordBatch], column: str = "_text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As ``runs``, with the texts as a list."""
    for rows, texts in runs(batches, column):
        yield rows, texts.to_pylist()
