"""What the operators share: tables, shared scratch storage and blocks of Arrow rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame, SparkSession

from tracefold.sources.scratch import Scratch, shared_dir  # noqa: F401

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of an Arrow batch. Texts may be long, and the JVM and the worker each hold a batch or two.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand texts to Python workers in batches of at most ``BATCH_ROWS`` rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives back memory that it no longer uses, as it may wait or go on to other work."""

    @wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return held


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in column ``text`` each, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        yield batch.slice(at)


def texts(batch: pa.RecordBatch, text: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
