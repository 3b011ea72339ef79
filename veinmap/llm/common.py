"""What the training-data operators share: tables, fresh names, texts in chunks. Cut lineage is the library's."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, scratch, shared_dir

__all__ = ["array_chunks", "fresh", "materialize", "scratch", "shared_dir", "small_batches", "table", "text_chunks"]

#: Bytes of a batch between the JVM and Python workers, where the session does not say.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case rules."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of batches to Python workers, unless the session does. Rows alone bound nothing where texts are long: both sides hold a batch whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return what this process has freed to the system: workers live on between tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def array_chunks(batch, column: str, limit: int = 1 << 20):
    """(first, last, binary array) over a text column of a record batch, so that a chunk holds about limit bytes, or one longer text.

    What was freed goes back to the system after each batch: two workers and a JVM
    share an executor's memory.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    values = batch.column(column)
    values = values.view(pa.binary()) if pa.types.is_string(values.type) else values
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends, n, first = np.cumsum(sizes), len(sizes), 0
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last, values.slice(first, last - first)
        first = last
    give_back()


def text_chunks(batch, column: str, limit: int = 1 << 20):
    """array_chunks with the texts as a list of bytes; nulls come as empty bytes."""
    for first, last, values in array_chunks(batch, column, limit):
        yield first, last, [x or b"" for x in values.to_pylist()]
