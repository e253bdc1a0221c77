"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.sources.scratch import written

__all__ = ["id_and_text", "id_remainder", "in_small_batches", "is_held_out", "map_batches", "parts", "release", "table", "written"]

#: Rows and bytes that a worker takes at a time: bounds its memory when texts are many or very long.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
#: Bytes that Spark hands a worker at once, single rows apart.
ARROW_BYTES = 2_000_000
ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def is_held_out(id_col: str) -> Column:
    return F.coalesce(id_remainder(id_col) == 1, F.lit(False))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns the operators read, so that other columns, whatever their names, cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BATCH_ROWS rows and, but for single rows, BATCH_BYTES bytes."""
    at = 0
    while at < batch.num_rows:
        rows = min(BATCH_ROWS, batch.num_rows - at)
        while rows > 1 and batch.slice(at, rows).nbytes > BATCH_BYTES:
            rows //= 2
        yield batch.slice(at, rows)
        at += rows


def release() -> None:
    """Give freed memory back to the system: workers live on, and later stages have others' leftovers to bear."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's bound on the bytes of an Arrow batch is lowered to ARROW_BYTES; a lower one stays.

    Spark's own bounds, 10,000 rows and 64 MB, make buffers too large for the pool: the JVM takes them from the
    system one by one, and what it keeps of them adds up over the stages.  No row is left out or cut.
    """
    spark = df.sparkSession
    # The session's bound lasts, as the plan may be run at any later time.
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= ARROW_BYTES:
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """One output batch per slice of an input batch, see ``parts``.

    ``make`` runs once per task and returns the function that turns a dict of column lists into another;
    heavy set-up (automata, tokenizers) belongs in ``make``.
    """
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in parts(batch):
                work = work or make()
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        work = None
        release()

    return in_small_batches(df).mapInArrow(run, kind)
