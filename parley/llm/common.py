"""Session helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.scratch import file_system_of, settings, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A saved table has at least so many files for each core, where its job has as many tasks, and else one for so many
#: of the session's shuffle partitions, which a task then takes one after another.
FILES_A_CORE, PARTITIONS_A_FILE = 3, 3


def saved(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Written as Parquet to the shared folder and read again: a columnar cut of the lineage.

    It has fewer files than shuffle partitions: small files cost a store more than their bytes, and on a local one
    each makes the executor's JVM start processes to set permissions.  The job's shuffle files go when it ends, the
    table at the latest when the driver does; scratch() deletes tables earlier.  `batch_rows` bounds the rows of an
    Arrow batch, for rows that may be long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/parley-{uuid.uuid4().hex}"
    conf = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
    if batch_rows:
        conf["spark__sql__execution__arrow__maxRecordsPerBatch"] = str(batch_rows)
    with settings(spark, **conf):
        files = int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE
        df.coalesce(max(FILES_A_CORE * spark.sparkContext.defaultParallelism, files)).write.parquet(path)
    file_system, at = file_system_of(spark, path)
    file_system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes the table that a saved() frame reads."""
    file_system, at = file_system_of(df.sparkSession, df._parley_path)
    file_system.delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """A saved() whose tables are deleted when the block ends; what outlives it must be saved outside of it."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        made.append(saved(df, batch_rows))
        return made[-1]

    try:
        yield keep
    finally:
        for df in made:
            deleted(df)


def held_out(key: str | F.Column = "doc_id") -> F.Column:
    """True where crc32 of the id as text is divisible by five: rows never learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled ids that may be learnt from, in the order of a hash of the id.

    An id with several labels has the largest one, an id with several texts the least one; null ids have none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max(label).alias(label))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))


def strings(column: pa.Array) -> pa.Array:
    """A string column as one array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, without copying."""
    column = strings(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = 1 << 20):
    """Runs of whole rows of about `limit` bytes: (first row, end row, bytes, offsets from 0).

    A text longer than the limit is a run of its own; nothing is cut.
    """
    data, offsets = byte_view(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which its worker gives the memory that it no longer uses back: workers stay, and wait, for later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return wrapped


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for whose texts `keep` is true."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
