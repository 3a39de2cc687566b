"""Helpers shared by the text and vector operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release_memory() -> None:
    """Hand freed memory back to the system; an idle Python worker otherwise keeps the most that it ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(batches_to_batches):
    """The same function of Arrow batches, which releases the worker's memory when its input ends."""
    @functools.wraps(batches_to_batches)
    def run(batches):
        try:
            yield from batches_to_batches(batches)
        finally:
            release_memory()
    return run


def rest_executors(spark: SparkSession) -> None:
    """A collection on the executors between two stages, which shrinks their heaps and frees their buffers.

    The stages of a pipeline then each start with the memory of a fresh executor, however much the one before held.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def light_files(spark: SparkSession) -> None:
    """Read whole texts a few hundred at a time and write them in row groups of 16 MB.

    Buffers then stay small beside the heap of an executor, whose size otherwise follows its largest arrays.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("parquet.block.size", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python workers at most ``rows`` at a time, so a batch stays a few MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Let Spark drop the shuffle files of each finished write inside the block.

    What the block writes lies in the shared folder, so no later read needs those files.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffle_cleanup(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut an Arrow batch into runs of rows whose ``column`` holds about ``limit`` bytes.

    A single longer value makes a run of its own, so memory follows the longest value only.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) else np.int64,
                            count=n + col.offset + 1)[col.offset:]
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(column))
    return col.fill_null("") if col.null_count else col


#: odd multipliers of a 64-bit finaliser (fixed values)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_B
    return x ^ (x >> np.uint64(33))


def unique_by_id(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """One row per id: repeated rows count once; of several values under an id the smallest stands."""
    return df.groupBy(id_col).agg(F.min(value_col).alias(value_col))


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector that is not null and holds neither nulls nor non-finite components."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
            .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad))
