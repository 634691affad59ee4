"""What the operators share: tables in the shared folder, bounded Arrow batches, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, whatever the Arrow batches hold.
SLICE_BYTES = 8 << 20
#: A side is broadcast only when its rows were counted and are at most this many (of a few longs each).
BROADCAST_ROWS = 1_000_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_saved: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not _own:
        _own.append(tempfile.mkdtemp(prefix="factloom-"))
    return (found or _own[0]).rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing.

    Nothing reads the write's shuffles again, so Spark deletes their files when the write has ended (a setting of this write
    only), not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _saved.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    return saved(df, name)[0]


def release(spark: SparkSession, path: str) -> None:
    """Delete a table that ``saved`` wrote, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _saved[:] = [x for x in _saved if x[1] != path]


@atexit.register
def _release_all() -> None:
    for spark, path in list(_saved):
        try:
            release(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000) -> DataFrame:
    """Only the two columns, under fixed names, whatever else the table holds; a null text is the empty text.

    Also lowers the rows of an Arrow batch where the session has Spark's default, so that long texts
    stay within a Python worker's memory.
    """
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes of ``column`` at most; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(n):
        if held and held + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    yield batch.slice(start, n - start)


def flat(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                out = f(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small`` (a saved table) broadcast if its counted rows are within ``limit``, else by a shuffle."""
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)
