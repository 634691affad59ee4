"""Intermediate tables in the folder that driver and executors share, so that long plans are cut and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in tests on one machine, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="factloom-")
    return (found or _own["dir"]).rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet, in the closer of its codecs, as some tables hold all texts, and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return apart(df.sparkSession.read.schema(df.schema).parquet(path))


#: Tables of files with more rows are not broadcast.
LARGE = 50_000


def apart(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``df``, read from files, with the hint to join it by sorting if it (or ``rows``, the table of files that it has the rows of) is large. Spark goes
    by the compressed size of files and would collect a million short rows on the driver; rows are counted from the files' footers."""
    return df.hint("merge") if (df if rows is None else rows).count() > LARGE else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, four lots to each. Short rows that become long texts, and texts that take long to read, would else be as few
    partitions as their bytes are, often one."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def spread(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within read their files in four lots to each core, as far as files and their row groups allow: what ``dealt`` does, without a shuffle
    of the rows, for tables whose files are many."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
