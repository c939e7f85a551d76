"""The folder that driver and executors share, and tables written to it.

Intermediate results are cut from their lineage by writing them there as
Parquet, so that a lost executor costs only the tasks that it was running.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own, in local mode only."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="formulary-")
    return _own[app]


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/formulary/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes what this application wrote; results that are not read yet go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more; else they stay until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def released() -> None:
    """Gives memory that was freed back to the system; allocators else keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, but a worker that waits for its next task holds no memory of the last one."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return lean_run


def opened_folder(uri: str, columns: list[str], where: tuple[str, object]) -> Iterator[pa.Table]:
    """Rows of the Parquet files of a shared folder that have a value in a column, read on an executor; none where there is no such folder."""
    import pyarrow.compute as pc
    from pyarrow import fs, parquet

    store, path = fs.FileSystem.from_uri(uri)
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as source:
                yield parquet.read_table(source, columns=columns, filters=pc.field(where[0]) == where[1])


#: Rows that Spark hands to Python at once while a table is written; texts may be long.
ARROW_ROWS = "1000"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read again from a table in the shared folder."""
    spark = df.sparkSession
    path, key = fresh_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, ARROW_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(*columns: str) -> Column:
    """A 64-bit hash by which a row is known where ids repeat or are null."""
    return F.xxhash64(F.lit(1), *columns)


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` but for those whose key is in ``gone`` (key); of rows whose key is in ``repeated`` (key), one stays."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, key)
    join = lambda df, other, kind: df.join(F.broadcast(other) if few(other) else other, df[name].eqNullSafe(other["key"]), kind)
    left = join(keyed, gone, "left_anti")
    if not repeated.isEmpty():
        left = join(left, repeated, "left_anti").unionByName(join(keyed, repeated, "left_semi").dropDuplicates([name]))
    return left.select(docs.columns)


#: Rows of a table of bare 64-bit ids that may be broadcast (16 MB before framing).
BROADCAST_ROWS = 2_000_000


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a written table is small enough to broadcast; counts from Parquet footers."""
    return df.count() <= limit
