"""Intermediate tables in the folder that all executors share, and maps over small Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that are handled at once: texts may be long. (Spark bounds what travels at once by bytes.)
BATCH_ROWS = 512
_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local: dict[str, str] = {}  # by application: the folder of a local session without a setting


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the setting is absent, a temporary one on a local master, else an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _local[context.applicationId]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows, without a change to the session's settings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(lo, BATCH_ROWS) for batch in batches for lo in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def least_hashed(df: DataFrame, hashed: str, n: int, total: int) -> DataFrame:
    """At most ``n`` rows, those of least ``hashed`` (a 64-bit hash). Only about twice as many rows are sorted.

    Of ``total`` rows, those below a bound that about 2 n are expected under are kept first, so each task gives the
    driver its share of these, not up to n rows.
    """
    share = 1.0 if total <= 2 * n else 2.0 * n / total
    bound = int(-(2**63) + share * (2**64 - 1))
    few = df if share == 1.0 else df.where(F.col(hashed) < bound)
    return few.orderBy(hashed).limit(n)


def unused(name: str, columns: list[str]) -> str:
    """A column name that isn't among ``columns`` (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, and no executor owns the rows.

    The table is removed by ``discard`` or when the driver ends. While it is written, as few rows travel to Python at once
    as are handled at once there; the session's own setting holds again afterwards.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_AT_ONCE, None)
    spark.conf.set(_AT_ONCE, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_AT_ONCE)
        else:
            spark.conf.set(_AT_ONCE, before)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._millrace_path = path
    return back


def resting_on(df: DataFrame, *saved: DataFrame) -> DataFrame:
    """``df``, marked as a plan that reads tables of ``save``: ``discard(df)`` removes them."""
    df._millrace_reads = saved
    return df


def discard(*done: DataFrame) -> None:
    """Removes tables that ``save`` gave, and those that marked plans read, once all that reads them has run."""
    for df in done:
        path = getattr(df, "_millrace_path", None)
        if path:
            _remove(df.sparkSession, path)
        discard(*getattr(df, "_millrace_reads", ()))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that have run: it does so only once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before
        pass
