"""Tables read once per query, written to the shared folder and read again."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.session import scratch_path, ship_package


#: Rows that Spark hands to a Python worker at a time. Spark's default (10,000) holds
#: tens of MB of long texts in the JVM and as much again in each worker.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Before a query: the Python workers get this package, and the session's Arrow
    batch size is lowered to BATCH_ROWS if it is larger."""
    ship_package(spark)
    if int(spark.conf.get(_BATCH_KEY, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor re-reads the files. Parquet takes a
    fraction of the space of a row checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a :func:`staged` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/notewise-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(taken, wanted: str) -> str:
    """``wanted``, with underscores put before it until it clashes with none of ``taken``."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


@functools.lru_cache(maxsize=1)
def _trim():
    """The C library's call that hands free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def freed(run):
    """``run`` (a function over batches) that gives its memory back when its task ends.

    Spark reuses its Python workers; what a task has freed would otherwise stay with its worker through all
    later stages, several workers an executor."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if _trim() is not None:
                _trim()(0)
    return wrapped
