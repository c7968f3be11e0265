"""What the corpus operators share: scratch tables, word rules and folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which executors and driver share.

    Where neither that setting nor setCheckpointDir names one, a local session (tests) gets a temporary folder of
    this process; on a cluster that folder would be each machine's own, so there it's an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the folder of a table from `stored` that no table still to be read comes from."""
    spark = df.sparkSession
    folder = df.inputFiles()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Asks for the shuffles of results that were read to the end, and that nothing refers to, to be deleted now."""
    spark.sparkContext._jvm.System.gc()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def give_back() -> None:
    """Returns unused memory of Arrow and the C library to the system: a worker that ended a batch keeps it else, beside
    its executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, which gives memory back when its task ends: workers are kept for later stages."""
    @wraps(run)
    def ran(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ran


def ascii_lowered(text: Column) -> Column:
    """Lower-cases A-Z alone; texts in ASCII take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`."""
    return F.crc32(key.cast("string").cast("binary")) % of


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_hash(key: Column) -> Column:
    """Hexadecimal MD5 of an id: a shuffled order that any SQL engine can repeat."""
    return F.md5(key.cast("string").cast("binary"))
