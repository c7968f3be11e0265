"""What runs leave behind: event logs, manifests, case files, parsed files, and vectors in batches of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def events(saved: DataFrame, keys: Sequence[str], status: str = "download_status", error: str = "error", at: Column | None = None) -> DataFrame:
    """keys, status, message, created_at: a log row for each row that was saved, new or not; without an error, ''."""
    now = at if at is not None else F.current_timestamp()
    return saved.select(*keys, F.col(status).alias("status"), F.coalesce(F.col(error).cast("string"), F.lit("")).alias("message"), now.alias("created_at"))


def logged(rows: DataFrame, path: str) -> None:
    """Appends to a log. A write that is tried again after a lost executor commits once."""
    rows.write.mode("append").parquet(path)


def manifest(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, nulls kept as such."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def case_file(cases: DataFrame, path: str, order: str = "attempt") -> None:
    """Cases as JSON lines in one file, in their order: a set of cases is bounded by its count."""
    cases.coalesce(1).sortWithinPartitions(order).drop(order).write.mode("overwrite").json(path)


def parsed_once(files: DataFrame, cache: str, parse: Callable[[DataFrame], DataFrame], key: str = "source_id") -> DataFrame:
    """Parsed rows of `files`; those that the cache holds are not parsed again. A file that gives no rows leaves none,
    so it is parsed again next time."""
    spark = files.sparkSession
    known = exists(spark, cache)
    fresh = files.join(spark.read.parquet(cache).select(key).distinct(), key, "left_anti") if known else files
    rows = parse(fresh)
    rows.write.mode("append").parquet(cache)
    return spark.read.schema(rows.schema).parquet(cache).join(files.select(key).distinct(), key, "left_semi")


def column_batches(rows: DataFrame, size: int, send: Callable[[dict[str, list]], None]) -> DataFrame:
    """Sends rows to an external index as columns, `size` rows at a time, where they lie; rows sent for each batch.

    A task that is tried again sends its batches again, so `send` must replace rows by their keys."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                send(part.to_pydict())
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int64())})

    return rows.mapInArrow(run, "n long")
