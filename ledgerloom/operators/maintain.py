"""Keeping tables: upserts, insert-if-absent, deletes and backfills without MERGE, as joins and windows.

Results are new DataFrames; write them to a new path and swap, never over the path that is being read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], version: str, created: str | None = None) -> DataFrame:
    """The newest version of each key, of equal versions the new row; its creation time stays the first one. What is
    still tied is settled by the rows' own values, so that a rerun keeps the same row."""
    every = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*key)
    tie = F.xxhash64(*[c for c in every.columns if c != "__new"])
    out = every.withColumn("__n", F.row_number().over(w.orderBy(F.col(version).desc(), F.col("__new").desc(), tie)))
    out = out.withColumn(created, F.min(created).over(w)) if created else out
    return out.where("__n = 1").drop("__n", "__new")


def absent(new: DataFrame, old: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[str]) -> DataFrame:
    """Rows of `new` that break no unique key, inserted one by one in the order: each meets the old rows and the new ones
    that were inserted before it, not those that were turned away themselves.

    Rows that an old row bars go at once. Then, in rounds, a row that comes first of what is left under all of its keys
    is in, and rows that share a key with one that is in are out. A round settles at least the first row of all; chains
    of rows that bar each other alternately are what takes more than two. No row is lost and none is gathered."""
    names = new.columns
    for key in keys:
        new = new.join(old.select(*key).distinct(), list(key), "left_anti").select(*names)
    if len(keys) == 1:
        return new.withColumn("__n", F.row_number().over(W.partitionBy(*keys[0]).orderBy(*order))).where("__n = 1").drop("__n")
    columns, order = [*new.columns, "__row"], [*order, "__row"]
    left, taken = written(new.withColumn("__row", F.monotonically_increasing_id())), None
    while not left.isEmpty():
        marked = left
        for i, key in enumerate(keys):
            marked = marked.withColumn(f"__n{i}", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
        in_ = reduce(lambda a, b: a & b, (F.col(f"__n{i}") == 1 for i in range(len(keys))))
        marked = written(marked.withColumn("__in", in_))
        fresh = marked.where("__in").select(*columns)
        taken = fresh if taken is None else taken.unionByName(fresh)
        left = marked.where(~F.col("__in")).select(*columns)
        for key in keys:
            left = left.join(fresh.select(*key).distinct(), list(key), "left_anti")
        left = written(left)
    return taken.select(*names) if taken is not None else new


def unindexed(rows: DataFrame, checkpoint: DataFrame, id_col: str, **where: str) -> DataFrame:
    """Rows without a checkpoint of that collection and model."""
    done = checkpoint
    for c, v in where.items():
        done = done.where(F.col(c) == v)
    return rows.join(done.select(id_col), id_col, "left_anti")


def checkpointed(checkpoint: DataFrame, indexed: DataFrame, id_col: str, at: Column, **values: str) -> DataFrame:
    """The checkpoint with further rows; keys are all of its values and the id."""
    new = indexed.select(*(F.lit(v).alias(c) for c, v in values.items()), F.col(id_col), at.alias("indexed_at"))
    return upserted(checkpoint, new, [*values, id_col], "indexed_at")


def without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


def of(rows: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(parents.select(*key).distinct(), list(key), "left_semi")


def backfilled(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Columns computed where they are null or blank; others stay."""
    return rows.withColumns({c: F.when(F.coalesce(X.blank_to_null(c), F.lit("")) == "", v).otherwise(F.col(c)) for c, v in values.items()})


def looked_up(rows: DataFrame, parents: DataFrame, on: Column, values: dict[str, str]) -> DataFrame:
    """Columns set to a parent's, or null without one. A parent's key must be unique."""
    named = parents.select("*", *(F.col(p).alias(f"__{c}") for c, p in values.items()))
    out = rows.join(named.drop(*[c for c in parents.columns if c in rows.columns]), on, "left")
    return out.select(*[F.col(f"__{c}").alias(c) if c in values else rows[c] for c in rows.columns], *[F.col(f"__{c}").alias(c) for c in values if c not in rows.columns])


def evolved(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that are missing, null, in the type that is given."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def quality_report(rows: DataFrame, status: str, needed: Sequence[str], size: str, least: int = 100_000) -> DataFrame:
    """status, n, missing_meta, suspicious: rows by status, those with blank needed columns, and small files."""
    blank = F.lit(False)
    for c in needed:
        blank = blank | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.count_if(blank).alias("missing_meta"), F.count_if(F.coalesce(F.col(size), F.lit(0)) < least).alias("suspicious"))


def coerced(df: DataFrame, text: dict[str, int], whole: Sequence[str] = (), real: dict[str, float] | None = None) -> DataFrame:
    """Text cut to lengths with null as '', numbers with null as 0 or as given."""
    out = {c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n) for c, n in text.items()}
    out |= {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in whole}
    out |= {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in (real or {}).items()}
    return df.withColumns(out)
