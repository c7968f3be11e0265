"""A training corpus from `documents`: five stages, each a table of the columns of documents but for the last.

quality     rows that the quality classifier (9) scores below its threshold go
lines       lines that are repeated across documents go (2); texts are rewritten
neardup     one document of each group of near duplicates stays (5)
mix         sources are mixed to their target weights (7): a document is repeated or cut as its share says
pack        documents are cut into pieces of 2048-token sequences (4)

Every stage works on all rows of the one before. Nulls, empty and repeated rows are treated as the operators'
modules state. A document of which the mix takes two passes is two rows or more: one for each run of its words that a
pass takes, in the order of the schedule. Runs that aren't whole documents have their words joined by single spaces.
Columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common, lines, mixing, neardup, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fold, on the documents as they are in the stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(common.fold(F.col("doc_id"), quality.HOLD_OF) != quality.HOLD)
    model = quality.learn(docs.select("doc_id", "text"), labels)
    return quality.score(docs.select(*COLUMNS), model, as_col="__score").where(F.col("__score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


NO_ID = -(2**63)


def _key(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c), F.lit(NO_ID)).alias("__key")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows that repeat an id and text one stays. Texts move once,
    by their ids: the repeats are found where the join has put them."""
    kept = neardup.near_duplicates(docs).where("kept").select(_key()).distinct()
    rows = docs.select(*COLUMNS, _key(), F.xxhash64("text").alias("__text")).join(kept, "__key", "left_semi")
    before = F.lag("__text").over(Window.partitionBy("__key").orderBy("__text"))
    return rows.withColumn("__before", before).where("__before is null or __before != __text").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each run of words that the mix takes of a document in one pass, in the order of the schedule. Rows that
    share an id are told apart by their texts' hashes, and those that share both by a number."""
    tagged = docs.select(*COLUMNS, _key(), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__text"))
    same = Window.partitionBy("__key", "__text")
    rows = tagged.withColumn("__nth", F.row_number().over(same.orderBy("source", "lang", "n_chars")))
    parts = mixing.mix(tagged, tag_col="__text").select(_key(), F.col("tag").alias("__text"), "size", "spans")
    parts = parts.withColumn("__part", F.row_number().over(same.orderBy("spans")))
    # Both sides lie by key and text already; equal numbers are asked for in a form that doesn't deal them anew.
    both = rows.join(parts, ["__key", "__text"]).where("__nth >= __part and __nth <= __part")
    end = lambda x: x["at"] + x["n"]
    joins = lambda x, y: F.coalesce((x["epoch"] == y["epoch"]) & (end(x) == y["at"]), F.lit(False))
    begins = F.filter("spans", lambda x, i: (i == 0) | ~joins(F.get("spans", i - 1), x))
    ends = F.filter("spans", lambda x, i: ~joins(x, F.get("spans", i + 1)))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a["at"].alias("at"), (end(b) - a["at"]).alias("n"), a["slot"].alias("slot")))
    # Words are split once a document: the column is asked for twice, so that no step inside the transform does it.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = both.withColumn("__words", words).withColumn("__runs", runs)
    cut = F.transform("__runs", lambda r: F.struct(F.when(r["n"] >= F.size("__words"), F.col("text")).otherwise(F.array_join(F.slice("__words", (r["at"] + 1).cast("int"), r["n"].cast("int")), " ")).alias("text"), r["slot"].alias("slot")))
    taken = held.withColumn("__cut", F.explode(cut)).withColumn("text", F.col("__cut.text"))
    return taken.withColumn("n_chars", F.length("text").cast("long")).orderBy("__cut.slot", "doc_id").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("neardup", keep_one_of_each), ("mix", mix_sources), ("pack", pack_windows)]
#: The first stage fits a network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
