"""Retrieval quality: cases from chunks, and metrics over all cases in one batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X
from ..session import written


def draw(n: Column | int, *parts: Column) -> Column:
    """A number below n (256 at most) that only the parts decide."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.pmod(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), n if isinstance(n, Column) else F.lit(n))


SAME = ("code", "year", "report_type", "doc_type", "chunk_type")


def sampled(chunks: DataFrame, n: int, seed: int = 42, most_terms: int = 2, questions: Sequence[str] = rules.CASE_QUESTIONS, labels: dict[str, str] = rules.STATEMENT_LABELS, tries: int = 20, id_col: str = "chunk_id", body: Sequence[str] = ("raw_text", "text", "embed_text")) -> DataFrame:
    """n cases (attempt and the columns of a case file) from metric-bearing chunks, at most `tries` attempts a case.

    Chunks are shuffled by hash and taken in turn, over and over; an attempt draws some of the chunk's terms and a form
    of question. An attempt without a term, or with an earlier one's question and positives, gives no case. Positives
    are the chunks with the same SAME columns, and statement if the chunk has one, in which a term is found."""
    attempts = n * tries
    shuffled = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    # At most `attempts` rows are numbered; of fewer rows each is tried again every `total` attempts.
    first = chunks.select(id_col, "company", "section", "statement_type", "metric_terms", *SAME).withColumn("__order", shuffled).orderBy("__order", id_col).limit(attempts + 1)
    seeds = written(first.withColumn("__at", F.row_number().over(W.orderBy("__order", id_col)) - 1), "case-seeds")
    total = max(1, seeds.count())
    turns = F.sequence(F.when(F.col("__at") == 0, F.lit(total)).otherwise(F.col("__at")).cast("long"), F.lit(attempts).cast("long"), F.lit(total).cast("long"))
    tried = seeds.where(F.when(F.col("__at") == 0, F.lit(total)).otherwise(F.col("__at")) <= attempts).withColumn("attempt", F.explode(turns))
    names = F.filter(F.split("metric_terms", r"\s+"), lambda t: (t != "") & ~t.isin(*labels.values()))
    by_hash = F.array_sort(F.transform(names, lambda t: F.struct(F.md5(F.concat_ws("|", t, F.col("attempt").cast("string"), F.lit(str(seed)))).alias("h"), t.alias("t"))))
    rows = tried.withColumn("__names", F.transform(by_hash, lambda x: x["t"])).where(F.size("__names") > 0)
    some = draw(F.least(F.lit(most_terms), F.size("__names")), F.col(id_col), F.col("attempt"), F.lit("n")) + 1
    rows = rows.withColumn("terms", F.slice("__names", F.lit(1), some))
    form = F.element_at(F.array(*map(F.lit, questions)), draw(len(questions), F.col(id_col), F.col("attempt"), F.lit("q")) + 1)
    section = X.first_of(F.coalesce("section", F.lit("")), F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col("statement_type")), F.lit("")))
    for hole, value in {"company": X.first_of(F.coalesce("company", F.lit("")), F.col("code").cast("string")), "year": F.col("year").cast("string"), "report_type": F.col("report_type"), "section": section, "terms": F.array_join("terms", "、")}.items():
        form = F.replace(form, F.lit("{" + hole + "}"), value)
    made = written(rows.select("attempt", F.col(id_col).alias("seed_context"), *SAME, F.coalesce("statement_type", F.lit("")).alias("statement_type"), F.coalesce("section", F.lit("")).alias("section"), "terms", form.alias("question")), "case-attempts")
    there = [F.col(c) for c in body if c in chunks.columns]
    held = chunks.select(*SAME, F.coalesce("statement_type", F.lit("")).alias("__s"), F.col(id_col).alias("__id"), F.lower(F.coalesce("metric_terms", F.lit(""))).alias("__m"), F.lower(F.coalesce(*there, F.lit(""))).alias("__b"))
    met = made.join(held, list(SAME)).where("statement_type = '' or statement_type = __s")
    hit = F.exists("terms", lambda t: F.contains("__m", F.lower(t)) | F.contains("__b", F.lower(t)))
    found = met.where(hit).groupBy("attempt").agg(F.array_sort(F.collect_list("__id")).alias("__found"))
    cases_ = made.join(found, "attempt", "left").withColumn("__found", F.coalesce("__found", F.array().cast(found.schema["__found"].dataType)))
    seeded = F.when(F.array_contains("__found", F.col("seed_context")), F.col("__found")).otherwise(F.concat(F.array("seed_context"), "__found"))
    once = cases_.withColumn("positive_contexts", seeded).withColumn("__n", F.row_number().over(W.partitionBy("question", "positive_contexts").orderBy("attempt"))).where("__n = 1")
    filters = F.struct(*(F.col(c) for c in SAME), F.nullif("statement_type", F.lit("")).alias("statement_type"))
    return once.orderBy("attempt").limit(n).select("attempt", "question", F.lit("").alias("gold_answer"), "positive_contexts", "seed_context", filters.alias("metadata_filter"), F.col("section").alias("expected_section"), F.col("statement_type").alias("expected_statement_type"), F.col("terms").alias("metric_terms"))


def containing(rows: DataFrame, passages: DataFrame, id_col: str, text_col: str, passage_id: str, passage: str, token: str = r"([\p{L}\p{N}]+)") -> DataFrame:
    """passage_id, id_col: the rows whose text contains a passage, each pair once.

    A row with the passage has each of its tokens but the first and last one, which may be parts of longer tokens. So
    rows and passages meet by the rarest such token, and only these pairs are compared in full. Passages of fewer than
    three tokens have no such token: they are compared with each row."""
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(token), 1)
    asked = passages.where(F.col(passage).isNotNull()).select(F.col(passage_id).alias("__p"), F.col(passage).alias("__passage"), tokens(passage).alias("__ts"))
    inner = asked.where(F.size("__ts") > 2).select("__p", F.explode(F.array_distinct(F.slice("__ts", F.lit(2), F.size("__ts") - 2))).alias("__t"))
    each = rows.select(F.col(id_col), F.explode(F.array_distinct(tokens(text_col))).alias("__t"))
    held = written(each.join(inner.select("__t").distinct(), "__t"), "passage-tokens")
    # A token that no row has is the rarest: its passage is nowhere.
    counts = inner.join(held.groupBy("__t").agg(F.count("*").alias("__n")), "__t", "left")
    rarest = counts.groupBy("__p").agg(F.min_by("__t", F.struct(F.coalesce("__n", F.lit(0)), "__t")).alias("__t"))
    met = held.join(rarest, "__t").join(asked.select("__p", "__passage"), "__p").join(rows.select(F.col(id_col), F.col(text_col).alias("__text")), id_col)
    short = rows.select(F.col(id_col), F.col(text_col).alias("__text")).join(asked.where(F.size("__ts") <= 2).select("__p", "__passage"), F.contains("__text", F.col("__passage")))
    both = met.where(F.contains("__text", F.col("__passage"))).select("__p", id_col).unionByName(short.select("__p", id_col))
    return both.distinct().withColumnRenamed("__p", passage_id)


def graded(cases_: DataFrame, hits: DataFrame, case: str = "case_id", hit: str = "id", rank: str = "rank") -> DataFrame:
    """case_id, first_rank (of a positive, null if none), n_found, n_positives. Positives may be an array of each case."""
    return graded_rows(cases_.select(case), cases_.select(case, F.explode("positives").alias(hit)), hits, case, hit, rank).withColumn("n_positives", F.col("n_positives").cast("int"))


def graded_rows(cases_: DataFrame, positives: DataFrame, hits: DataFrame, case: str = "case_id", hit: str = "id", rank: str = "rank") -> DataFrame:
    """The same with positives as rows (case, hit): a case may have any number."""
    want = positives.select(case, hit).distinct()
    found = hits.select(case, hit, rank).join(want, [case, hit]).groupBy(case).agg(F.min(rank).alias("first_rank"), F.count("*").alias("n_found"))
    held = want.groupBy(case).agg(F.count("*").alias("n_positives"))
    none = F.lit(0).cast("long")
    return cases_.select(case).join(held, case, "left").join(found, case, "left").select(case, "first_rank", F.coalesce("n_found", none).alias("n_found"), F.coalesce("n_positives", none).alias("n_positives"))


def summary(grades: DataFrame, k: int) -> DataFrame:
    """One row: n_cases, hit_at_1, hit_at_k, mrr."""
    r = F.col("first_rank")
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return grades.agg(F.count("*").alias("n_cases"), share(r == 1).alias("hit_at_1"), share(r <= k).alias("hit_at_k"), F.coalesce(F.avg(F.when(r <= k, 1.0 / r).otherwise(0.0)), F.lit(0.0)).alias("mrr"))


def expectation_rate(top: DataFrame, expected: str, got: str) -> DataFrame:
    """Share of the cases with an expectation whose first hit meets it; 0 without any."""
    has = F.coalesce(X.blank_to_null(expected), F.lit("")) != ""
    return top.agg(F.coalesce(F.avg(F.when(has, (F.col(expected) == F.col(got)).cast("double"))), F.lit(0.0)).alias("rate"))
