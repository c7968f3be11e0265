"""Document-first retrieval: recall documents, then chunks of those documents for each sub-question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..config import MultistageConfig, SearchConfig
from ..functions import text as X
from ..session import written
from . import search


def like(c: Column | str, part: str) -> Column:
    """SQL LIKE %part% in any case; the part's own % and _ are plain characters."""
    safe = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return X.col(c).ilike(f"%{safe}%")


def question_filter(chunks: DataFrame, code: str = "", company: str = "", year: int = 0, period: str = "") -> DataFrame:
    """Chunks with a document, narrowed by what the question names: the code, else part of the company's name."""
    out = chunks.where(F.col("source_pdf").isNotNull() & (F.col("source_pdf") != ""))
    out = out.where(F.col("code") == code) if code else out.where(like("company", company)) if company else out
    out = out.where(F.col("year") == year) if year else out
    return out.where(F.col("report_type") == period) if period else out


def documents(chunks: DataFrame, columns: list[str], source: str = "source_pdf", authority: str = "source_authority_score") -> DataFrame:
    """One row a document: the largest value of each column, chunk_count and authority."""
    return chunks.groupBy(source).agg(*(F.max(c).alias(c) for c in columns), F.count("*").alias("chunk_count"), F.max(authority).alias("authority"))


def relaxed(found: DataFrame, otherwise: DataFrame) -> DataFrame:
    """`found`, or all of `otherwise` where `found` has no rows. One plan: nothing is collected in between."""
    none = found.agg(F.count("*").alias("__n")).where("__n = 0").select(F.lit(True).alias("__none"))
    return found.unionByName(otherwise.join(F.broadcast(none)).drop("__none"))


def top_documents(docs: DataFrame, limit: int = 8, tie: str = "source_pdf") -> DataFrame:
    """The best documents by authority, date and size, with rank and score = authority + 1 / rank."""
    best = docs.orderBy(F.col("authority").desc(), F.col("publish_date").desc(), F.col("chunk_count").desc(), F.col(tie)).limit(limit)
    w = W.orderBy(F.col("authority").desc(), F.col("publish_date").desc(), F.col("chunk_count").desc(), F.col(tie))  # over `limit` rows
    return best.withColumn("rank", F.row_number().over(w)).withColumn("score", F.coalesce(F.nullif("authority", F.lit(0.0)), F.lit(1.0)) + 1.0 / F.col("rank"))


def recall(chunks: DataFrame, columns: list[str], limit: int = 8, **named) -> DataFrame:
    """Documents for a question's filters, or for none if no document meets them."""
    found = documents(question_filter(chunks, **named), columns)
    every = documents(question_filter(chunks), columns)
    return top_documents(relaxed(found, every) if any(named.values()) else every, limit)


def recall_each(chunks: DataFrame, asked: DataFrame, columns: list[str], limit: int = 8) -> DataFrame:
    """`recall` for each of many questions (question_id, code, company, year, period; blank and 0 mean none): question_id,
    source_pdf, columns, chunk_count, authority, rank, score. A question whose filters leave no document gets the best of all.

    Chunks are counted by document and filter values first, so that questions meet a row for each of those: by code
    where one is named, the others, a stated set, by what is in the company's name."""
    lacking = {"code": "string", "company": "string", "year": "int", "report_type": "string"}
    named = question_filter(chunks).withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in chunks.columns})
    keys = ["source_pdf", "code", "company", "year", "report_type"]
    held = written(named.groupBy(*keys).agg(*(F.max(c).alias(f"__{c}") for c in columns), F.count("*").alias("__n"), F.max("source_authority_score").alias("__a")), "recall")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    q = asked.select("question_id", value("code").alias("q_code"), value("company").alias("q_company"), F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("q_year"), value("period").alias("q_period"))
    any_ = (F.col("q_code") != "") | (F.col("q_company") != "") | (F.col("q_year") != 0) | (F.col("q_period") != "")
    rest = ((F.col("q_year") == 0) | (F.col("year") == F.col("q_year"))) & ((F.col("q_period") == "") | (F.col("report_type") == F.col("q_period")))
    by_code = held.join(q.where("q_code <> ''"), F.col("code").cast("string") == F.col("q_code")).where(rest)
    by_name = held.join(q.where(any_ & (F.col("q_code") == "")), F.contains(F.lower("company"), F.lower("q_company")) & rest)
    both = by_code.unionByName(by_name).groupBy("question_id", "source_pdf")
    merge = (*(F.max(f"__{c}").alias(c) for c in columns), F.sum("__n").alias("chunk_count"), F.max("__a").alias("authority"))
    order = [F.col("authority").desc(), F.col("publish_date").desc(), F.col("chunk_count").desc(), F.col("source_pdf")]
    found = written(both.agg(*merge).withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= limit), "recall")
    every = held.groupBy("source_pdf").agg(*merge).orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    none = q.select("question_id").join(found.select("question_id").distinct(), "question_id", "left_anti")
    out = found.unionByName(every.join(F.broadcast(none)))  # `limit` rows for each question that is left
    return out.withColumn("score", F.coalesce(F.nullif("authority", F.lit(0.0)), F.lit(1.0)) + 1.0 / F.col("rank"))


def focus_filter(df: DataFrame, columns: list[str], focus: str = "focus") -> DataFrame:
    """Rows of which a column has the row's focus in any case; blank, main and comparison let all pass."""
    hit = None
    for c in columns:
        one = F.lower(F.coalesce(F.col(c), F.lit(""))).contains(F.lower(focus))
        hit = one if hit is None else hit | one
    return df.where(F.col(focus).isin("", "main", "comparison") | F.col(focus).isNull() | hit)


def prior(focus: Column, statement: Column, body: Column, income_metrics: list[str]) -> Column:
    """What a chunk gets for its kind: the income statement for its metrics, or the focus near its start."""
    return F.when(focus.isin(*income_metrics) & (statement == "income_statement"), 0.35).when((focus != "") & F.contains(F.substring(body, 1, 1000), focus), 0.3).otherwise(0.0)


def multistage(chunks: DataFrame, docs: DataFrame, subs: DataFrame, config: MultistageConfig = MultistageConfig(), search_config: SearchConfig = SearchConfig(), statement: Callable[[], Column] | None = None) -> DataFrame:
    """question_id, chunk_id, source_pdf, score, rank for sub-questions (question_id, question, focus).

    Recalled documents are a few, or a few of each question (with a question_id). BM25 numbers are those of the whole
    corpus. A sub-question without a match takes chunks that have its focus, in the order of their ids."""
    each = ["question_id"] if "question_id" in docs.columns else []
    inside = chunks.join(docs.select(*each, "source_pdf", F.col("score").alias("doc_score")), "source_pdf")
    asked = subs.withColumn("terms", X.search_terms(X.first_of("question", "focus")))
    most = max(config.chunks_a_question * 4, 20)
    body = [c for c in ("metric_terms", "display_text", "text") if c in chunks.columns]
    columns = ["chunk_id", "source_pdf", "doc_score", *body, *(["statement_type"] if "statement_type" in chunks.columns else [])]
    hits = search.bm25(chunks, asked, config=search_config).join(inside.select(*each, F.col("chunk_id").alias("id"), *columns[1:]), ["id", *each]).join(F.broadcast(subs.select("question_id", "focus")), "question_id")
    hits = search.ranked(focus_filter(hits, body), "bm25", "place", most)
    missed = subs.join(hits.select("question_id").distinct(), "question_id", "left_anti").where(F.coalesce("focus", F.lit("")) != "")
    asked_for = F.broadcast(missed.select("question_id", "focus"))
    spare = inside.select(*each, F.col("chunk_id").alias("id"), *columns[1:])
    spare = spare.join(asked_for, "question_id") if each else spare.join(asked_for)
    have = None
    for c in body:
        one = F.lower(F.coalesce(F.col(c), F.lit(""))).contains(F.lower("focus"))
        have = one if have is None else have | one
    spare = search.ranked(spare.where(have).withColumn("bm25", F.lit(0.0)), "bm25", "place", most)
    every = hits.unionByName(spare.select(hits.columns))
    text = X.first_of(*(c for c in ("display_text", "text") if c in body))
    kind = F.coalesce(F.col("statement_type"), F.lit("")) if "statement_type" in columns else F.lit("")
    score = 1.0 / F.col("place") + prior(F.coalesce("focus", F.lit("")), kind, text, list(rules.QUESTION_METRICS)) + 0.1 * F.col("doc_score")
    best = search.ranked(every.withColumn("score", score), "score", "rank", config.chunks_a_question)
    return best.select("question_id", F.col("id").alias("chunk_id"), "source_pdf", "score", "rank")


def keep_first(df: DataFrame, key: Column | str, order: list[Column]) -> DataFrame:
    """The first row of each key in the order; unlike dropDuplicates, the same one always."""
    return df.withColumn("__nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")
