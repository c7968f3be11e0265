"""The rows that pass between the steps of answering: search arguments, plans, documents, evidence, merged state and
counts. All are expressions or joins over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.search import FILTERS

#: The fields of a document's metadata that come from its chunk, text ones and whole numbers.
TEXT_FIELDS = ("code", "company", "industry", "report_type", "doc_type", "chunk_type", "section", "statement_type", "metric_terms")
WHOLE_FIELDS = ("year", "page_start", "page_end")


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")


def document(candidates: DataFrame, label: str = "Milvus") -> DataFrame:
    """question_id, content, metadata of candidates: text fields null as '', numbers null as 0, scores to four places."""
    of = lambda c: _text(candidates, c)
    whole = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in candidates.columns else F.lit(0)
    score = lambda c: F.bround(F.col(c), 4)
    fields = [
        X.first_of(of("source_pdf"), of("source_url"), F.lit(label)).alias("source"),
        of("source_url").alias("url"),
        F.lit(f"{label} Hybrid").alias("retrieval_source"),
        F.col("id").cast("string").alias("chunk_id"),
        *(of(c).alias(c) for c in TEXT_FIELDS),
        *(whole(c).alias(c) for c in WHOLE_FIELDS),
        score("dense").alias("dense_score"),
        score("sparse").alias("sparse_score"),
        score("final").alias("hybrid_score"),
    ]
    return candidates.select("question_id", X.first_of(of("display_text"), of("text")).alias("content"), F.struct(*fields).alias("metadata"))


def evidence(documents: DataFrame, source_type: str, source_name: str, default_score: float = 0.0, metadata: str = "metadata") -> DataFrame:
    """Documents as evidence: citation, date and the scores they have, `default_score` as the final one if they have none."""
    have = documents.schema[metadata].dataType.fieldNames()
    field = lambda c: F.coalesce(F.col(f"{metadata}.{c}").cast("string"), F.lit("")) if c in have else F.lit("")
    held = [F.struct(F.lit(k).alias("key"), F.col(f"{metadata}.{k}_score").cast("double").alias("value")) for k in ("dense", "sparse", "hybrid") if f"{k}_score" in have]
    none = F.array().cast("array<struct<key: string, value: double>>")
    scores = F.filter(F.array(*held), lambda s: s["value"].isNotNull()) if held else none
    final = F.array(F.struct(F.lit("final").alias("key"), F.lit(float(default_score)).alias("value"))) if default_score else none
    return documents.withColumns(
        {
            "source_type": F.lit(source_type),
            "source_name": F.lit(source_name),
            "scores": F.map_from_entries(F.when(F.size(scores) > 0, scores).otherwise(final)),
            "as_of_date": X.first_of(field("timestamp"), field("updated_at"), field("created_at")),
            "citation": X.first_of(field("source"), field("url"), F.lit(source_name)),
        }
    )


def enriched(rows: DataFrame, state: dict[str, str], official: Column, now: Column) -> DataFrame:
    """Evidence with what it lacks. A column that is there keeps its value, '' too; a null is a lack. Company, code and
    symbol come from the question's state otherwise."""
    of = lambda c: F.nullif(_text(rows, c), F.lit(""))
    lack = lambda c, v: F.coalesce(F.col(c), v) if c in rows.columns else v
    asked = lambda c: F.lit(state.get(c, ""))
    return rows.withColumns(
        {
            "retrieved_at": lack("retrieved_at", now),
            "source_url": lack("source_url", F.coalesce(of("url"), F.lit(""))),
            "company": lack("company", asked("company")),
            "code": lack("code", asked("code")),
            "symbol": lack("symbol", F.coalesce(of("code"), asked("symbol"))),
            "statement_type": lack("statement_type", F.lit("")),
            "authority_score": lack("authority_score", F.when(official, 1.0).otherwise(0.7)),
            "freshness_score": lack("freshness_score", F.lit(0.5)),
        }
    )


def overridden(cases: DataFrame, filters: str = "metadata_filter", columns: Sequence[str] = FILTERS) -> DataFrame:
    """A case's search arguments: all of `columns`, from its filter (a map) or none; what the caller had set is not kept."""
    return cases.withColumns({c: F.coalesce(F.try_element_at(filters, F.lit(c)), F.lit("") if c == "statement_type" else F.lit(None).cast("string")) for c in columns})


def per_case(search, cases: DataFrame, most: int = 200) -> DataFrame:
    """`search(cases, filters)` for the cases of each filter (columns FILTERS), which reach the scans as constants.

    The distinct filters of a set of cases are few: over `most` is an error, not a sample."""
    groups = cases.select(*FILTERS).distinct().limit(most + 1).collect()
    if len(groups) > most:
        raise ValueError(f"over {most} different filters: group the cases")
    out = None
    for g in groups:
        own = cases.where(reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(g[c])) for c in FILTERS)))
        found = search(own, {c: g[c] for c in FILTERS if g[c]})
        out = found if out is None else out.unionByName(found)
    return out


def arguments(needs: DataFrame) -> DataFrame:
    """Adds `args` to needs (question, query, entity_name, display_name, company, symbol, code, cn_code, need_type, fields)."""
    of = lambda *c: X.first_of(*(_text(needs, x) for x in c), F.lit(""))
    args = F.struct(of("display_name", "company", "entity_name").alias("company"), F.upper(of("symbol")).alias("symbol"), of("code", "cn_code").alias("code"), of("query", "question").alias("question"), of("need_type").alias("need_type"), (F.coalesce("fields", F.array().cast("array<string>")) if "fields" in needs.columns else F.array().cast("array<string>")).alias("fields"))
    return needs.withColumn("args", args)


def planner_arguments(analyzed: DataFrame) -> DataFrame:
    """question_id and what a planner gets of an analysed question: the entity's value, else the question's."""
    of = lambda *c: X.first_of(*(_text(analyzed, x) for x in c), F.lit(""))
    listed = lambda a, b: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.col(a)).otherwise(F.coalesce(b, F.array().cast("array<string>")))
    lists = [listed(f"entity_{c}", c).alias(c) for c in ("codes", "symbols", "market_metrics") if {f"entity_{c}", c} <= set(analyzed.columns)]
    return analyzed.select("question_id", of("active_question", "question").alias("query"), *(of(f"entity_{c}", c).alias(c) for c in ("code", "symbol", "company", "year", "period")), *lists)


def planned(questions: DataFrame, items: DataFrame) -> DataFrame:
    """A plan for each question (question_id, intent, metrics, entities, requires_freshness, n_sub_questions) from its
    items (question_id, nth, source): primary and secondary sources, what must be answered, and what comes next."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "source"))), lambda x: x["source"])
    by = items.groupBy("question_id").agg(ordered.alias("sources"))
    rows = questions.join(by, "question_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    chat = F.size("sources") == 0
    primary = F.when(chat, "direct_chat").otherwise(F.get("sources", F.lit(0)))
    rows = rows.withColumn("primary_source", primary)
    direct, asked = F.col("primary_source") == "direct_chat", F.size("metrics") > 0
    include = F.when(asked, F.array(*map(F.lit, ("period", "unit", "source")))).when(~direct, F.array(F.lit("source"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "question_id",
        "primary_source",
        F.when(chat, F.col("sources")).otherwise(F.array_distinct(F.slice("sources", F.lit(2), F.greatest(F.size("sources") - 1, F.lit(0))))).alias("secondary_sources"),
        F.col("metrics").alias("must_answer"),
        F.col("entities").alias("required_entities"),
        include.alias("must_include"),
        (~direct).alias("citation_required"),
        F.coalesce("requires_freshness", F.lit(False)).alias("freshness_required"),
        asked.alias("numeric_check_required"),
        (F.col("intent").isin("summary", "reasoning", "compare") | (F.col("n_sub_questions") > 1)).alias("needs_query_expansion"),
        (F.size("sources") > 1).alias("needs_multi_source"),
        F.when(direct, "generate").otherwise("retrieval_orchestrator").alias("next_action"),
    )


def staged(items: DataFrame, requirements: DataFrame, disabled: bool = False, source: str = "milvus") -> DataFrame:
    """The items that go through document-first retrieval: of that source, where the question needs documents or filings."""
    need = F.coalesce("needs_document_evidence", F.lit(False)) | F.coalesce("needs_filing_evidence", F.lit(False))
    return items.where((F.col("source") == source) & F.lit(not disabled)).join(requirements.where(need).select("question_id").distinct(), "question_id", "left_semi")


def accumulated(existing: DataFrame, returned: DataFrame, keys: Sequence[str] = ("question_id",), nth: str = "nth", value: str = "value") -> DataFrame:
    """keys, nth, value: what was returned if it begins with all that exists, else what exists and then what was returned."""
    both = returned.select(*keys, nth, F.col(value).alias("__r")).join(existing.select(*keys, nth, F.col(value).alias("__e"), F.lit(1).alias("__has")), [*keys, nth], "full_outer")
    differs = both.where("__has = 1").groupBy(*keys).agg(F.max((~F.col("__r").eqNullSafe(F.col("__e"))).cast("int")).alias("differs"), F.count("*").alias("n"))
    rows = returned.join(differs, list(keys), "left").withColumn("differs", F.coalesce("differs", F.lit(0)))
    moved = rows.select(*keys, (F.col(nth) + F.when(F.col("differs") == 1, F.col("n")).otherwise(0)).cast("long").alias(nth), value)
    kept = existing.join(differs.where("differs = 1").select(*keys), list(keys), "left_semi").select(*keys, F.col(nth).cast("long").alias(nth), value)
    return kept.unionByName(moved)


def merged(base: DataFrame, update: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the columns that update has, where update has the row: the right one wins, nulls too."""
    names = [c for c in update.columns if c not in keys]
    right = update.select(*keys, *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__there"))
    both = base.join(right, list(keys), "left")
    return both.withColumns({c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) if c in base.columns else F.col(f"__{c}") for c in names}).drop("__there", *(f"__{c}" for c in names))


def top_score(steps: DataFrame, score: str = "score", keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """keys, retrieval_score: the largest score of all steps, 0 without any."""
    return steps.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(score), F.lit(0.0)), F.lit(0.0)).alias("retrieval_score"))


def outcomes(rows: DataFrame, status: Column) -> DataFrame:
    """One row: inserted, skipped and failed, of rows with that status."""
    return rows.agg(*(F.count_if(status == s).alias(s) for s in ("inserted", "skipped", "failed")))


def step_summary(rows: DataFrame, step: str = "step") -> DataFrame:
    """step, n_tools, n_evidence, n_facts for rows (step, kind): what each step brought."""
    return rows.groupBy(step).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}s" if k != "evidence" else "n_evidence") for k in ("tool", "evidence", "fact")))


def page_lengths(pages: DataFrame, key: str = "source_id", text: str = "text") -> DataFrame:
    """key, n_chars: the length of all pages together."""
    return pages.groupBy(key).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))


def work_list(rows: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """rows in an order, the first `limit` of them if one is given; 0 is none."""
    out = rows.orderBy(*order)
    return out.limit(limit) if limit else out


def hinted_tools(tools: DataFrame, text: Column, hints: dict[str, Sequence[str]], name: str = "tool") -> DataFrame:
    """tools with hint_score and rank: the lengths of a tool's hints that the text has, largest first, then names falling."""
    score = F.lit(0)
    for tool, words in hints.items():
        for w in words:
            score = score + F.when((F.col(name) == tool) & F.contains(F.lower(text), F.lit(w.lower())), len(w)).otherwise(0)
    scored = tools.withColumn("hint_score", score)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("hint_score").desc(), F.col(name).desc())))  # a list of tools
