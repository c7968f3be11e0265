"""The evidence ledger: ranking, deduplication, context within a budget, and the check of an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..config import ContextConfig
from ..functions import classify as C
from ..functions import text as X
from .recall import keep_first


def score(base: Sequence[Column], body: Column, metrics: Sequence[str], statement: Column, official: Column, aliases: dict[str, list[str]] = rules.EVIDENCE_ALIASES) -> Column:
    """The first score that's there and not 0, 0.25 for each metric that terms or text name, 0.05 for a statement and
    0.05 for an official source."""
    out = F.coalesce(*(F.nullif(b, F.lit(0.0)) for b in base), F.lit(0.0))
    for m in metrics:
        out = out + F.when(C.has(body, aliases.get(m, [m])), 0.25).otherwise(0.0)
    return out + F.when(statement != "", 0.05).otherwise(0.0) + F.when(official, 0.05).otherwise(0.0)


def dedupe_key(source_type: Column, symbol: Column, endpoint: Column, tool: Column, citation: Column, chunk_id: Column, body: Column) -> Column:
    market = F.concat_ws("\x1f", F.lit("market"), *(F.coalesce(c, F.lit("")) for c in (symbol, endpoint, tool, citation)))
    return F.when(source_type == "market_data", market).otherwise(X.first_of(chunk_id, citation, F.substring(body, 1, 200)))


def ledger(evidence: DataFrame, key: Column, score_col: str, seq: str, keys: Sequence[str] = ("question_id",), top: int = 8) -> DataFrame:
    """The first of each key, the best `top` of a question by score: adds rank."""
    e = evidence.withColumn("__key", key)
    first = keep_first(e, F.struct(*keys, "__key"), [F.col(seq)]).drop("__key")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score_col).desc(), F.col(seq)))).where(F.col("rank") <= top)


def packed(blocks: Column, budget: Column | int) -> Column:
    """struct<used, kept, dropped> of an array of struct<seq, block>: a block that doesn't fit is left out and the next
    one tried, so it's a fold, not a running sum."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"), F.array().cast("array<int>").alias("dropped"))

    def step(s: Column, b: Column) -> Column:
        size = F.length(b["block"])
        fits = s["used"] + size <= limit
        at = F.array(b["seq"].cast("int"))
        return F.struct((s["used"] + F.when(fits, size).otherwise(0)).alias("used"), F.when(fits, F.concat(s["kept"], at)).otherwise(s["kept"]).alias("kept"), F.when(fits, s["dropped"]).otherwise(F.concat(s["dropped"], at)).alias("dropped"))

    return F.aggregate(F.array_sort(blocks), empty, step)


def context(selected: DataFrame, config: ContextConfig = ContextConfig(), keys: Sequence[str] = ("question_id",), header: Column | None = None, seq: str = "rank", body: str = "content") -> DataFrame:
    """keys, context_text, token_estimate, used, dropped: snippets under their headers within the budget."""
    budget = max(config.token_budget * config.chars_a_token, config.least_chars)
    head = header if header is not None else F.concat(F.lit("["), F.col(seq).cast("string"), F.lit("]"))
    block = F.concat(head, F.lit("\n"), X.trimmed(F.coalesce(F.col(body), F.lit("")), config.snippet_chars))
    rows = selected.select(*keys, F.struct(F.col(seq).cast("int").alias("seq"), block.alias("block")).alias("b"))
    all_ = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("blocks")).withColumn("p", packed(F.col("blocks"), budget))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("p.kept", b["seq"])), lambda b: b["block"]), "\n\n")
    return all_.select(*keys, text.alias("context_text"), F.floor(F.length(text) / 4).cast("int").alias("token_estimate"), "p.used", "p.dropped")


def cut_off(rows: DataFrame, text: str, budget: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The older budget: blocks in order until one overflows, which is cut to what is left; later ones go."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = rows.withColumn("__before", F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return before.where(F.col("__before") < budget).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("__before")).cast("int"))).drop("__before")


def has_number(answer: Column, value: Column, legacy: bool = False) -> Column:
    """Whether the answer states the number. `legacy` looks for it in all the answer's digits run together."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.-]", "")
    v = bare(value)
    if legacy:
        return (v != "") & F.contains(bare(answer), v)
    stated = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(f"({rules.NUMBER})"), 1), bare)
    return (v != "") & F.array_contains(stated, v)


def verified(contracts: DataFrame, facts: DataFrame, legacy: bool = False) -> DataFrame:
    """For contracts (question_id, answer, must_answer, numeric_check, citation_required, n_citations) and facts
    (question_id, metric, value): missing, conflicts, has_citation, satisfied, next_action."""
    need = contracts.select("question_id", "answer", "numeric_check", F.explode_outer("must_answer").alias("metric"))
    state = need.join(facts.select("question_id", "metric", "value", F.lit(True).alias("found")), ["question_id", "metric"], "left")
    by = state.groupBy("question_id", "metric", "numeric_check").agg(F.coalesce(F.max("found"), F.lit(False)).alias("found"), F.coalesce(F.max(has_number(F.col("answer"), F.col("value"), legacy)), F.lit(False)).alias("stated"))
    of = by.groupBy("question_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("metric").isNotNull() & ~F.col("found"), F.col("metric")))).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("metric").isNotNull() & F.col("found") & F.col("numeric_check") & ~F.col("stated"), F.col("metric")))).alias("conflicts"),
    )
    any_fact = facts.groupBy("question_id").agg(F.count("*").alias("n_facts"))
    out = contracts.select("question_id", "citation_required", "n_citations").join(of, "question_id").join(any_fact, "question_id", "left")
    cited = ~F.col("citation_required") | (F.col("n_citations") > 0) | (F.coalesce("n_facts", F.lit(0)) > 0)
    missing = F.when(cited, F.col("missing")).otherwise(F.concat("missing", F.array(F.lit("citation"))))
    good = (F.size(missing) == 0) & (F.size("conflicts") == 0)
    return out.select("question_id", missing.alias("missing"), "conflicts", cited.alias("has_citation"), good.alias("satisfied"), F.when(good, "end").otherwise("retrieve_more").alias("next_action"))


def source_list(cited: DataFrame, label: Column, seq: str, keys: Sequence[str] = ("question_id",), most: int = 8) -> DataFrame:
    """keys, nth, label: distinct labels in order, `most` of them."""
    rows = keep_first(cited.withColumn("label", label), F.struct(*keys, "label"), [F.col(seq)])
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(seq))).where(F.col("nth") <= most).select(*keys, "nth", "label")


def source_label(source_type: Column, name: Column, title: Column, url: Column, page_start: Column, page_end: Column) -> Column:
    """A source's line in one of three layouts: filings with pages, market data, the web."""
    pages = F.when(page_start == page_end, F.concat(F.lit("p."), page_start.cast("string"))).otherwise(F.concat(F.lit("p."), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    some = lambda *cs: F.array_join(F.filter(F.array(*(F.coalesce(c, F.lit("")) for c in cs)), lambda x: x != ""), "; ")
    return F.when(source_type == "filings", some(title, pages, url)).when(source_type == "market_data", some(name, title)).otherwise(some(title, url))


def passes_judge(evidence: DataFrame, question: Column, body: Column, least: int = 1) -> DataFrame:
    """The default relevance filter where no model is plugged in: words that question and text share."""
    shared = F.size(F.array_intersect(X.search_terms(question), X.search_terms(body, 10_000)))
    return evidence.where(shared >= least)
