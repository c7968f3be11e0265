"""Reading questions: codes, tickers, periods, metrics, entities, intents, needs and requirements, all as columns.

A model's answer can be merged in: `semantic` columns (intent, confidence, metrics, market_metrics) are optional and
default to none, so that rules alone decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import text as X
from ..functions.classify import first_match

SEMANTIC = T.StructType([T.StructField("intent", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("metrics", T.ArrayType(T.StringType())), T.StructField("market_metrics", T.ArrayType(T.StringType()))])


def parsed_semantics(reply: Column) -> Column:
    """A model's reply as SEMANTIC: the object in its text, or null."""
    return F.from_json(X.json_object(reply), SEMANTIC)


def found_keys(question: Column, table: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*(F.when(X.any_in(question, terms), F.lit(k)) for k, terms in table.items())))


def dropped_generic(metrics: Column, question: Column, generic: str = "净利润", specific: str = "归母净利润", sign: str = "归母") -> Column:
    """Without the generic metric where the specific one is asked for."""
    return F.when(F.array_contains(metrics, specific) & question.contains(sign), F.array_except(metrics, F.array(F.lit(generic)))).otherwise(metrics)


def merged_metrics(lexical: Column, semantic: Column, allowed: list[str]) -> Column:
    return F.array_distinct(F.concat(lexical, F.array_intersect(F.coalesce(semantic, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))))


def lexical(questions: DataFrame) -> DataFrame:
    """Adds code, symbol, year, period, metrics, market_metrics and requires_freshness to (question_id, question)."""
    q = F.col("question")
    metrics = found_keys(q, rules.QUESTION_METRICS)
    return questions.withColumns(
        {
            "code": X.six_digit_code(q),
            "symbol": X.ticker(q, rules.TICKER_STOPWORDS),
            "year": X.year_in(q),
            "period": first_match([(X.any_in(q, terms), k) for k, terms in rules.PERIOD_TERMS.items()]),
            "metrics": dropped_generic(metrics, q),
            "market_metrics": found_keys(q, rules.MARKET_METRICS),
            "requires_freshness": X.any_in(q, rules.HINTS["fresh"]),
        }
    )


def intent(question: Column, proposed: Column, confidence: Column) -> Column:
    """Comparison, summary and reasoning words come before a confident proposal; a blank question is chat."""
    p = F.lower(X.strip(F.coalesce(proposed, F.lit(""))))
    sure = F.coalesce(confidence, F.lit(0.0)) >= 0.5
    rich = [(sure & (p == k), v) for k, v in rules.RICH_INTENTS.items()]
    return first_match([(X.strip(question) == "", "chat"), *((X.any_in(question, rules.HINTS[k]), k) for k in ("compare", "summary", "reasoning")), (sure & p.isin(*rules.INTENTS), p), *rich], "fact")


def sub_questions(question: Column, metrics: Column, intent_: Column) -> Column:
    """array<struct<question, focus, type>>: one a metric if there are several, market and news parts, else the question."""
    part = lambda q, focus, kind: F.struct(q.alias("question"), F.lit(focus).alias("focus") if isinstance(focus, str) else focus.alias("focus"), F.lit(kind).alias("type"))
    none = F.array().cast("array<struct<question:string,focus:string,type:string>>")
    several = F.when(F.size(metrics) > 1, F.transform(metrics, lambda m: part(F.concat(question, F.lit(" -- "), m), m, "metric_lookup"))).otherwise(none)
    market = F.when(X.any_in(question, rules.HINTS["trend"]), F.array(part(F.concat(question, F.lit(" -- price trend")), "price_trend", "trend_analysis"))).when(X.any_in(question, rules.HINTS["market"]), F.array(part(F.concat(question, F.lit(" -- valuation metrics")), "valuation", "metric_lookup"))).otherwise(none)
    news = F.when(X.any_in(question, rules.HINTS["news"]), F.array(part(F.concat(question, F.lit(" -- news and sentiment")), "news", "news_summary"))).otherwise(none)
    every = F.concat(several, market, news)
    return F.when(F.size(every) > 0, every).when(intent_ == "compare", F.array(part(question, "comparison", "comparison"))).otherwise(F.array(part(question, "main", "single")))


ENTITY = "entity_type string, company string, aliases array<string>, symbol string, code string, market string, asset_type string"


def entities(questions: DataFrame, master: DataFrame) -> DataFrame:
    """question_id, nth, company, symbol, code, market, asset_type, found_by, confidence for questions with code and symbol.

    By code, then symbol, then aliases (as a word, or inside the text without spaces if it has CJK characters); codes
    and symbols that the master lacks make entities of their own. The master is a dimension and is broadcast."""
    q = questions.select("question_id", "question", "code", "symbol")
    m = F.broadcast(master.withColumn("__order", F.monotonically_increasing_id()))
    by_code = q.where("code != ''").join(m.withColumnRenamed("code", "m_code").withColumnRenamed("symbol", "m_symbol"), F.col("code") == F.col("m_code"), "left")
    made = lambda known, other: F.coalesce(known, other)
    codes = by_code.select("question_id", F.lit(0).alias("stage"), F.coalesce("__order", F.lit(0).cast("long")).alias("o"), made(F.col("company"), F.col("code")).alias("company"), F.coalesce("m_symbol", F.lit("")).alias("symbol"), "code", F.coalesce("market", F.lit("CN")).alias("market"), F.coalesce("asset_type", F.lit("stock")).alias("asset_type"), F.when(F.col("company").isNull(), "regex_code").otherwise("master").alias("found_by"), F.when(F.col("company").isNull(), 0.95).otherwise(0.98).alias("confidence"))
    by_symbol = q.where("symbol != ''").join(m.withColumnRenamed("code", "m_code").withColumnRenamed("symbol", "m_symbol"), (F.col("symbol") == F.col("m_symbol")) | F.array_contains(F.transform("aliases", F.upper), F.col("symbol")), "left")
    symbols = by_symbol.select("question_id", F.lit(1).alias("stage"), F.coalesce("__order", F.lit(0).cast("long")).alias("o"), made(F.col("company"), F.col("symbol")).alias("company"), F.coalesce("m_symbol", "symbol").alias("symbol"), F.coalesce("m_code", F.lit("")).alias("code"), F.coalesce("market", F.lit("US")).alias("market"), F.coalesce("asset_type", F.lit("stock")).alias("asset_type"), F.when(F.col("company").isNull(), "regex_symbol").otherwise("master").alias("found_by"), F.when(F.col("company").isNull(), 0.9).otherwise(0.97).alias("confidence"))
    compact, spaced = F.lower(X.squeeze("question")), F.concat(F.lit(" "), X.name_key("question"), F.lit(" "))
    hit = F.exists("aliases", lambda a: F.when(a.rlike(r"[\x{4e00}-\x{9fff}]"), F.contains(compact, F.lower(a))).otherwise(F.contains(F.regexp_replace(spaced, r"[^\p{L}\p{N}.&-]+", " "), F.concat(F.lit(" "), F.lower(a), F.lit(" ")))))
    named = q.select("question_id", "question").join(m, hit).select("question_id", F.lit(2).alias("stage"), F.col("__order").alias("o"), "company", "symbol", "code", "market", "asset_type", F.lit("master").alias("found_by"), F.lit(0.92).alias("confidence"))
    every = codes.unionByName(symbols).unionByName(named).withColumn("__key", F.upper(X.first_of("symbol", "code", "company")))
    first = every.withColumn("__n", F.row_number().over(W.partitionBy("question_id", "__key").orderBy("stage", "o"))).where("__n = 1")
    valid = first.withColumn("symbol", F.when(F.upper("symbol").isin(*rules.INVALID_SYMBOLS), "").otherwise(F.col("symbol")))
    return valid.withColumn("nth", F.row_number().over(W.partitionBy("question_id").orderBy("stage", "o"))).select("question_id", "nth", "company", "symbol", "code", "market", "asset_type", "found_by", "confidence")


def exact_name(mentions: DataFrame, master: DataFrame, name: str) -> DataFrame:
    """Mentions of a master's company by its exact name, whatever the case and spaces."""
    return mentions.withColumn("__k", X.name_key(name)).join(F.broadcast(master.withColumn("__k", X.name_key("company"))), "__k").drop("__k")


def _wants(q: Column, metrics: Column, market_metrics: Column) -> dict[str, Column]:
    h = {k: X.any_in(q, v) for k, v in rules.HINTS.items()}
    return {
        "document": (F.size(metrics) > 0) | h["document"],
        "market": (F.size(market_metrics) > 0) | h["market"] | h["api"] | h["fresh"],
        "news": h["news"],
        "technical": h["technical"] | F.array_contains(market_metrics, "technical_indicator"),
        "trend": h["trend"] | F.array_contains(market_metrics, "trend"),
        **{k: h[k] for k in ("policy", "macro", "internal", "summary", "reasoning", "reason_news")},
    }


def evidence_needs(questions: DataFrame, entities_: DataFrame) -> DataFrame:
    """question_id, entity_nth, company, symbol, code, market, asset_type, need_type, query: what each question needs, by
    entity, or for the question as a whole where no entity needs anything."""
    w = _wants(F.col("question"), F.col("metrics"), F.col("market_metrics"))
    both = questions.select("question_id", "question", "metrics", "market_metrics").join(entities_.select("question_id", F.col("nth").alias("entity_nth"), "company", "symbol", "code", "market", "asset_type"), "question_id", "left")
    one = F.col("entity_nth").isNotNull()
    need = lambda when, kind, words: F.when(when, F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("need_type"), F.trim(F.concat_ws(" ", "company", F.lit(words), "question")).alias("query")))
    has_code, has_symbol = F.coalesce("code", F.lit("")) != "", F.coalesce("symbol", F.lit("")) != ""
    market_kind = F.when(w["trend"], "price_trend").when(w["technical"], "technical_indicator").when(F.size("market_metrics") > 0, "valuation_metric").otherwise("live_market_data")
    own = F.array_compact(F.array(need(one & (w["document"] | has_code), "filing_fact", "filing report facts"), need(one & w["market"] & (has_symbol | has_code), market_kind, "live market data"), need(one & w["news"], "news_event", "news")))
    rows = both.withColumn("needs", own)
    total = rows.groupBy("question_id").agg(F.sum(F.size("needs")).alias("n"))
    out = rows.select("question_id", "entity_nth", "company", "symbol", "code", "market", "asset_type", F.explode("needs").alias("x"))
    out = out.select("question_id", "entity_nth", "company", "symbol", "code", "market", "asset_type", "x.need_type", "x.query")
    kind = F.when(w["news"], "news_event").when(w["policy"], "policy_context").when(w["macro"], "macro_context")
    spare = questions.join(total.where("n = 0").select("question_id"), "question_id").select("question_id", *(F.lit(None).cast(t).alias(c) for c, t in (("entity_nth", "int"), ("company", "string"), ("symbol", "string"), ("code", "string"), ("market", "string"), ("asset_type", "string"))), kind.alias("need_type"), F.col("question").alias("query")).where("need_type is not null")
    return out.unionByName(spare)


def requirements(questions: DataFrame, entities_: DataFrame, needs: DataFrame) -> DataFrame:
    """question_id and twelve flags, from the question's words, its first entity and its needs."""
    first = entities_.where("nth = 1").select("question_id", "symbol", "asset_type")
    kinds = needs.groupBy("question_id").agg(F.collect_set("need_type").alias("kinds"))
    rows = questions.drop("symbol").join(first, "question_id", "left").join(kinds, "question_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    w = _wants(F.col("question"), F.col("metrics"), F.col("market_metrics"))
    of = lambda *names: F.arrays_overlap("kinds", F.array(*map(F.lit, names)))
    document = of("filing_fact", "document_evidence") | w["document"]
    structured = of("live_market_data", "valuation_metric", "structured_metric", "price_trend", "technical_indicator", "market_index_data")
    index = F.coalesce(F.col("asset_type") == "index", F.lit(False))
    trend, technical, news = of("price_trend") | w["trend"], of("technical_indicator") | w["technical"], of("news_event") | w["news"]
    symbol = F.coalesce("symbol", F.lit("")) != ""
    fresh = structured | index | trend
    reasoned = w["reasoning"] & (symbol | structured)
    news = news | (w["summary"] & ~(document | fresh) & symbol) | (reasoned & w["reason_news"])
    flags = {"needs_answer": F.lit(True), "needs_filing_evidence": document, "needs_document_evidence": document, "needs_fresh_market_data": fresh | reasoned, "needs_structured_metrics": fresh | reasoned, "needs_news": news, "needs_policy_context": w["policy"], "needs_macro_context": w["macro"], "needs_internal_docs": w["internal"], "needs_market_index_data": index, "needs_price_trend": trend, "needs_technical_indicator": technical}
    return rows.select("question_id", *(v.alias(k) for k, v in flags.items()))


def reasoning_mode(intent_: Column, n_subs: Column, n_metrics: Column) -> Column:
    return F.when(intent_ == "compare", "hoprag").when(intent_ == "reasoning", "trace").when((n_subs > 2) | (n_metrics > 2), "cot_rag").otherwise("rag_plus")


def master_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ENTITY)
