"""From needs to tools: sources that cover a need, plans, market data routes and their fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X


def registry(spark: SparkSession, rows: list[tuple] = rules.SOURCES) -> DataFrame:
    """Sources with their place in the order; a source is added as a row."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, " + rules.SOURCES_SCHEMA)


def _accepts(value: Column, accepted: Column) -> Column:
    v = F.upper(F.coalesce(value, F.lit("")))
    return F.array_contains(accepted, "*") | (F.size(accepted) == 0) | F.array_contains(F.transform(accepted, F.upper), v)


def capability_of(need_type: Column, table: dict[str, str] = rules.NEED_CAPABILITY) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(need_type == k, v) if out is None else out.when(need_type == k, v)
    return out.otherwise(need_type)


def identifier_types(symbol: Column, code: Column) -> Column:
    some = F.array_compact(F.array(F.when(F.coalesce(symbol, F.lit("")) != "", "symbol"), F.when(F.coalesce(code, F.lit("")) != "", "code"), F.when(F.coalesce(code, F.lit("")) != "", "cn_code")))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("none")))


def source_for_need(needs: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each need with its best source (required ones first, then by authority), or nulls where none covers it.

    The registry is a few rows, broadcast; needs are never compared with each other."""
    s = F.broadcast(sources.select("place", F.col("name").alias("source_name"), "tool", "source", "capabilities", "authority", "markets", "asset_types", "identifier_types", "enabled", "optional"))
    ids = identifier_types(F.col("symbol"), F.col("code"))
    covers = F.col("enabled") & F.array_contains("capabilities", capability_of(F.col("need_type"))) & _accepts(F.col("market"), F.col("markets")) & _accepts(F.col("asset_type"), F.col("asset_types")) & (F.array_contains("identifier_types", "*") | F.arrays_overlap("identifier_types", ids))
    both = needs.join(s, covers, "left")
    best = W.partitionBy(*keys).orderBy(F.col("optional"), F.col("authority").desc(), F.col("place"))
    return both.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*needs.columns, "source_name", "tool", "source", "authority", "optional")


def sources_for_requirements(flags: DataFrame, sources: DataFrame, table: dict[str, str] = rules.REQUIREMENT_CAPABILITY) -> DataFrame:
    """question_id, nth, source_name: for each needed capability the first enabled source, each source once; the web
    where nothing else is selected."""
    asked = flags.select("question_id", "needs_answer", F.posexplode_outer(F.array_compact(F.array(*(F.when(F.col(k), F.lit(v)) for k, v in table.items())))).alias("at", "capability"))
    s = F.broadcast(sources.where("enabled").select("place", F.col("name").alias("source_name"), "capabilities"))
    first = asked.join(s, F.array_contains("capabilities", F.col("capability")), "left").withColumn("__n", F.row_number().over(W.partitionBy("question_id", "at").orderBy("place"))).where("__n = 1")
    once = first.where("source_name is not null").groupBy("question_id", "source_name").agg(F.min("at").alias("at"))
    none = flags.where("needs_answer").join(once.select("question_id").distinct(), "question_id", "left_anti").select("question_id", F.lit("web_search").alias("source_name"), F.lit(0).alias("at"))
    return once.unionByName(none).select("question_id", F.row_number().over(W.partitionBy("question_id").orderBy("at")).alias("nth"), "source_name")


def tool_plan(needs: DataFrame, flags: DataFrame, sources: DataFrame, need_key: str = "need_id") -> DataFrame:
    """question_id, need_id, source_name, planned: sources by need; questions without a planned need by requirements.
    A need that no source covers is a row with planned false."""
    by_need = source_for_need(needs, sources, ["question_id", need_key]).select("question_id", need_key, "source_name", F.col("source_name").isNotNull().alias("planned"))
    done = by_need.where("planned").select("question_id").distinct()
    rest = sources_for_requirements(flags.join(done, "question_id", "left_anti"), sources)
    return by_need.unionByName(rest.select("question_id", F.lit(None).cast(dict(needs.dtypes)[need_key]).alias(need_key), "source_name", F.lit(True).alias("planned")))


def fanned_out(plan: DataFrame, entities: DataFrame) -> DataFrame:
    """Plan items by entity, where the tool can use it: market data needs a symbol, filings a code."""
    both = plan.join(entities.select("question_id", F.col("nth").alias("entity_nth"), "company", "symbol", "code"), "question_id")
    return both.where(((F.col("source_name") != "market_data") | (F.col("symbol") != "")) & ((F.col("source_name") != "filings") | (F.col("code") != "")))


def focused(query: Column, source: Column, company: Column) -> Column:
    return F.when(source == "market_data", F.concat_ws(" ", company, F.lit("market data:"), query)).when(source == "filings", F.concat_ws(" ", company, F.lit("filings:"), query)).otherwise(F.concat_ws(" ", company, query))


def route(question: Column, symbol: Column, table: list[tuple] = rules.ROUTES) -> Column:
    """struct<tool, symbol, indicator, lookback_days, max_items, fallbacks>: the first rule that the question meets."""
    s = F.upper(F.coalesce(symbol, F.lit("")))
    low = F.lower(question)
    indicator = F.when(low.contains("macd"), "macd").when(low.contains("sma"), "sma").when(low.contains("ema"), "ema").otherwise("rsi")

    def made(tool: str, days: int, limit: int, spare: list[str]) -> Column:
        return F.struct(F.lit(tool).alias("tool"), (F.lit("") if tool in ("stock_search", "market_news") else s).alias("symbol"), (indicator if tool == "technical_indicator" else F.lit("rsi")).alias("indicator"), F.lit(days).alias("lookback_days"), F.lit(limit).alias("max_items"), F.array(*map(F.lit, spare)).cast("array<string>").alias("fallbacks"))

    out = None
    for tool, terms, needs_symbol, days, limit, spare in table:
        meets = X.any_in(question, terms)
        if needs_symbol is not False:
            meets = meets & ((s != "") if needs_symbol else (s == ""))
        out = F.when(meets, made(tool, days, limit, spare)) if out is None else out.when(meets, made(tool, days, limit, spare))
    return out.when(s != "", made(rules.DEFAULT_ROUTE, 7, 5, [])).otherwise(made(rules.NO_SYMBOL_ROUTE, 7, 5, []))


def calls(routed: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """keys, at, tool, symbol: the routed tool and its fallbacks in order; tools for the whole market take no symbol,
    and those that need one are left out without it."""
    rows = routed.select(*keys, "route.symbol", F.posexplode(F.concat(F.array("route.tool"), "route.fallbacks")).alias("at", "tool"))
    free = F.col("tool").isin(*rules.TOOLS_WITHOUT_SYMBOL)
    return rows.withColumn("symbol", F.when(F.col("tool") == "market_news", "").otherwise(F.col("symbol"))).where(free | (F.col("symbol") != ""))


def first_payload(calls_: DataFrame, payloads: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """keys, tool, symbol, payload, tried: the first call with a payload that isn't empty, among recorded ones
    (tool, symbol, payload)."""
    full = payloads.where(~F.coalesce(F.trim("payload"), F.lit("")).isin("", "[]", "{}", "null", '""'))
    both = calls_.join(full, ["tool", "symbol"], "left")
    got = both.where("payload is not null").withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("at"))).where("__n = 1")
    return got.select(*keys, "tool", "symbol", "payload", (F.col("at") + 1).alias("tried"))


def valuation(payload: Column, keys: list[str] = rules.VALUATION_KEYS) -> Column:
    """The payload's valuation figures, as a map of those that are there."""
    m = F.from_json(payload, "map<string,string>")
    return F.map_filter(m, lambda k, v: k.isin(*keys) & v.isNotNull() & ~v.isin("", "null"))


def headline(figures: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(figures)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def legacy_override(question: Column, plan: Column) -> Column:
    """The older planner: a six-digit code, or CJK text with a filing word, goes to the filings alone."""
    filing = X.any_in(question, rules.HINTS["document"])
    return F.when((X.six_digit_code(question) != "") | (question.rlike(r"[\x{4e00}-\x{9fff}]") & filing), F.array(F.lit("filings"))).otherwise(plan)
