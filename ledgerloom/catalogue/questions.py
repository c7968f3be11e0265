"""Questions: reading them, routing them, planning and checking. Rows are given in the queries, and to the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X
from ..operators import evidence as E
from ..operators import search as S
from ..plans import analyze as A
from ..plans import route as P
from .base import query, t, values

QUESTIONS = [
    (1, "苹果公司现在的PE是多少？", "AAPL"),
    (2, "What is Tesla current stock price?", "TSLA"),
    (3, "总结一下英伟达最近的消息面", "NVDA"),
    (4, "苹果的目标价是多少？", "AAPL"),
    (5, "苹果RSI是多少？", "AAPL"),
    (6, "Compare 300750 and 600519 net profit in 2025 annual report", ""),
    (7, "宁德时代2026年一季度归母净利润和营业收入", ""),
    (8, "why is $NVDA trend down", "NVDA"),
    (9, "macro policy overview", ""),
    (10, "", ""),
    (11, "ticker for Apple", ""),
    (12, "market news", ""),
    (13, "MSFT analyst rating and exchange", "MSFT"),
]
MASTER = [
    ("company", "Apple", ["Apple", "苹果", "AAPL"], "AAPL", "", "US", "stock"),
    ("company", "Tesla", ["Tesla", "特斯拉"], "TSLA", "", "US", "stock"),
    ("company", "NVIDIA", ["NVIDIA", "英伟达"], "NVDA", "", "US", "stock"),
    ("company", "CATL", ["CATL", "宁德时代"], "", "300750", "CN", "stock"),
    ("market_index", "CSI 300", ["CSI 300", "沪深300"], "", "000300", "CN", "index"),
]
Q = values([q[:3] for q in QUESTIONS], ["question_id", "question", "symbol"])


def has(terms: list[str], c: str = "question") -> str:
    """SQL for any of the terms in a text, in any case."""
    return "(" + " OR ".join(f"contains(lower({c}), '{x.lower()}')" for x in terms) + ")"


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string, given string")


def read(spark):
    return A.lexical(asked(spark))


METRICS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {has(v)} THEN '{k}' END" for k, v in rules.QUESTION_METRICS.items()) + "], lambda x: x IS NOT NULL)"
MARKET_SQL = "list_filter([" + ", ".join(f"CASE WHEN {has(v)} THEN '{k}' END" for k, v in rules.MARKET_METRICS.items()) + "], lambda x: x IS NOT NULL)"
DROPPED_SQL = f"CASE WHEN list_contains({METRICS_SQL}, '归母净利润') AND contains(question, '归母') THEN list_filter({METRICS_SQL}, lambda y: y <> '净利润') ELSE {METRICS_SQL} END"
PERIOD_SQL = "CASE " + " ".join(f"WHEN {has(v)} THEN '{k}'" for k, v in rules.PERIOD_TERMS.items()) + " ELSE '' END"
INTENT_SQL = "CASE WHEN trim(question) = '' THEN 'chat' " + " ".join(f"WHEN {has(rules.HINTS[k])} THEN '{k}'" for k in ("compare", "summary", "reasoning")) + " ELSE 'fact' END"


@query(
    f"SELECT question_id, regexp_extract('#' || question || '#', '[^0-9]([0-9]{{6}})[^0-9]', 1) AS code, regexp_extract('#' || question || '#', '[^0-9](20[0-9]{{2}})[^0-9]', 1) AS year, {PERIOD_SQL} AS period, array_to_string({DROPPED_SQL}, ' ') AS metrics, array_to_string({MARKET_SQL}, ' ') AS market_metrics, {has(rules.HINTS['fresh'])} AS requires_freshness FROM {Q}"
)
def lexical_analysis(spark, sf):
    r = read(spark)
    return r.select("question_id", "code", "year", "period", F.array_join("metrics", " ").alias("metrics"), F.array_join("market_metrics", " ").alias("market_metrics"), "requires_freshness")


@query(f"SELECT question_id, CASE question_id WHEN 6 THEN '' WHEN 8 THEN 'NVDA' WHEN 13 THEN 'MSFT' WHEN 5 THEN '' ELSE '' END AS symbol FROM {Q}")
def ticker_extract(spark, sf):
    """Stop words are no tickers; RSI is part of a CJK run here, so that it isn't a word."""
    return asked(spark).select("question_id", X.ticker("question", rules.TICKER_STOPWORDS).alias("symbol"))


@query(f"SELECT question_id, {INTENT_SQL} AS intent FROM {Q}")
def intent_rules(spark, sf):
    return asked(spark).select("question_id", A.intent(F.col("question"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("intent"))


@query(
    f"SELECT question_id, CASE WHEN len(ts) > 0 THEN array_to_string(ts, '+') WHEN intent = 'compare' THEN 'comparison' ELSE 'main' END AS focus FROM (SELECT question_id, {INTENT_SQL} AS intent, list_concat(CASE WHEN len({DROPPED_SQL}) > 1 THEN {DROPPED_SQL} ELSE [] END, list_filter([CASE WHEN {has(rules.HINTS['trend'])} THEN 'price_trend' WHEN {has(rules.HINTS['market'])} THEN 'valuation' END, CASE WHEN {has(rules.HINTS['news'])} THEN 'news' END], lambda x: x IS NOT NULL)) AS ts FROM {Q})"
)
def sub_question_focus(spark, sf):
    r = read(spark).withColumn("intent", A.intent(F.col("question"), F.lit(None).cast("string"), F.lit(None).cast("double")))
    subs = A.sub_questions(F.col("question"), F.col("metrics"), F.col("intent"))
    return r.select("question_id", F.array_join(F.transform(subs, lambda s: s["focus"]), "+").alias("focus"))


@query(
    "SELECT question_id, tool, fallbacks FROM (SELECT question_id, CASE "
    + " ".join(f"WHEN {'' if n is False else ('symbol <> ' if n else 'symbol = ') + chr(39) * 2 + ' AND '}{has(terms)} THEN {i}" for i, (tool, terms, n, *_) in enumerate(rules.ROUTES))
    + " WHEN symbol <> '' THEN 98 ELSE 99 END AS r FROM "
    + Q
    + ") JOIN "
    + values([*((i, r[0], ",".join(r[5])) for i, r in enumerate(rules.ROUTES)), (98, "stock_price", ""), (99, "stock_search", "")], ["r", "tool", "fallbacks"])
    + " USING (r)"
)
def market_route(spark, sf):
    r = asked(spark).select("question_id", P.route(F.col("question"), F.col("given")).alias("route"))
    return r.select("question_id", "route.tool", F.array_join("route.fallbacks", ",").alias("fallbacks"))


PAYLOADS = [("basic_financials", "AAPL", '{"peTTM": 31.5, "other": 1, "52WeekHigh": 260}'), ("stock_price", "TSLA", "{}"), ("news_sentiment", "NVDA", '{"buzz": 1}'), ("analyst_recommendations", "AAPL", "[]"), ("price_target", "MSFT", '{"x": 2}'), ("market_news", "", '{"n": 3}')]


@query(f"SELECT * FROM {values([(1, 'basic_financials', 1, '52WeekHigh: 260' + chr(10) + 'peTTM: 31.5'), (3, 'news_sentiment', 2, ''), (12, 'market_news', 1, ''), (13, 'price_target', 2, '')], ['question_id', 'tool', 'tried', 'headline'])}")
def payload_fallback(spark, sf):
    """Recorded payloads answer; an empty one lets the next tool try."""
    r = asked(spark).select("question_id", P.route(F.col("question"), F.col("given")).alias("route"))
    got = P.first_payload(P.calls(r), spark.createDataFrame(PAYLOADS, "tool string, symbol string, payload string"))
    return got.select("question_id", "tool", "tried", P.headline(P.valuation(F.col("payload"))).alias("headline"))


def _entities(spark):
    r = read(spark).withColumn("symbol", X.first_of("given", "symbol"))
    return r, A.entities(r, A.master_of(spark, MASTER))


M = values([(i, *m[1:]) for i, m in enumerate(MASTER)], ["ord", "company", "aliases", "m_symbol", "m_code", "market", "asset_type"])


@query(
    f"""WITH q AS (SELECT question_id, question, symbol AS sym, regexp_extract('#' || question || '#', '[^0-9]([0-9]{{6}})[^0-9]', 1) AS code FROM {Q}), m AS (SELECT * FROM {M}),
a AS (SELECT question_id, 0 AS stage, coalesce(m.ord, 0) AS ord, coalesce(m.company, q.code) AS company, coalesce(m.m_symbol, '') AS symbol, q.code AS code, coalesce(m.market, 'CN') AS market FROM q LEFT JOIN m ON q.code = m.m_code WHERE q.code <> ''
UNION ALL SELECT question_id, 1, coalesce(m.ord, 0), coalesce(m.company, q.sym), coalesce(m.m_symbol, q.sym), coalesce(m.m_code, ''), coalesce(m.market, 'US') FROM q LEFT JOIN m ON q.sym = m.m_symbol WHERE q.sym <> ''
UNION ALL SELECT question_id, 2, m.ord, m.company, m.m_symbol, m.m_code, m.market FROM q, m WHERE len(list_filter(m.aliases, lambda x: CASE WHEN regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]') THEN contains(lower(regexp_replace(q.question, '\\s+', '', 'g')), lower(x)) ELSE contains(regexp_replace(' ' || lower(q.question) || ' ', '[^\\p{{L}}\\p{{N}}.&-]+', ' ', 'g'), ' ' || lower(x) || ' ') END)) > 0),
k AS (SELECT *, upper(CASE WHEN symbol <> '' THEN symbol WHEN code <> '' THEN code ELSE company END) AS key FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY stage, ord) AS n FROM k)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY stage, ord) AS BIGINT) AS nth, company, symbol, code, market FROM f WHERE n = 1"""
)
def entity_alias_match(spark, sf):
    _, e = _entities(spark)
    return e.select("question_id", F.col("nth").cast("long").alias("nth"), "company", "symbol", "code", "market")


@query()
def evidence_needs(spark, sf):
    """Needs by entity; compared with rows given in the tests."""
    r, e = _entities(spark)
    return A.evidence_needs(r, e)


@query()
def source_requirements(spark, sf):
    r, e = _entities(spark)
    return A.requirements(r, e, A.evidence_needs(r, e))


NEEDS = [(1, "filing_fact", "", "300750", "CN", "stock"), (2, "filing_fact", "AAPL", "", "US", "stock"), (3, "news_event", "AAPL", "", "US", "stock"), (4, "news_event", "", "300750", "CN", "stock"), (5, "valuation_metric", "TSLA", "", "us", "STOCK"), (6, "price_trend", "", "300750", "CN", "stock"), (7, "macro_context", "", "", "", ""), (8, "internal_docs", "", "600519", "CN", "stock")]
NEEDS_SCHEMA = "need_id int, need_type string, symbol string, code string, market string, asset_type string"
REGISTRY = values([(i, r[0], r[3], r[4], [x.upper() for x in r[6]], [x.upper() for x in r[7]], r[8], r[9], r[10]) for i, r in enumerate(rules.SOURCES)], ["place", "name", "caps", "authority", "markets", "types", "ids", "enabled", "optional"])
CAPABILITY_SQL = "CASE need_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.NEED_CAPABILITY.items()) + " ELSE need_type END"


@query(
    f"""WITH n AS (SELECT *, {CAPABILITY_SQL} AS cap, list_filter([CASE WHEN symbol <> '' THEN 'symbol' END, CASE WHEN code <> '' THEN 'code' END, CASE WHEN code <> '' THEN 'cn_code' END, CASE WHEN symbol = '' AND code = '' THEN 'none' END], lambda x: x IS NOT NULL) AS mine FROM {values(NEEDS, [c.split()[0] for c in NEEDS_SCHEMA.split(', ')])}), r AS (SELECT * FROM {REGISTRY})
SELECT need_id, name AS source_name FROM (SELECT n.need_id, r.name, row_number() OVER (PARTITION BY n.need_id ORDER BY r.optional, r.authority DESC, r.place) AS k FROM n LEFT JOIN r ON r.enabled AND list_contains(r.caps, n.cap) AND (list_contains(r.markets, '*') OR list_contains(r.markets, upper(n.market))) AND (list_contains(r.types, '*') OR list_contains(r.types, upper(n.asset_type))) AND list_has_any(r.ids, n.mine)) WHERE k = 1"""
)
def source_for_need(spark, sf):
    needs = spark.createDataFrame(NEEDS, NEEDS_SCHEMA)
    return P.source_for_need(needs, P.registry(spark), ["need_id"]).select("need_id", "source_name")


FLAGS = [(1, True, True, False, True, False), (2, True, False, True, True, False), (3, True, False, False, False, True), (4, True, False, False, False, False)]
FLAG_NAMES = ["question_id", "needs_answer", "needs_filing_evidence", "needs_fresh_market_data", "needs_news", "needs_macro_context"]


@query(f"SELECT * FROM {values([(1, 1, 'filings'), (1, 2, 'market_data'), (2, 1, 'market_data'), (3, 1, 'web_search'), (4, 1, 'web_search')], ['question_id', 'nth', 'source_name'])}")
def capability_plan(spark, sf):
    """Flags to sources: market data comes before the web for news, the registry being in that order."""
    flags = spark.createDataFrame(FLAGS, ", ".join(f"{n} {'int' if i == 0 else 'boolean'}" for i, n in enumerate(FLAG_NAMES)))
    flags = flags.withColumns({k: F.lit(False) for k in rules.REQUIREMENT_CAPABILITY if k not in FLAG_NAMES})
    return P.sources_for_requirements(flags, P.registry(spark))


@query(
    "WITH p AS (SELECT * FROM (VALUES (1, 'filings'), (1, 'market_data'), (2, 'market_data'), (2, 'web_search')) AS v(question_id, source_name)), e AS (SELECT * FROM (VALUES (1, 'CATL', '', '300750'), (1, 'Apple', 'AAPL', ''), (2, 'Tesla', 'TSLA', '')) AS v(question_id, company, symbol, code)) SELECT p.question_id, p.source_name, e.company FROM p JOIN e USING (question_id) WHERE (p.source_name <> 'market_data' OR e.symbol <> '') AND (p.source_name <> 'filings' OR e.code <> '')"
)
def entity_fanout(spark, sf):
    plan = spark.createDataFrame([(1, "filings"), (1, "market_data"), (2, "market_data"), (2, "web_search")], "question_id int, source_name string")
    found = spark.createDataFrame([(1, 1, "CATL", "", "300750"), (1, 2, "Apple", "AAPL", ""), (2, 1, "Tesla", "TSLA", "")], "question_id int, nth int, company string, symbol string, code string")
    return P.fanned_out(plan, found).select("question_id", "source_name", "company")


@query(f"SELECT * FROM {values([(i, m, s, k, 'hoprag' if i == 'compare' else 'trace' if i == 'reasoning' else 'cot_rag' if s > 2 or k > 2 else 'rag_plus') for m, i, s, k in [(1, 'compare', 5, 1), (2, 'reasoning', 1, 1), (3, 'fact', 3, 0), (4, 'fact', 1, 3), (5, 'summary', 1, 1)]], ['intent', 'id', 'n_subs', 'n_metrics', 'mode'])}")
def reasoning_mode(spark, sf):
    rows = spark.createDataFrame([(1, "compare", 5, 1), (2, "reasoning", 1, 1), (3, "fact", 3, 0), (4, "fact", 1, 3), (5, "summary", 1, 1)], "id int, intent string, n_subs int, n_metrics int")
    return rows.withColumn("mode", A.reasoning_mode(F.col("intent"), F.col("n_subs"), F.col("n_metrics")))


EXPAND_SQL = "list_filter([question, " + ", ".join(f"CASE WHEN contains(regexp_replace(question, '\\s+', '', 'g'), '{k}') THEN '{v}' END" for k, v in rules.QUERY_EXPANSIONS.items()) + "], lambda x: x IS NOT NULL AND x <> '')"


@query(
    f"SELECT question_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ' ') AS retrieval_query, array_to_string(list_filter([{', '.join(repr(m) for m in rules.METRIC_TERMS)}], lambda m: contains(question, m)), ' ') AS metric_hints FROM (SELECT question_id, question, {EXPAND_SQL} AS e FROM {Q})"
)
def query_expansion(spark, sf):
    return S.expanded(asked(spark)).select("question_id", "retrieval_query", F.array_join("metric_hints", " ").alias("metric_hints"))


@query("SELECT * FROM (VALUES (1, '归母净利润'), (2, '净利润'), (3, '营业收入 净利润'), (4, '净利润 归母净利润')) AS v(id, metrics)")
def specific_metric_drop(spark, sf):
    rows = spark.createDataFrame([(1, "归母多少", ["净利润", "归母净利润"], None), (2, "net", ["净利润"], ["other"]), (3, "x", ["营业收入"], ["净利润", "pe"]), (4, "x", ["净利润", "归母净利润"], None)], "id int, q string, m array<string>, s array<string>")
    merged = A.merged_metrics(F.col("m"), F.col("s"), list(rules.QUESTION_METRICS))
    return rows.withColumn("m", merged).select("id", F.array_join(A.dropped_generic(F.col("m"), F.col("q")), " ").alias("metrics"))


CONTRACTS = [(1, "Revenue was 1,234.5 and profit 67%", ["营业收入", "净利润"], True, True, 1), (2, "It was 12345", ["营业收入"], True, False, 0), (3, "none", [], False, True, 0), (4, "x", ["净利润"], False, True, 0)]
FACTS = [(1, "营业收入", "1,234.5"), (1, "净利润", "67%"), (2, "营业收入", "234"), (4, "净利润", "")]


@query("SELECT * FROM (VALUES (1, '', '', true, true, 'end'), (2, '', '营业收入', true, false, 'retrieve_more'), (3, 'citation', '', false, false, 'retrieve_more'), (4, '', '', true, true, 'end')) AS v(question_id, missing, conflicts, has_citation, satisfied, next_action)")
def contract_check(spark, sf):
    """A number counts if the answer states it as a whole: 234 isn't in 12345."""
    contracts = spark.createDataFrame(CONTRACTS, "question_id int, answer string, must_answer array<string>, numeric_check boolean, citation_required boolean, n_citations int")
    out = E.verified(contracts, spark.createDataFrame(FACTS, "question_id int, metric string, value string"))
    return out.select("question_id", F.array_join("missing", ",").alias("missing"), F.array_join("conflicts", ",").alias("conflicts"), "has_citation", "satisfied", "next_action")


@query("SELECT item_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 0 AS kept FROM benchmark")
def relevance_filter(spark, sf):
    """The default judge: words that question and text share, here of a text with itself."""
    b = t(spark, sf, "benchmark")
    kept = E.passes_judge(b, F.col("text"), F.col("text"))
    return b.select("item_id").join(kept.select("item_id", F.lit(True).alias("kept")), "item_id", "left").fillna(False)
