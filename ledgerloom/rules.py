"""Rule tables. Every operator takes its table as an argument; these are the defaults for filings."""

from __future__ import annotations

# Keywords, labels and patterns that results depend on.

STATEMENT_LABELS = {"balance_sheet": "资产负债表", "income_statement": "利润表", "cash_flow": "现金流量表", "equity_statement": "所有者权益变动表"}

STATEMENT_RULES = {
    "income_statement": ["利润表", "营业收入", "营业总收入", "营业成本", "营业利润", "利润总额", "净利润", "归属于母公司", "归属于上市公司股东", "少数股东损益", "每股收益", "研发费用", "销售费用", "管理费用", "财务费用"],
    "balance_sheet": ["资产负债表", "流动资产", "非流动资产", "货币资金", "应收账款", "存货", "资产总计", "流动负债", "非流动负债", "负债合计", "所有者权益", "期末余额", "期初余额"],
    "cash_flow": ["现金流量表", "经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量", "现金及现金等价物", "现金流量净额", "销售商品、提供劳务收到的现金"],
    "equity_statement": ["所有者权益变动表", "股本", "资本公积", "盈余公积", "未分配利润", "所有者权益变动"],
}

METRIC_TERMS = [
    "营业收入", "营业总收入", "营业成本", "营业总成本", "研发费用", "销售费用", "管理费用", "财务费用", "营业利润", "利润总额", "净利润",
    "归属于母公司所有者的净利润", "归属于上市公司股东的净利润", "扣除非经常性损益后的净利润", "少数股东损益", "基本每股收益", "稀释每股收益",
    "货币资金", "交易性金融资产", "应收票据", "应收账款", "应收款项融资", "预付款项", "存货", "流动资产合计", "资产总计", "短期借款", "应付票据",
    "应付账款", "合同负债", "流动负债合计", "负债合计", "所有者权益合计", "经营活动产生的现金流量净额", "投资活动产生的现金流量净额",
    "筹资活动产生的现金流量净额", "现金及现金等价物净增加额",
]

QUERY_EXPANSIONS = {
    "归母净利润": "归属于母公司所有者的净利润 归属于上市公司股东的净利润", "归母": "归属于母公司所有者 归属于上市公司股东", "营收": "营业收入 营业总收入", "收入": "营业收入 营业总收入",
    "净利": "净利润 归属于母公司所有者的净利润", "扣非": "扣除非经常性损益后的净利润", "每股收益": "基本每股收益 稀释每股收益", "现金流": "现金流量 经营活动产生的现金流量净额",
}

REPORT_SECTIONS = [
    "公司业务概要", "管理层讨论与分析", "经营情况讨论与分析", "主要会计数据和财务指标", "风险因素", "重要事项", "募集资金使用情况", "股份变动及股东情况",
    "环境与社会责任", "财务报告", "财务报表", "合并资产负债表", "母公司资产负债表", "合并利润表", "母公司利润表", "合并现金流量表", "母公司现金流量表",
    "所有者权益变动表", "合并所有者权益变动表", "母公司所有者权益变动表", "研发投入",
]
STATEMENT_SECTIONS = ["资产负债表", "利润表", "现金流量表", "所有者权益变动表", "财务报表"]
TABLE_KEYWORDS = ["营业收入", "净利润", "归属于上市公司股东", "经营活动产生的现金流量净额", "基本每股收益", "加权平均净资产收益率", "研发投入", "资产总额", "负债总额", "所有者权益", "单位：元", "单位:元", "单位：万元", "单位:万元", "单位：亿元", "单位:亿元"]
TABLE_UNIT = r"单位[:：]\s*(元|万元|亿元|股|%|人民币)"
SECTION_BY_BODY = {
    "合并资产负债表": ["货币资金", "流动资产", "非流动资产", "负债合计", "所有者权益", "负债和所有者权益总计"],
    "合并利润表": ["营业总收入", "营业利润", "净利润", "每股收益"],
    "合并现金流量表": ["经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量"],
    "所有者权益变动表": ["所有者权益变动", "本期增减变动金额"],
}

ANNOUNCEMENT_NOISE = [
    r"证券代码[:：].*", r"证券简称[:：].*", r"公告编号[:：].*", r"A股代码[:：].*", r"A股简称[:：].*", r"港股代码[:：].*", r"港股简称[:：].*",
    r"本公司董事会及全体董事保证本公告内容不存在任何虚假记载、误导性陈述或者重大遗漏.*", r"特此公告[。.]?", r".*董事会\s*$", r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日\s*$",
]
LINE_NOISE = [r"\s*\d{1,4}\s*$", r".{2,}[.．。·]{3,}\s*\d{1,4}\s*$", r".{0,40}(年度报告|半年度报告|季度报告)全文\s*$"]
IMAGE_LINK = r"!\[[^\]]*\]\(([^)]+)\)"
MOJIBAKE_MARKS = "ÃÂÄÅÆÇÈÉÑÖÜàáâãäåæçèéêëìíîïðñòóôõöùúûüĀāĂăĄąŒœŠšŽž€™�"

FACT_ALIASES = {
    "营业收入": ["营业收入"], "归母净利润": ["归属于上市公司股东的净利润", "归母净利润"], "扣非归母净利润": ["归属于上市公司股东的扣除非经常性损益的净利润", "扣非归母净利润"],
    "经营现金流": ["经营活动产生的现金流量净额"], "研发投入": ["研发投入", "研发费用"], "基本每股收益": ["基本每股收益"], "加权平均净资产收益率": ["加权平均净资产收益率"],
    "资产总额": ["资产总额", "总资产"], "负债总额": ["负债总额", "总负债"], "货币资金": ["货币资金"], "应收账款": ["应收账款"], "存货": ["存货"],
}
FACTS_WITHOUT_NUMBER = ["加权平均净资产收益率"]
FACT_UNIT = r"单位[:：]\s*([人民币]*元|万元|亿元|千元|股|%)"
#: The grouped form first: an ungrouped number of more than three digits falls apart. NUMBER is the other, whole form.
NUMBER_GROUPED = r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?|[-+]?\d+(?:\.\d+)?%?"
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?%?"

EVIDENCE_ALIASES = {"营业收入": ["营业收入", "revenue"], "净利润": ["净利润", "net profit", "net income"], "归母净利润": ["归属于上市公司股东的净利润", "归母净利润", "归母", "attributable net profit"]}
NEGATIVE_HINTS = ["扣除", "扣非", "非经常性"]

HIGH_VALUE = [
    "业绩预告", "业绩快报", "投资者关系活动记录", "调研活动", "重大合同", "中标", "项目进展", "对外投资", "回购", "增持", "减持", "权益变动", "并购", "重组",
    "发行股份购买资产", "购买资产", "定增", "向特定对象发行", "股权激励", "员工持股", "募集资金", "风险提示", "诉讼", "仲裁", "订单", "合作协议",
]
ANNOUNCEMENT_EXCLUDED = r"(摘要|英文|港股公告|H股公告|海外监管|更正|修订|补充|取消|已取消|问询函|回复|法律意见书|独立董事|核查意见|鉴证报告|专项核查)"
REPORT_EXCLUDED = r"(摘要|英文|港股公告|H股公告|海外监管|取消|更正|修订|补充|已取消|公告编号|意见|说明|问询函|回复)"
REPORT_TITLES = {"annual": r"(年度报告|年报)(全文)?$", "semiannual": r"(半年度报告|半年报)(全文)?$", "q1": r"(第一季度报告|一季度报告)(全文)?$", "q3": r"(第三季度报告|三季度报告)(全文)?$"}
ANNOUNCEMENT_CATEGORIES = {
    "merger_reorg": ["并购重组", "重大资产重组", "发行股份购买资产", "购买资产", "资产收购", "资产出售", "吸收合并", "重组", "并购"],
    "performance": ["业绩预告", "业绩快报"],
    "major_contract": ["重大合同", "中标", "订单", "合作协议"],
    "buyback": ["回购"],
    "equity_incentive": ["股权激励", "限制性股票", "股票期权", "员工持股", "激励计划"],
    "fundraising": ["募集资金", "定增", "向特定对象发行", "非公开发行", "可转换公司债券", "发行可转债"],
    "holding_change": ["增持", "减持", "权益变动", "持股.*变动"],
    "litigation_risk": ["诉讼", "仲裁", "风险提示"],
    "investment_project": ["对外投资", "项目进展", "投资项目"],
    "investor_relations": ["投资者关系活动记录", "调研活动", "业绩说明会"],
}
OTHER_CATEGORY = "other_high_value"

PERIOD_TERMS = {"q1": ["一季度", "Q1", "1Q", "first quarter"], "semiannual": ["半年度", "H1", "half year"], "q3": ["三季度", "Q3", "3Q", "third quarter"], "annual": ["年报", "annual", "10-K", "annual report"]}
QUESTION_METRICS = {"营业收入": ["营业收入", "revenue", "sales"], "净利润": ["净利润", "net profit", "net income"], "归母净利润": ["归母", "归属于上市公司股东的净利润", "attributable net profit"]}
MARKET_METRICS = {
    "pe": ["pe", "p/e", "市盈率"], "pb": ["pb", "p/b", "市净率"], "ps": ["ps", "p/s", "市销率"], "eps": ["eps", "每股收益"], "price": ["price", "股价", "价格"],
    "market_cap": ["market cap", "市值"], "valuation": ["valuation", "估值", "贵不贵", "高估", "低估"],
    "trend": ["trend", "chart", "technical", "k-line", "kline", "走势", "趋势", "技术指标", "k线"],
}
HINTS = {
    "summary": ["总结", "归纳", "概括", "梳理", "综述", "整理", "summary", "summarize", "recap", "overview"],
    "compare": ["compare", "vs", "versus", "对比", "比较", "相比"],
    "reasoning": ["why", "reason", "impact", "risk", "怎么看", "为什么", "原因", "影响", "风险", "贵不贵", "高估", "低估", "未来"],
    "news": ["news", "headline", "policy", "macro", "recent", "消息面", "新闻", "政策", "宏观", "近期", "舆情", "情绪"],
    "fresh": ["latest", "current", "today", "now", "recent", "最新", "当前", "今天", "近期", "现在"],
    "api": ["api", "实时", "美股", "行情", "股价", "关键数据"],
    "document": ["财报", "年报", "季报", "公告", "报告", "10-k", "10-q", "8-k", "filing", "annual report", "quarterly report", "transcript", "利润表", "资产负债表", "现金流量表"],
    "market": ["pe", "p/e", "pb", "p/b", "valuation", "market cap", "eps", "price", "trend", "technical", "chart", "估值", "市盈率", "股价", "走势", "趋势", "技术指标", "贵不贵", "高估", "低估"],
    "trend": ["trend", "technical", "chart", "k-line", "kline", "走势", "趋势", "技术指标", "k线"],
    "technical": ["technical", "技术指标", "k-line", "kline", "k线"],
    "policy": ["policy", "政策"],
    "macro": ["macro", "宏观"],
    "internal": ["memo", "research note", "研报"],
    "reason_news": ["消息", "新闻", "市场", "情绪", "recent", "news"],
}
INTENTS = ["fact", "summary", "compare", "reasoning", "chat"]
RICH_INTENTS = {"trend_analysis": "summary", "valuation_analysis": "reasoning", "risk_analysis": "reasoning", "news_monitoring": "summary"}

TICKER_STOPWORDS = [
    "A", "AN", "AND", "ARE", "AS", "AT", "BY", "FOR", "FROM", "IN", "IS", "IT", "OF", "ON", "OR", "THE", "TO", "VS", "PE", "PB", "PS", "PEG", "EPS", "ROE", "ROA",
    "DCF", "FCF", "EBIT", "EBITDA", "GDP", "CPI", "IPO", "ETF", "ADR", "API", "CEO", "CFO", "Q1", "Q2", "Q3", "Q4", "FY", "TTM", "LTM", "US", "CN", "HK",
]
INVALID_SYMBOLS = ["PE", "PB", "PS", "EPS", "ROE", "ROA", "Q1", "Q2", "Q3", "Q4"]

NEED_CAPABILITY = {
    "filing_fact": "filing_evidence", "document_evidence": "document_evidence", "live_market_data": "fresh_market_data", "valuation_metric": "valuation",
    "structured_metric": "structured_metrics", "company_profile": "profile", "price_trend": "price_trend", "technical_indicator": "technical_indicator",
    "market_index_data": "market_index_data", "news_event": "news", "policy_context": "policy", "macro_context": "macro", "internal_docs": "internal_docs",
}
REQUIREMENT_CAPABILITY = {
    "needs_filing_evidence": "filing_evidence", "needs_document_evidence": "document_evidence", "needs_fresh_market_data": "fresh_market_data",
    "needs_structured_metrics": "structured_metrics", "needs_news": "news", "needs_policy_context": "policy", "needs_macro_context": "macro",
    "needs_internal_docs": "internal_docs", "needs_market_index_data": "market_index_data", "needs_price_trend": "price_trend", "needs_technical_indicator": "technical_indicator",
}
#: name, tool, source, capabilities, authority, freshness, markets, asset types, identifier types, enabled, optional
SOURCES = [
    ("filings", "filing_search", "filings", ["filing_evidence", "document_evidence", "internal_docs", "historical_context"], 1.0, "filing", ["CN"], ["stock"], ["code", "cn_code"], True, False),
    ("market_data", "source_api", "source_api", ["fresh_market_data", "structured_metrics", "valuation", "profile", "market_index_data", "price_trend", "technical_indicator", "news", "fresh_public_context"], 0.85, "realtime", ["US", "HK", "GLOBAL"], ["stock", "etf", "index", "crypto", "forex"], ["symbol"], True, False),
    ("web_search", "web_search", "web_search", ["news", "policy", "macro", "fresh_public_context"], 0.6, "realtime", ["*"], ["*"], ["symbol", "code", "cn_code", "none"], True, True),
    ("sec_companyfacts", "sec_companyfacts", "filings", ["structured_metrics", "filing_evidence", "us_sec"], 0.95, "filing", ["US"], ["stock"], ["symbol", "sec_cik"], False, False),
    ("news_cache", "news_cache_search", "filings", ["news", "fresh_public_context"], 0.7, "near_realtime", ["*"], ["*"], ["symbol", "code", "cn_code", "none"], False, False),
    ("internal_research", "internal_research_search", "filings", ["internal_docs", "document_evidence"], 0.75, "internal", ["*"], ["*"], ["symbol", "code", "cn_code", "none"], False, False),
]
SOURCES_SCHEMA = "name string, tool string, source string, capabilities array<string>, authority double, freshness string, markets array<string>, asset_types array<string>, identifier_types array<string>, enabled boolean, optional boolean"

#: Market data routes in order: tool, terms, whether a symbol is needed (None: only without one), look-back days, limit, fallbacks.
ROUTES = [
    ("stock_search", ["ticker", "symbol", "代码", "股票代码"], None, 7, 5, []),
    ("basic_financials", ["pe", "p/e", "pb", "p/b", "ps", "p/s", "eps", "valuation", "market cap", "市盈率", "市净率", "市销率", "估值", "每股收益", "市值"], True, 7, 5, ["company_profile", "stock_price"]),
    ("price_target", ["price target", "target price", "analyst target", "目标价"], True, 30, 5, ["analyst_recommendations"]),
    ("analyst_recommendations", ["recommendation", "rating", "analyst view", "analyst", "评级", "分析师", "买入", "卖出", "持有"], True, 30, 5, ["price_target"]),
    ("company_news", ["news", "headline", "消息", "新闻", "消息面", "事件"], True, 14, 10, ["news_sentiment", "market_news"]),
    ("news_sentiment", ["sentiment", "情绪", "舆情"], True, 14, 5, ["company_news"]),
    ("technical_indicator", ["rsi", "macd", "sma", "ema", "technical", "技术指标"], True, 30, 10, ["stock_candles"]),
    ("stock_candles", ["trend", "chart", "k-line", "kline", "recent performance", "走势", "趋势", "k线", "历史价格"], True, 30, 10, ["stock_price"]),
    ("company_profile", ["profile", "company intro", "industry", "exchange", "公司介绍", "行业", "交易所"], True, 7, 5, ["stock_price"]),
    ("market_news", ["market news", "market headlines", "市场新闻", "大盘新闻"], False, 7, 10, []),
]
DEFAULT_ROUTE, NO_SYMBOL_ROUTE = "stock_price", "stock_search"
TOOLS_WITHOUT_SYMBOL = ["earnings_calendar", "market_news", "stock_symbols", "stock_search"]
VALUATION_KEYS = ["peTTM", "peBasicExclExtraTTM", "peNormalizedAnnual", "forwardPE", "pbAnnual", "pbQuarterly", "psTTM", "epsTTM", "epsBasicExclExtraItemsTTM", "marketCapitalization", "enterpriseValue", "52WeekHigh", "52WeekLow"]
FRESHNESS = {"announcement": 1.0, "q1": 0.65, "q3": 0.65, "semiannual": 0.65, "annual": 0.35, "other": 0.5}

# The scripts of the market service and their operations.
TOOLS = {
    "symbols.py": ["help", "search", "stock-symbols"],
    "stock_market.py": ["help", "quote", "candles", "profile", "peers"],
    "fundamentals.py": ["help", "metrics", "financials", "earnings", "dividends", "earnings-calendar"],
    "news.py": ["help", "company-news", "market-news", "sentiment"],
    "analyst.py": ["help", "recommendations", "price-target", "upgrades"],
    "technical.py": ["help", "indicator"],
}

# The labels of the lines before a chunk's text, the column of each, and what stands for a blank one.
HEADER_LINES = [
    ("公司", "company", ""), ("代码", "code", ""), ("行业", "industry", "未知"), ("文档类型", "doc_type", ""), ("报告类型", "report_type", ""),
    ("年份", "year", ""), ("发布日期", "publish_date", ""), ("来源类型", "source_type", "cninfo"), ("标题", "title", ""), ("章节", "section", ""),
    ("块类型", "chunk_type", ""), ("公告类别", "announcement_category", ""),
]
# Forms of a case's question.
CASE_QUESTIONS = [
    "{company} {year} {report_type} {terms}是多少？", "查询{company}{year}{report_type}报告中的{terms}",
    "{company}在{year}{report_type}的{terms}情况", "根据{company}{year}{report_type}{section}，{terms}是多少？",
]
