"""Scalar functions and classification against rows given here."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import rules
from ledgerloom.functions import classify as C
from ledgerloom.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "made, want",
    [
        (lambda: X.numbers(F.lit("12345.67"), rules.NUMBER_GROUPED), ["123", "45.67"]),
        (lambda: X.numbers(F.lit("1,234,567.89"), rules.NUMBER_GROUPED), ["1234567.89"]),
        (lambda: X.numbers(F.lit("-5.2%"), rules.NUMBER_GROUPED), ["-5.2%"]),
        (lambda: X.numbers(F.lit("12345.67 x"), rules.NUMBER), ["12345.67"]),
        (lambda: X.squeeze(F.lit(" a　b\n")), "ab"),
        (lambda: X.normalised(F.lit("　a \t b\n\n\n\nc ")), "a b\n\nc"),
        (lambda: X.heading(F.lit("## **第一节** 重要事项<br/>")), "第一节 重要事项"),
        (lambda: X.without_tags(F.lit("<em>a</em> b")), "a b"),
        (lambda: X.file_part(F.lit('a/b: "c"')), "a_b_c"),
        (lambda: X.token_estimate(F.lit("a")), 1),
        (lambda: X.six_digit_code(F.lit("1234567 600519,")), "600519"),
        (lambda: X.year_in(F.lit("in 2025")), "2025"),
        (lambda: X.ticker(F.lit("the PE of $NVDA"), rules.TICKER_STOPWORDS), "NVDA"),
        (lambda: X.ticker(F.lit("ticker: aapl"), rules.TICKER_STOPWORDS), "AAPL"),
        (lambda: X.ticker(F.lit("IS THE PE"), rules.TICKER_STOPWORDS), ""),
        (lambda: X.trimmed(F.lit("abc  def"), 5), "abc\n...[truncated]"),
        (lambda: X.cells(F.lit("| a | b ||")), ["a", "b"]),
        (lambda: X.json_object(F.lit('```json\n{"a": 1}\n```')), '{"a": 1}'),
        (lambda: X.years(F.lit("2023-2025, 2027,2024")), [2023, 2024, 2025, 2027]),
        (lambda: X.clamped(F.lit(0), 5, 20), 5),
        (lambda: X.clamped(F.lit(50), 5, 20), 20),
        (lambda: X.clamped(F.lit(-3), 5, 20), 1),
        (lambda: X.says_yes(F.lit(" Yes.")), True),
        (lambda: X.first_of(F.lit(None).cast("string"), F.lit(""), F.lit("b")), "b"),
        (lambda: X.cjk_count(F.lit("a营b业")), 2),
        (lambda: X.published(F.lit(1700000000000)), "2023-11-14"),
        (lambda: X.any_in(F.lit("The LATEST"), ["latest"]), True),
        (lambda: C.statement_type(F.lit("合并利润表"), F.lit("")), "income_statement"),
        (lambda: C.statement_type(F.lit(""), F.lit("存货 货币 资金")), "balance_sheet"),
        (lambda: C.statement_type(F.lit(""), F.lit("存货")), ""),
        (lambda: C.metric_terms(F.lit("利润表"), F.lit("净利润 营业收入")), "利润表 营业收入 净利润"),
        (lambda: C.categories(F.lit("关于回购股份及股权激励的公告")), ["buyback", "equity_incentive"]),
        (lambda: C.categories(F.lit("其他")), ["other_high_value"]),
        (lambda: C.high_value_terms(F.lit("重大合同中标")), ["中标", "重大合同"]),
        (lambda: C.report_type(F.lit("某公司2025年半年度报告全文")), "semiannual"),
        (lambda: C.report_type(F.lit("某公司2025年年度报告")), "annual"),
        (lambda: C.report_type(F.lit("某公司2025年年度报告摘要")), ""),
        (lambda: C.table_like(F.lit("营业收入 1.0\n净利润 2.0\n其他")), True),
        (lambda: C.table_like(F.lit("营业收入 1.0\n净利润 2.0")), False),
        (lambda: C.chunk_type(F.lit("report"), F.lit("风险因素"), F.lit("a"), F.lit("paragraph")), "risk_item"),
        (lambda: C.section_by_body(F.lit("财务报表"), F.lit("营业利润 净利润")), "合并利润表"),
        (lambda: C.clean_lines(F.lit("12\n目录......5\n正文\n证券代码：600519"), announcement=True), ["正文"]),
        (lambda: C.freshness_weight(F.lit("report"), F.lit("annual")), 0.35),
    ],
)
def test_value(one, made, want):
    assert one(made()) == want


def test_headings(spark):
    rows = spark.createDataFrame([("第三节 管理层讨论与分析",), ("一、风险因素",), ("风险因素",), ("本节风险因素很多",), ("（二）研发投入情况",), ("x" * 60,)], "line string").withColumn("bare", X.heading("line"))
    got = [r.s and tuple(r.s) for r in rows.select(C.section_heading(F.col("bare")).alias("s")).collect()]
    assert got == [("管理层讨论与分析", 1), ("风险因素", 2), ("风险因素", 2), None, ("研发投入", 2), None]


def test_dates(one):
    for s in ("2025-03-04", "2025/03/04", "20250304", " 2025-03-04T10:00"):
        assert str(one(X.parsed_date(F.lit(s)))) == "2025-03-04"
    assert one(X.parsed_date(F.lit("soon"))) is None
