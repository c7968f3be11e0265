"""Operators on rows given here."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import rules
from ledgerloom.config import ChunkConfig, ContextConfig, SearchConfig
from ledgerloom.operators import chunking as K
from ledgerloom.operators import evaluate as V
from ledgerloom.operators import evidence as E
from ledgerloom.operators import facts as Fx
from ledgerloom.operators import maintain as M
from ledgerloom.operators import recall as R
from ledgerloom.operators import search as S
from ledgerloom.plans import analyze as A
from ledgerloom.plans import pipeline as Pipe
from ledgerloom.plans import route as P
from ledgerloom.sources import filings
from ledgerloom.streaming import ingest


def test_rrf_and_freshness(spark):
    row = spark.range(1).select(S.rrf(F.lit(1)).alias("a"), S.rrf(F.lit(None).cast("int")).alias("b"), S.freshness(F.lit("2025-07-05"), F.lit(0.35), SearchConfig(as_of="2026-01-01")).alias("c"), S.freshness(F.lit("2026-02-01"), F.lit(1.0), SearchConfig(as_of="2026-01-01")).alias("d"), S.freshness(F.lit(""), F.lit(1.0), SearchConfig()).alias("e")).first()
    assert row.a == pytest.approx(0.0163934426) and row.b == 0
    assert row.c == pytest.approx(0.35 * 2.718281828459045**-1) and row.d == 1 and row.e == 0


def test_source_limits():
    assert SearchConfig().source_limit() == 2 and SearchConfig(per_source_limit=4).source_limit() == 4
    assert SearchConfig(filters={"code": "1", "year": 2025, "report_type": "q1"}).source_limit() == 8


def test_bm25_prefers_rare_terms_and_short_chunks(spark):
    c = spark.createDataFrame([(1, "rare word"), (2, "rare word with many more words in it"), (3, "word"), (4, "word"), (5, None)], "chunk_id int, text string")
    q = spark.createDataFrame([(1, ["rare", "word"])], "question_id int, terms array<string>")
    assert [r.id for r in S.ranked(S.bm25(c, q), "bm25", "rank").orderBy("rank").collect()][:2] == [1, 2]


def test_hybrid_with_filters(spark):
    rows = [(str(i), f"s{i % 2}", "营业收入 增长" if i < 3 else "other text", "", 300750 if i != 1 else 1, "2025-12-01") for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_pdf string, text string, section string, code int, publish_date string")
    vectors = spark.createDataFrame([(str(i), [1.0, 0.0] if i == 0 else [0.0, 1.0]) for i in range(6)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, "营收 增长", [1.0, 0.0])], "question_id int, question string, vector array<float>")
    out = S.hybrid(chunks, vectors, q, SearchConfig(filters={"code": 300750}, per_source_limit=2)).orderBy("rank").collect()
    assert out[0].id == "0" and out[0].found_by == ["dense", "sparse"] and "1" not in {r.id for r in out}
    assert len([r for r in out if int(r.id) % 2 == 0]) <= 2


def test_approximate_search_finds_the_nearest(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = list(e.where("vec_id = 7").first()["embedding"])
    near = {r.id for r in S.approximate_dense(e, q, 10, "vec_id").collect()}
    exact = {r.vec_id for r in e.withColumn("d", S.dot("embedding", F.array(*map(F.lit, q)))).orderBy(F.col("d").desc()).limit(10).collect()}
    assert len(near & exact) >= 9


def test_recall_relaxes_only_when_nothing_is_found(spark):
    c = spark.createDataFrame([("a", "1", "X Corp", 2025, "q1", 1.0, "2025-01-01"), ("b", "2", "Y", 2024, "q3", 0.5, "2024-01-01"), ("", "1", "X", 2025, "q1", 1.0, "2025")], "source_pdf string, code string, company string, year int, report_type string, source_authority_score double, publish_date string")
    names = lambda **k: [r.source_pdf for r in R.recall(c, ["publish_date"], **k).orderBy("rank").collect()]
    assert names(code="1") == ["a"] and names(company="x c") == ["a"] and names(code="9") == ["a", "b"] and names() == ["a", "b"]


def test_like_takes_signs_as_they_are(spark):
    d = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("acb",)], "t string")
    assert [r.t for r in d.where(R.like("t", "50%")).collect()] == ["50% off"]
    assert [r.t for r in d.where(R.like("t", "A_B")).collect()] == ["a_b"]


def test_facts(spark):
    body = "单位：万元\n营业收入 | 1,234.5 | 1,000\n归属于上市公司股东的净利润 | 99\n加权平均净资产收益率 不适用\n存货"
    c = spark.createDataFrame([("c1", body), ("c2", None)], "chunk_id string, text string")
    rows = Fx.chunk_facts(c, F.col("text")).orderBy("fact_no").collect()
    assert [(r.metric_name, r.metric_value, r.unit) for r in rows] == [("营业收入", "1234.5", "万元"), ("归母净利润", "99", "万元"), ("加权平均净资产收益率", "", "万元")]
    assert rows[0].fact_id == "c1_0001_营业收入"


def test_metric_values(spark):
    body = "项目 | 本期\n扣除非经常性损益的净利润 | 5\n归属于上市公司股东的净利润 | 7\n净利润 | 9\n营业收入  1,000"
    row = spark.range(1).select(*(Fx.metric_value(F.lit(body), m).alias(m) for m in ("净利润", "归母净利润", "营业收入")), Fx.metric_value(F.lit("revenue rose to 12.5%"), "营业收入").alias("text"), Fx.metric_value(F.lit("净利润 扣非 8"), "净利润").alias("none")).first()
    assert tuple(row) == ("9", "7", "1,000", "12.5%", "")


def test_ledger_and_first_facts(spark):
    rows = [(1, 1, "a", "净利润 | 3", 0.1), (1, 2, "a", "dup", 0.9), (1, 3, "b", "净利润 | 4", 0.5), (1, 4, "c", "x", 0.2)]
    e = spark.createDataFrame(rows, "question_id int, seq int, chunk_id string, content string, score double")
    out = E.ledger(e, F.col("chunk_id"), "score", "seq", top=2)
    assert [(r.chunk_id, r.rank) for r in out.orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    facts = Fx.first_facts(E.ledger(e, F.col("chunk_id"), "score", "seq"), ["净利润"], carry=("chunk_id",)).collect()
    assert [(f.metric, f.value, f.chunk_id) for f in facts] == [("净利润", "4", "b")]


def test_context_skips_what_does_not_fit(spark):
    e = spark.createDataFrame([(1, 1, "a" * 2000), (1, 2, "b" * 2000), (1, 3, "c" * 500)], "question_id int, rank int, content string")
    row = E.context(e, ContextConfig(token_budget=10, snippet_chars=5000)).first()
    assert row.dropped == [2] and "ccc" in row.context_text and "b" not in row.context_text


def test_cut_off(spark):
    e = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")], "q int, n int, t string")
    assert [r.t for r in E.cut_off(e, "t", 6, ["q"], ["n"]).orderBy("n").collect()] == ["aaaa", "bb"]


def test_legacy_number_check(spark):
    row = spark.range(1).select(E.has_number(F.lit("12345"), F.lit("234")).alias("a"), E.has_number(F.lit("12345"), F.lit("234"), legacy=True).alias("b"), E.has_number(F.lit("x"), F.lit("")).alias("c")).first()
    assert tuple(row) == (False, True, False)


def test_upsert_and_absent_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 1, 10)], "k int, v string, version int, created int")
    new = spark.createDataFrame([(2, "c", 2, 20), (3, "d", 2, 20)], "k int, v string, version int, created int")
    once = M.upserted(old, new, ["k"], "version", "created")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1, 10), (2, "c", 2, 10), (3, "d", 2, 20)]
    assert sorted(map(tuple, M.upserted(once, new, ["k"], "version", "created").collect())) == sorted(map(tuple, once.collect()))
    added = M.absent(new.unionByName(new), old, [["k"], ["v"]], ["version"])
    assert [r.k for r in added.collect()] == [3]
    done = M.checkpointed(spark.createDataFrame([], "c string, m string, k int, indexed_at int"), new, "k", F.lit(5), c="x", m="y")
    assert M.unindexed(new, done, "k", c="x", m="y").count() == 0 and M.unindexed(new, done, "k", c="x", m="z").count() == 2


def test_evolved_and_backfilled(spark):
    df = spark.createDataFrame([(1, ""), (2, "x")], "k int, v string")
    out = M.backfilled(M.evolved(df, {"w": "double"}), {"v": F.lit("new")})
    assert sorted(map(tuple, out.collect())) == [(1, "new", None), (2, "x", None)]


@pytest.mark.parametrize("text", ["", "short", "一" * 5000, ("句子。" * 40 + "\n\n") * 30, "x" * 1399 + "。" + "y" * 3000])
def test_split_covers_the_text(text):
    parts = K.split(text, 1400, 180)
    assert all(len(p) <= 1400 for p in parts)
    assert set("".join(text.split())) <= set("".join("".join(parts).split())) if text else parts == []
    assert sum(len(p) for p in parts) >= len(text.strip()) - 2 * len(parts) - text.count("\n")


def test_cut_ends_at_stops_and_overlaps():
    parts = K.cut("a" * 1000 + "。" + "b" * 1000, 1400, 180)
    assert parts[0].endswith("。") and parts[1].startswith("a" * 179)
    with pytest.raises(ValueError):
        ChunkConfig(report_chars=300)


def test_report_chunks(spark):
    page1 = "第三节 管理层讨论与分析\n" + "公司经营情况良好，收入稳步增长，利润水平持续提升，未来可期。\n" * 5 + "12\n![图](a.png)\n"
    page2 = "财务报表\n单位：元\n营业收入 1,000.00\n净利润 200.00\n每股收益 0.10\n" + "营业成本 10.00\n营业利润 5.00\n" * 4
    pages = spark.createDataFrame([("s1", 1, page1), ("s1", 2, page2), ("s2", 1, "")], "source_id string, page_no int, text string")
    rows = K.chunk_reports(pages).orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.section, r.page_start) for r in rows] == [("management_discussion", "管理层讨论与分析", 1), ("image_reference", "管理层讨论与分析", 1), ("financial_statement", "合并利润表", 2)]
    assert rows[1].text.endswith("a.png") and [r.chunk_index for r in rows] == [1, 2, 3]


def test_announcement_chunks(spark):
    body = "证券代码：600519\n" + "公司拟以自有资金回购股份，用于员工持股计划或者股权激励。" * 300 + "\n特此公告。\n2025年1月2日"
    rows = K.chunk_announcements(spark.createDataFrame([("a", 1, body)], "source_id string, page_no int, text string")).collect()
    assert 1 < len(rows) <= 5 and all(60 <= len(r.text) <= 2600 and "特此公告" not in r.text for r in rows)


def test_repair(spark):
    bad = "营业收入增长".encode().decode("latin1")
    df = spark.createDataFrame([(1, bad), (2, "plain"), (3, None), (4, "")], "k int, t string")
    assert [r.t for r in df.select("k", K.repaired(F.col("t")).alias("t")).orderBy("k").collect()] == ["营业收入增长", "plain", None, ""]


def test_needs_and_requirements(spark):
    q = spark.createDataFrame([(1, "苹果公司现在的PE是多少？"), (2, "宁德时代2026年一季度归母净利润"), (3, "macro policy"), (4, "最近的新闻")], "question_id int, question string")
    m = A.master_of(spark, [("company", "Apple", ["苹果"], "AAPL", "", "US", "stock"), ("company", "CATL", ["宁德时代"], "", "300750", "CN", "stock")])
    r = A.lexical(q).withColumn("symbol", F.lit(""))
    e = A.entities(r, m)
    needs = A.evidence_needs(r, e)
    assert sorted((n.question_id, n.company, n.need_type) for n in needs.collect() if n.company) == [(1, "Apple", "valuation_metric"), (2, "CATL", "filing_fact")]
    assert sorted((n.question_id, n.need_type) for n in needs.collect() if not n.company) == [(3, "news_event"), (4, "news_event")]
    flags = {f.question_id: f for f in A.requirements(r, e, needs).collect()}
    assert flags[1].needs_fresh_market_data and not flags[1].needs_filing_evidence
    assert flags[2].needs_filing_evidence and flags[3].needs_policy_context and flags[3].needs_macro_context and flags[4].needs_news


def test_semantic_reply(spark):
    row = spark.range(1).select(A.parsed_semantics(F.lit('ok: {"intent": "risk_analysis", "confidence": 0.8, "metrics": ["净利润"]}')).alias("s")).select(A.intent(F.lit("x"), F.col("s.intent"), F.col("s.confidence")).alias("i"), F.col("s.metrics").alias("m")).first()
    assert tuple(row) == ("reasoning", ["净利润"])


@pytest.mark.parametrize("question, symbol, tool", [("苹果公司现在的PE是多少？", "AAPL", "basic_financials"), ("What is Tesla current stock price?", "TSLA", "stock_price"), ("总结一下英伟达最近的消息面", "NVDA", "company_news"), ("苹果的目标价是多少？", "AAPL", "price_target"), ("苹果RSI是多少？", "AAPL", "technical_indicator"), ("MACD of it", "X", "technical_indicator")])
def test_routes(spark, question, symbol, tool):
    r = spark.range(1).select(P.route(F.lit(question), F.lit(symbol)).alias("r")).first().r
    assert r.tool == tool and (r.indicator == "macd") == ("MACD" in question)


def test_tool_plan_falls_back_to_requirements(spark):
    needs = spark.createDataFrame([(1, 1, "filing_fact", "", "300750", "CN", "stock"), (2, 2, "filing_fact", "AAPL", "", "US", "stock")], "question_id int, need_id int, need_type string, symbol string, code string, market string, asset_type string")
    flags = spark.createDataFrame([(1, True, False), (2, True, True)], "question_id int, needs_answer boolean, needs_news boolean").withColumns({k: F.lit(False) for k in rules.REQUIREMENT_CAPABILITY if k != "needs_news"})
    rows = sorted((r.question_id, r.source_name or "", r.planned) for r in P.tool_plan(needs, flags, P.registry(spark)).collect())
    assert rows == [(1, "filings", True), (2, "", False), (2, "market_data", True)]


def test_legacy_override(spark):
    df = spark.createDataFrame([("600519 how",), ("茅台年报",), ("茅台",)], "q string")
    assert [r.p for r in df.select(P.legacy_override(F.col("q"), F.array(F.lit("api"))).alias("p")).collect()] == [["filings"], ["filings"], ["api"]]


def test_question_to_answer_with_a_retry(spark):
    q = spark.createDataFrame([(1, "净利润?"), (2, "x")], "question_id long, question string")
    contracts = spark.createDataFrame([(1, ["净利润"], True, True), (2, [], False, False)], "question_id long, must_answer array<string>, numeric_check boolean, citation_required boolean")

    def filings_source(asked):
        return asked.select("question_id", F.when(F.col("question").contains("annual"), "净利润 | 42").otherwise("nothing").alias("content"), F.lit("c").alias("citation"), F.col("question").alias("chunk_id"), F.lit(1.0).alias("score"))

    def broken(asked):
        raise RuntimeError("down")

    plan = lambda asked: asked.select("question_id", F.explode(F.array(F.lit("filings"), F.lit("market_data"))).alias("source_name"))
    rewrite = lambda asked: asked.withColumn("question", F.concat("question", F.lit(" annual")))
    run = Pipe.answered(q, plan, {"filings": filings_source, "market_data": broken}, Pipe.extractive, contracts, ["净利润"], rewrite)
    assert {r.question_id: r.next_action for r in run.checks.collect()} == {1: "end", 2: "end"}
    assert [t["status"] for t in run.trace if t["step"] == "source:market_data"] == ["failed", "failed"]
    once = Pipe.answered(q, plan, {"filings": filings_source}, Pipe.extractive, contracts, ["净利润"])
    assert {r.question_id: r.next_action for r in once.checks.collect()} == {1: "retrieve_more", 2: "end"}


def test_branch_and_run_id(spark):
    from datetime import datetime

    chat, rest = Pipe.branch(spark.createDataFrame([(1, "chat"), (2, "fact")], "question_id int, intent string"))
    assert (chat.count(), rest.count()) == (1, 1) and Pipe.run_id(datetime(2025, 1, 2, 3, 4, 5, 6)) == "20250102_030405_000006"


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, [10, 11]), (2, [20]), (3, [30])], "case_id int, positives array<int>")
    hits = spark.createDataFrame([(1, 10, 2), (1, 99, 1), (2, 20, 1), (3, 5, 1)], "case_id int, id int, rank int")
    s = V.summary(V.graded(cases, hits), 5).first()
    assert (s.n_cases, round(s.hit_at_1, 4), round(s.hit_at_k, 4), s.mrr) == (3, 0.3333, 0.6667, 0.5)
    top = spark.createDataFrame([("a", "a"), ("b", "c"), ("", "x")], "expected string, got string")
    assert V.expectation_rate(top, "expected", "got").first().rate == 0.5 and V.expectation_rate(top.where("false"), "expected", "got").first().rate == 0


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿industry,code,company\nbank, 1 ,A\nbank,,B\n", encoding="utf-8")
    assert [(r.code, r.company) for r in filings.companies(spark, str(tmp_path / "c.csv")).collect()] == [("000001", "A")]
    (tmp_path / "e.jsonl").write_text('{"question": "q", "positive_contexts": ["a"], "metadata_filter": {"code": "1", "year": 2026}}\n\n')
    case = filings.eval_cases(spark, str(tmp_path / "e.jsonl")).first()
    assert case.metadata_filter.year == 2026 and case.positive_contexts == ["a"]
    items = spark.createDataFrame([("600519", "<em>茅台</em>2024年年度报告", "u1", "1", 1743465600000), ("600519", "茅台2024年年度报告", "u2", "2", 1743552000000), ("600519", "2024年年度报告摘要", "u3", "3", 1743552000000), ("600519", "关于回购股份的公告", "u4", "4", 1743552000000)], "secCode string, announcementTitle string, adjunctUrl string, announcementId string, announcementTime long")
    got = filings.report_candidates(items).collect()
    assert [(r.year, r.report_type, r.source_url) for r in got] == [(2024, "annual", "u2")]
    assert [(r.announcement_category, r.matched_keywords) for r in filings.announcements(items).collect()] == [("buyback", "回购")]


def test_pages(spark):
    tree = {"kids": [{"type": "heading", "page number": 1, "heading level": 9, "content": "T"}, {"type": "header", "page number": 1, "content": "no"}, {"type": "paragraph", "page number": 2, "content": "p"}, {"type": "table", "page number": 2, "rows": [{"cells": [{"content": "a"}, {"content": "b"}]}, {"cells": [{"content": "c"}]}]}]}
    rows = filings.tree_pages(spark.createDataFrame([("s", json.dumps(tree)), ("t", None)], "source_id string, json string")).orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in rows] == [(1, "###### T"), (2, "p\n\n| a | b |\n| --- | --- |\n| c |  |")]
    md = "{0}" + "-" * 20 + "\none\n{1}" + "-" * 24 + "\ntwo\n"
    rows = filings.markdown_pages(spark.createDataFrame([("s", md), ("t", "plain")], "source_id string, text string")).orderBy("source_id", "page_no").collect()
    assert [(r.source_id, r.page_no, r.text) for r in rows] == [("s", 1, "one"), ("s", 2, "two"), ("t", 1, "plain")]


def test_chosen_text(spark):
    row = spark.range(1).select(filings.chosen_text([F.lit("x"), F.lit("y" * 600), F.lit("z")]).alias("a"), filings.chosen_text([F.lit("x"), F.lit(None).cast("string"), F.lit("z")]).alias("b")).first()
    assert row.a == "y" * 600 and row.b == "z"


class Service(filings.PagedSource):
    fetch = staticmethod(lambda company, page, size: [f"{company}{page}{i}" for i in range(size if page < 3 else 1)])


def test_paged_source(spark):
    spark.dataSource.register(Service)
    rows = spark.read.format("paged_service").option("companies", "a,b").option("page_size", "2").load().collect()
    assert len(rows) == 10 and max(r.page for r in rows) == 3
    assert spark.read.format("paged_service").option("companies", "a").option("page_size", "2").option("max_pages", "1").load().count() == 2


def test_stream_takes_files_once(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int").coalesce(1).write.parquet(source)
    go = lambda: ingest.ingest(spark, source, "k int, v string, n int", target, check, ["k"], "n").awaitTermination()
    go()
    spark.createDataFrame([(2, "d", 1), (3, "e", 1)], "k int, v string, n int").coalesce(1).write.mode("append").parquet(source)
    go()
    go()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(target).select("k", "v").collect()
    assert sorted(map(tuple, rows)) == [(1, "a"), (2, "c"), (3, "e")]


def test_sources_for_questions(spark):
    chunks = spark.createDataFrame([(1, "a.pdf", "revenue grew", "2025-01-01", 1.0), (2, "b.pdf", "costs fell", "2024-01-01", 0.5)], "chunk_id int, source_pdf string, text string, publish_date string, source_authority_score double")
    q = spark.createDataFrame([(1, "how did revenue do", ""), (2, "zzz", "AAPL")], "question_id int, question string, symbol string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "chunk_id int, embedding array<double>")
    embed = lambda asked: asked.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    rows = Pipe.filings_source(chunks, vectors, embed, config=SearchConfig(top_k=1))(q).collect()
    assert {(r.question_id, r.citation) for r in rows} == {(1, "a.pdf"), (2, "b.pdf")}
    payloads = spark.createDataFrame([("stock_price", "AAPL", '{"c": 1}')], "tool string, symbol string, payload string")
    assert [(r.question_id, r.citation) for r in Pipe.market_source(payloads)(q).collect()] == [(2, "stock_price/AAPL")]


def test_absent_is_insertion_row_by_row(spark):
    """Two unique keys: a row that is turned away bars no other."""
    schema = "id string, h string, at int"
    old = spark.createDataFrame([("x0", "h9", 0)], schema)
    new = [("a", "h9", 1), ("a", "h1", 2), ("b", "h1", 3), ("b", "h2", 4), ("c", "h2", 5), ("c", "h3", 6), ("c", "h3", 6), ("d", "h9", 7)]
    seen, want = [({"x0"}), ({"h9"})], []
    for r in sorted(new, key=lambda r: r[2]):
        if r[0] not in seen[0] and r[1] not in seen[1]:
            want.append(r)
            seen[0].add(r[0])
            seen[1].add(r[1])
    got = M.absent(spark.createDataFrame(new, schema), old, [["id"], ["h"]], ["at"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["id", "h", "at"]
    assert M.absent(got.limit(0), old, [["id"], ["h"]], ["at"]).count() == 0


def test_upsert_of_equal_versions_takes_the_new_row(spark):
    row = lambda v: spark.createDataFrame([("k", 1, v)], "k string, version int, v string")
    assert M.upserted(row("old"), row("new"), ["k"], "version").first().v == "new"


def test_each_question_recalls_by_what_it_names(spark):
    rows = [(c, "cat", code, company, year, kind, 1.0, f"{year}-03-01") for c, code, company, year, kind in (("a24", "000001", "Alpha Ltd", 2024, "annual"), ("a25", "000001", "Alpha Ltd", 2025, "annual"), ("b25", "000002", "Beta Ltd", 2025, "q1"))]
    c = spark.createDataFrame(rows, "source_pdf string, text string, code string, company string, year int, report_type string, source_authority_score double, publish_date string")
    q = spark.createDataFrame([(1, "000001", "", 0, ""), (2, "", "beta", 0, ""), (3, "000001", "", 2025, ""), (4, "000009", "", 0, ""), (5, "", "", 0, "")], "question_id long, code string, company string, year int, period string")
    got = {}
    for r in R.recall_each(c, q, ["publish_date"], 2).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.source_pdf)
    assert got == {1: ["a25", "a24"], 2: ["b25"], 3: ["a25"], 4: ["a25", "b25"], 5: ["a25", "b25"]}


def test_filings_of_two_companies(spark):
    """The same words in both companies' filings: each question gets its own company's."""
    rows = [(f"{code}-{i}", f"{code}.pdf", f"profit of the year grew {i}", code, f"C{code}", 2025, "annual", 1.0, "2025-01-01") for code in ("300750", "600519") for i in range(3)]
    c = spark.createDataFrame(rows, "chunk_id string, source_pdf string, text string, code string, company string, year int, report_type string, source_authority_score double, publish_date string")
    asked = spark.createDataFrame([(1, "profit of 300750 in the year"), (2, "profit of 600519 in the year")], "question_id long, question string")
    got = Pipe.filings_source(c)(asked).collect()
    assert {(r.question_id, r.citation) for r in got} == {(1, "300750.pdf"), (2, "600519.pdf")}


def test_a_source_that_fails_at_work_is_left_out(spark):
    asked = spark.createDataFrame([(1, "q")], "question_id long, question string")
    plan = asked.select("question_id", F.explode(F.array(F.lit("good"), F.lit("bad"))).alias("source_name"))
    rows = lambda q, body: q.select("question_id", body.alias("content"), F.lit("c").alias("citation"), F.lit("").alias("chunk_id"), F.lit(1.0).alias("score"))
    trace = []
    out = Pipe.gathered(asked, plan, {"good": lambda q: rows(q, F.lit("text")), "bad": lambda q: rows(q, F.raise_error(F.lit("broken")).cast("string"))}, trace)
    assert [r.content for r in out.collect()] == ["text"]
    assert [(t["step"], t["status"], t["evidence"]) for t in trace] == [("source:good", "success", 1), ("source:bad", "failed", 0)] and "broken" in trace[1]["failure"]


def test_index_gives_the_scans_scores(spark, tmp_path):
    c = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common {'x ' * (i % 4)}") for i in range(40)] + [(90, None), (91, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, ["w1", "common"]), (2, ["x", "none"]), (3, [])], "question_id long, terms array<string>")
    index = S.TextIndex.build(c, str(tmp_path / "index"))
    rows = lambda df: sorted((r.question_id, r.id, round(r.bm25, 9)) for r in df.collect())
    assert rows(S.bm25(index, q)) == rows(S.bm25(c, q)) == rows(S.TextIndex.open(spark, str(tmp_path / "index")).search(q))


def test_passages_are_found_by_their_rarest_token(spark):
    texts = [(1, "the cat sat on the mat"), (2, "Xthe cat sat onY the"), (3, "THE CAT SAT ON"), (4, None), (5, "a b")]
    passages = [(10, "the cat sat on"), (11, "cat"), (12, ""), (13, None), (14, "no such words at all"), (15, "b")]
    got = V.containing(spark.createDataFrame(texts, "d long, t string"), spark.createDataFrame(passages, "p long, x string"), "d", "t", "p", "x")
    want = {(p, d) for p, x in passages if x is not None for d, t in texts if t is not None and x in t}
    assert {(r.p, r.d) for r in got.collect()} == want
