"""Logs, caches, case files, tool calls, vectors, chunk rows and cases."""

import json
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.catalogue import ORACLES, QUERIES
from ledgerloom.config import SearchConfig, from_environment
from ledgerloom.operators import chunking as K
from ledgerloom.operators import embedding as M
from ledgerloom.operators import evaluate as V
from ledgerloom.operators import stores as L
from ledgerloom.plans import rows as R
from ledgerloom.plans import tools


def test_paths_exist_or_not(spark, tmp_path):
    assert L.exists(spark, str(tmp_path)) and not L.exists(spark, str(tmp_path / "none"))


def test_only_new_files_are_parsed(spark, tmp_path):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, text string")
    parse = lambda n: lambda rows: rows.select("source_id", F.lit(n).alias("run"))
    cache = str(tmp_path / "cache")
    assert sorted(map(tuple, L.parsed_once(files.where("source_id = 1"), cache, parse(1)).collect())) == [(1, 1)]
    assert sorted(map(tuple, L.parsed_once(files, cache, parse(2)).collect())) == [(1, 1), (2, 2)]
    assert L.parsed_once(files.where("source_id > 5"), cache, parse(3)).count() == 0


def test_batches_of_columns(spark, tmp_path):
    folder = str(tmp_path)

    def send(columns):
        (Path(folder) / f"{min(columns['id'])}.json").write_text(json.dumps(columns))

    sent = L.column_batches(spark.range(25).select("id", F.lit("v").alias("v")).coalesce(1), 10, send)
    assert sorted(r.n for r in sent.collect()) == [5, 10, 10]
    assert sorted(i for p in Path(folder).glob("*.json") for i in json.loads(p.read_text())["id"]) == list(range(25))


def test_vectors_have_length_one(spark):
    rows = spark.createDataFrame([(1, "the cat"), (2, "The  CAT!"), (3, ""), (4, None), (5, "dog")], "id int, text string")
    got = {r.id: np.array(r.v) for r in rows.select("id", M.embedder(M.hashed(32))("text").alias("v")).collect()}
    assert np.allclose(got[1], got[2]) and np.isclose((got[5] ** 2).sum(), 1) and not got[3].any() and not got[4].any()


def test_text_vectors_agree_with_sql_on_short_texts(spark, tmp_path):
    by_place = {}
    for i in range(1000):
        h = crc32(f"w{i}".encode())
        by_place.setdefault(h % 64, {})[h >> 31] = f"w{i}"
    pair = next(p for p in by_place.values() if len(p) == 2)
    texts = [f"{pair[0]} {pair[1]}", f"{pair[1]}, {pair[0]}: {pair[0]}; {pair[1]}", pair[0], "é", "où", "漢字", "\u212a", "İ", "٣", "_", "a_", "K9é", "", None, " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["text_vectors"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.sql(ORACLES["text_vectors"]).fetchall())


@pytest.mark.parametrize(
    "raw, error, command",
    [
        ('{"script": "news.py", "operation": "sentiment", "args": {"a_b": 3, "c": true, "d": false, "e": null, "f": "false"}}', "", ["sentiment", "--a-b", "3", "--c", "--f", "false"]),
        ('{"script": "news.py", "operation": "help", "args": null}', "", ["help"]),
        ('{"script": "news.py", "operation": "help", "args": [1]}', "args must be an object", None),
        ('{"script": "news.py", "operation": "quote"}', "unsupported operation: quote", None),
        ('{"script": "os.py", "operation": "help"}', "unsupported script: os.py", None),
        ('{"script": "news.py"}', "missing operation", None),
        ("no json", "not JSON", None),
        (None, "not JSON", None),
    ],
)
def test_tool_calls(spark, raw, error, command):
    row = tools.checked(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row.error, row.command) == (error, command)


def test_settings_from_the_environment():
    got = from_environment(SearchConfig, {"LEDGERLOOM_TOP_K": " 9", "LEDGERLOOM_DECAY_DAYS": "30", "OTHER": "1"})
    assert (got.top_k, got.decay_days, got.rrf_k) == (9, 30.0, SearchConfig().rrf_k)
    with pytest.raises(ValueError, match="LEDGERLOOM_TOP_K"):
        from_environment(SearchConfig, {"LEDGERLOOM_TOP_K": "many"})


def test_chunk_rows(spark):
    chunks = spark.createDataFrame([("s", "s_000001", 1, "合并利润表", 2, "financial_statement", 3, 4, "营业收入 100 200\n净利润 30 20\n" + "说明" * 30), ("s", "s_000002", 2, "", 0, "paragraph", 1, 1, "short"), ("s", "s_000003", 3, None, 0, "image_reference", 1, 1, "![](a.png)")], K.CHUNKS)
    sources = spark.createDataFrame([("s", "report", "000001", None, 2025)], "source_id string, doc_type string, code string, company string, year int")
    got = {r.chunk_index: r for r in K.chunk_rows(chunks, sources).collect()}
    assert set(got) == {1, 3} and got[1].statement_type == "income_statement"
    lines = got[1].embed_text.split("\n")
    assert lines[:2] == ["公司：000001", "代码：000001"] and lines[2] == "行业：未知" and lines[12] == "页码：3-4" and lines[13] == "statement_type: income_statement"
    assert lines[15] == "statement_type: income_statement" and lines[16].startswith("metric_terms: 利润表 ") and got[1].text == got[1].embed_text
    assert got[1].raw_text.startswith("营业收入") and got[1].char_count == len(got[1].embed_text) and len(got[1].text_hash) == 64


def metric_rows(spark):
    rows = [(f"c{i}", "000001" if i < 4 else "000002", None, 2025, "annual", "report", "financial_statement", "利润表", "income_statement" if i != 3 else "", f"利润表 营业收入 term{i}", f"body {i}") for i in range(6)]
    return spark.createDataFrame(rows, "chunk_id string, code string, company string, year int, report_type string, doc_type string, chunk_type string, section string, statement_type string, metric_terms string, text string")


def test_cases_are_taken_in_turns(spark, tmp_path):
    chunks = metric_rows(spark)
    made = V.sampled(K.metric_chunks(chunks), 8, seed=1)
    cases = made.orderBy("attempt").collect()
    assert len(cases) == 8 and len({(c.question, tuple(c.positive_contexts)) for c in cases}) == 8
    assert len({c.seed_context for c in cases}) >= 5  # in turns: a seed comes again only after all others
    held = {r.chunk_id: r for r in chunks.collect()}
    for c in cases:
        own = held[c.seed_context]
        want = [i for i, r in sorted(held.items()) if r.code == own.code and (not own.statement_type or r.statement_type == own.statement_type) and any(t in r.metric_terms for t in c.metric_terms)]
        assert sorted(c.positive_contexts) == want and c.seed_context in c.positive_contexts
        assert 1 <= len(c.metric_terms) <= 2 and "利润表" not in c.metric_terms and own.code in c.question
    assert [tuple(c) for c in V.sampled(K.metric_chunks(chunks), 8, seed=1).orderBy("attempt").collect()] == [tuple(c) for c in cases]
    L.case_file(made, str(tmp_path / "cases"))
    lines = [json.loads(x) for p in (tmp_path / "cases").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["question"] for x in lines] == [c.question for c in cases] and "attempt" not in lines[0]


def test_no_cases_of_no_chunks(spark):
    assert V.sampled(metric_rows(spark).where("code = 'none'"), 5).count() == 0


def test_cases_meet_their_own_filters_once(spark):
    """Filters that are null, empty or hold quotes are told apart, and no case is searched twice."""
    values = [None, "", "it's", 'a "b"', "back\\slash"]
    cases = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "question_id int, code string")
    rows = R.overridden(cases.withColumn("metadata_filter", F.create_map(F.lit("code"), F.col("code"))))
    got = R.per_case(lambda own, filters: own.select("question_id", F.lit(str(filters.get("code"))).alias("f")), rows).collect()
    assert sorted((r.question_id, r.f) for r in got) == [(0, "None"), (1, "None"), (2, "it's"), (3, 'a "b"'), (4, "back\\slash")]
