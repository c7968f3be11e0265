"""The rows between the steps of answering, over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import rows as R
from .base import query, t

DOC = "SELECT d.doc_id AS question_id, coalesce(nullif(source, ''), 'Milvus') AS source, CAST(d.doc_id AS VARCHAR) AS chunk_id, coalesce(lang, '') AS section, coalesce(CAST(n_chars AS INTEGER), 0) AS page_end, round_even(n_chars / 7.0::DOUBLE, 4) AS hybrid_score, coalesce(text, '') AS content FROM documents d"


def candidates(spark, sf):
    d = t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("id"), F.col("source").alias("source_pdf"), "text", F.col("lang").alias("section"), F.col("n_chars").alias("page_end"), F.lit(0.25).alias("dense"), F.lit(0.5).alias("sparse"), (F.col("n_chars") / 7.0).alias("final"))


@query(DOC)
def candidate_documents(spark, sf):
    return R.document(candidates(spark, sf)).select("question_id", "metadata.source", "metadata.chunk_id", "metadata.section", "metadata.page_end", "metadata.hybrid_score", "content")


@query(f"SELECT question_id, 'milvus' AS source_name, source AS citation, '' AS as_of_date, 0.25::DOUBLE AS dense, hybrid_score AS hybrid, CAST(3 AS INTEGER) AS n_scores FROM ({DOC})")
def document_evidence(spark, sf):
    e = R.evidence(R.document(candidates(spark, sf)), "document", "milvus", 0.8)
    return e.select("question_id", "source_name", "citation", "as_of_date", F.col("scores")["dense"].alias("dense"), F.col("scores")["hybrid"].alias("hybrid"), F.size("scores").alias("n_scores"))


@query("SELECT doc_id, coalesce(lang, 'xx') AS company, coalesce(source, 'S1') AS symbol, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.7 END::DOUBLE AS authority_score, 0.5::DOUBLE AS freshness_score, '' AS statement_type FROM documents")
def evidence_defaults(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("company"), F.col("source").alias("symbol"))
    out = R.enriched(d, {"company": "xx", "symbol": "S1"}, F.coalesce(F.col("company") == "en", F.lit(False)), F.lit("now"))
    return out.select("doc_id", "company", "symbol", "authority_score", "freshness_score", "statement_type")


@query("SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 5 = 0 THEN 'direct_chat' ELSE (list_sort(list({'n': l_linenumber, 's': l_returnflag}))[1]).s END AS primary_source, bool_or(o_orderkey % 5 <> 0) AS citation_required, o_orderkey % 2 = 0 AS numeric_check_required, CASE WHEN o_orderkey % 2 = 0 THEN 3 WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS n_include, (o_orderkey % 3 = 0) AS needs_query_expansion, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE count(*) > 1 END AS needs_multi_source, CASE WHEN o_orderkey % 5 = 0 THEN 'generate' ELSE 'retrieval_orchestrator' END AS next_action FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def plan_rows(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("nth"), F.col("l_returnflag").alias("source"))
    o = t(spark, sf, "orders").join(lines.select(F.col("question_id").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    none = F.array().cast("array<string>")
    q = o.select(F.col("o_orderkey").alias("question_id"), F.lit("fact").alias("intent"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("m"))).otherwise(none).alias("metrics"), none.alias("entities"), F.lit(None).cast("boolean").alias("requires_freshness"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("n_sub_questions"))
    p = R.planned(q, lines.where("question_id % 5 <> 0"))
    return p.select("question_id", "primary_source", "citation_required", "numeric_check_required", F.size("must_include").alias("n_include"), "needs_query_expansion", "needs_multi_source", "next_action")


@query("SELECT l_orderkey AS question_id, l_linenumber AS nth FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'F')")
def multistage_gate(spark, sf):
    items = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("nth"), F.col("l_returnflag").alias("source"))
    needs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_document_evidence"), (F.col("o_orderstatus") == "F").alias("needs_filing_evidence"))
    return R.staged(items, needs, source="R").select("question_id", "nth")


@query("""WITH e AS (SELECT conv_id, turn, text FROM conversations WHERE turn < 2), r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN 'other' ELSE text END AS text FROM conversations),
x AS (SELECT e.conv_id, bool_or(r.text IS DISTINCT FROM e.text) AS differs, count(*) AS n FROM e LEFT JOIN r USING (conv_id, turn) GROUP BY e.conv_id)
SELECT e.conv_id, CAST(turn AS BIGINT) AS turn, text FROM e JOIN x USING (conv_id) WHERE differs
UNION ALL SELECT r.conv_id, CAST(turn + CASE WHEN differs THEN n ELSE 0 END AS BIGINT), text FROM r LEFT JOIN x USING (conv_id)""")
def prefix_aware_append(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    changed = c.withColumn("text", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0), "other").otherwise(F.col("text")))
    return R.accumulated(c.where("turn < 2"), changed, ["conv_id"], "turn", "text")


@query("SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN o.s ELSE c_mktsegment END AS c_mktsegment, o.n AS n_orders FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.k = c_custkey")
def state_merge(spark, sf):
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("c_mktsegment"), F.count("*").alias("n_orders"))
    return R.merged(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"])


@query("SELECT l_orderkey AS question_id, greatest(0.0, max(l_discount))::DOUBLE AS retrieval_score FROM lineitem GROUP BY l_orderkey")
def best_retrieval_score(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_discount").cast("double").alias("score"))
    return R.top_score(rows)


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS inserted, count(*) FILTER (WHERE o_orderstatus = 'F') AS skipped, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders")
def run_counters(spark, sf):
    s = F.col("o_orderstatus")
    return R.outcomes(t(spark, sf, "orders"), F.when(s == "O", "inserted").when(s == "F", "skipped").when(s == "P", "failed"))


@query("SELECT event_type AS step, count(*) FILTER (WHERE user_id % 3 = 0) AS n_tools, count(*) FILTER (WHERE user_id % 3 = 1) AS n_evidence, count(*) FILTER (WHERE user_id % 3 = 2) AS n_facts FROM events GROUP BY event_type")
def step_counts(spark, sf):
    kind = F.element_at(F.array(F.lit("tool"), F.lit("evidence"), F.lit("fact")), (F.col("user_id") % 3 + 1).cast("int"))
    return R.step_summary(t(spark, sf, "events").select(F.col("event_type").alias("step"), kind.alias("kind")))


@query("SELECT lang AS source_id, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def document_lengths(spark, sf):
    return R.page_lengths(t(spark, sf, "documents").withColumnRenamed("lang", "source_id"))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 40")
def limited_work_list(spark, sf):
    return R.work_list(t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate", "o_orderkey"], 40)


@query("SELECT n_name AS tool, CASE WHEN contains(lower(n_name), 'an') THEN 0 ELSE 0 END + CASE n_name WHEN 'FRANCE' THEN 5 WHEN 'GERMANY' THEN 6 ELSE 0 END AS hint_score, CAST(row_number() OVER (ORDER BY CASE n_name WHEN 'FRANCE' THEN 5 WHEN 'GERMANY' THEN 6 ELSE 0 END DESC, n_name DESC) AS INTEGER) AS rank FROM nation")
def hinted_tool_ranking(spark, sf):
    tools = t(spark, sf, "nation").select(F.col("n_name").alias("tool"))
    return R.hinted_tools(tools, F.lit("Price and volume of wine"), {"FRANCE": ["price", "cheese"], "GERMANY": ["volume"]})


@query("SELECT doc_id, source AS code, CAST(NULL AS VARCHAR) AS year, '' AS statement_type FROM documents")
def case_filter_override(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.lit("left over").alias("year"), F.create_map(F.lit("code"), F.col("source")).alias("metadata_filter"))
    return R.overridden(d).select("doc_id", "code", "year", "statement_type")


@query("SELECT doc_id, coalesce(nullif(lang, ''), 'the company') AS company, upper(coalesce(source, '')) AS symbol, '000001' AS code, coalesce(nullif(text, ''), 'asked') AS question FROM documents")
def need_arguments(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("display_name"), F.lit("the company").alias("entity_name"), F.col("source").alias("symbol"), F.lit("").alias("code"), F.lit("000001").alias("cn_code"), F.col("text").alias("query"), F.lit("asked").alias("question"))
    return R.arguments(d).select("doc_id", "args.company", "args.symbol", "args.code", "args.question")


@query("SELECT doc_id AS question_id, coalesce(text, '') AS query, coalesce(nullif(lang, ''), 'E') AS company, coalesce(source, '') AS code FROM documents")
def planner_argument_rows(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.lit(None).cast("string").alias("active_question"), F.col("text").alias("question"), F.col("lang").alias("entity_company"), F.lit("E").alias("company"), F.col("source").alias("entity_code"))
    return R.planner_arguments(d).select("question_id", "query", "company", "code")
