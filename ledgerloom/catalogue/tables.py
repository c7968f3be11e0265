"""Keeping tables, projections, windows, sets and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import evidence as E
from ..operators import maintain as M
from ..operators import recall as R
from ..plans import analyze as A
from ..sources import filings
from .base import query, t, values


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def unindexed_antijoin(spark, sf):
    return M.unindexed(t(spark, sf, "documents"), t(spark, sf, "labels"), "doc_id", quality=1).select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def dependent_delete_semi(spark, sf):
    gone = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.without(t(spark, sf, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scoped_keep(spark, sf):
    parents = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return M.of(t(spark, sf, "orders"), parents, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, (SELECT p_type FROM part WHERE p_partkey = l_partkey AND p_size > 10) AS category FROM lineitem")
def category_backfill(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = t(spark, sf, "part").where("p_size > 10").select("p_partkey", "p_type")
    return M.looked_up(rows, parents, F.col("l_partkey") == F.col("p_partkey"), {"category": "p_type"}).select("l_orderkey", "l_linenumber", "category")


@query("SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN 'und' ELSE lang END AS lang, coalesce(nullif(source, 'src0'), 'first') AS source FROM documents")
def backfill_blank(spark, sf):
    d = t(spark, sf, "documents").withColumn("source", F.nullif("source", F.lit("src0")))
    return M.backfilled(d, {"lang": F.lit("und"), "source": F.lit("first")}).select("doc_id", "lang", "source")


@query("SELECT user_id, event_type, event_id, created_at FROM (SELECT user_id, event_type, event_id, min(ts) OVER (PARTITION BY user_id, event_type) AS created_at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").alias("created_at"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")  # two versions of the table, all rows in both together
    return M.upserted(old, new, ["user_id", "event_type"], "event_id", "created_at")


@query("SELECT doc_id, source, sha256(text) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND (source, sha256(text)) NOT IN (SELECT (source, sha256(text)) FROM documents WHERE lang = 'es')")
def insert_if_absent(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    return M.absent(d, d.where("lang = 'es'"), [["source", "text_hash"]], ["doc_id"]).select("doc_id", "source", "text_hash")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_dedupe(spark, sf):
    return R.keep_first(t(spark, sf, "documents"), F.substring("text", 1, 200), [F.col("doc_id")]).select("doc_id", "source")


@query("SELECT 'order_' || o_orderkey AS source_id, 'report' AS doc_type, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders UNION ALL SELECT 'event_' || event_id, 'announcement', CAST(year(ts) AS INTEGER) FROM events")
def union_sources(spark, sf):
    o = t(spark, sf, "orders").select(F.concat_ws("_", F.lit("order"), "o_orderkey").alias("source_id"), F.lit("report").alias("doc_type"), F.year("o_orderdate").alias("year"))
    e = t(spark, sf, "events").select(F.concat_ws("_", F.lit("event"), "event_id").alias("source_id"), F.lit("announcement").alias("doc_type"), F.year("ts").alias("year"))
    return o.unionByName(e)


@query("SELECT user_id, 'both' AS kind FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT user_id, 'only' FROM (SELECT user_id FROM events WHERE event_type = 'click' AND value > 50 EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)")
def set_intersection_difference(spark, sf):
    e = t(spark, sf, "events")
    of = lambda kind, more="true": e.where(F.col("event_type") == kind).where(more).select("user_id")
    both = of("click").intersect(of("purchase")).withColumn("kind", F.lit("both"))
    return both.unionByName(of("click", "value > 50").subtract(of("purchase", "value > 50")).withColumn("kind", F.lit("only")))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE coalesce(source, '') = '' OR coalesce(text, '') = '') AS missing_meta, count(*) FILTER (WHERE coalesce(n_chars, 0) < 1000) AS suspicious FROM documents GROUP BY lang")
def collection_quality(spark, sf):
    return M.quality_report(t(spark, sf, "documents"), "lang", ["source", "text"], "n_chars", 1000)


CATEGORIES = {"metal": ["STEEL", "BRASS", "COPPER"], "plated": ["PLATED"], "large": ["^LARGE", "JUMBO"], "economy": ["ECONOMY.*TIN"]}


@query(
    "SELECT p_partkey, tags[1] AS category, array_to_string(tags, ',') AS tags FROM (SELECT p_partkey, CASE WHEN len(ts) > 0 THEN ts ELSE ['other_high_value'] END AS tags FROM (SELECT p_partkey, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(p_type, '{'|'.join(p)}') THEN '{k}' END" for k, p in CATEGORIES.items())
    + "], lambda x: x IS NOT NULL) AS ts FROM part))"
)
def title_regex_classify(spark, sf):
    tags = C.categories(F.col("p_type"), CATEGORIES)
    return t(spark, sf, "part").select("p_partkey", F.element_at(tags, 1).alias("category"), F.array_join(tags, ",").alias("tags"))


@query("SELECT p_partkey, left(coalesce(p_name, ''), 8) AS p_name, left(coalesce(p_brand, ''), 5) AS p_brand, CAST(coalesce(p_size, 0) AS BIGINT) AS p_size, coalesce(p_retailprice, 1.0) AS p_retailprice FROM part")
def varchar_truncate_project(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return M.coerced(p, {"p_name": 8, "p_brand": 5}, ["p_size"], {"p_retailprice": 1.0})


@query("SELECT r_name, CAST(y AS INTEGER) AS year, ty AS report_type FROM region, (SELECT unnest(list_distinct([2023, 2024, 2025, 2027])) AS y), (SELECT unnest(['annual', 'q1']) AS ty)")
def work_list_cross(spark, sf):
    years = spark.range(1).select(X.years(F.lit("2023-2025,2027")).alias("y")).first()["y"]
    return filings.work_list(t(spark, sf, "region"), years, ["annual", "q1"]).select("r_name", "year", "report_type")


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def section_carry_forward(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t(spark, sf, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.substring("text", 1, 40)), ignorenulls=True).over(w).alias("section"))


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS nth FROM events")
def page_lead_slices(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("next_id"), F.row_number().over(w).cast("long").alias("nth"))


@query("SELECT l_orderkey, l_linenumber, CAST(n AS BIGINT) AS n, l_orderkey || '_' || lpad(CAST(n AS VARCHAR), 4, '0') AS fact_id, sha256(l_orderkey || '_' || l_linenumber) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem)")
def sequence_ids(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("n"))
    return rows.select("*", F.concat_ws("_", "l_orderkey", F.lpad(F.col("n").cast("string"), 4, "0")).alias("fact_id"), F.sha2(F.concat_ws("_", "l_orderkey", "l_linenumber"), 256).alias("text_hash"))


@query("SELECT event_id, strftime(try_strptime(s, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d']), '%Y-%m-%d') AS d FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y%m%d') END AS s FROM events UNION ALL SELECT -1, 'not a date')")
def date_parse_formats(spark, sf):
    s = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyyMMdd"))
    rows = t(spark, sf, "events").select("event_id", s.alias("s")).unionByName(spark.createDataFrame([(-1, "not a date")], "event_id long, s string"))
    return rows.select("event_id", F.date_format(X.parsed_date("s"), "yyyy-MM-dd").alias("d"))


@query("SELECT p_partkey, CAST(least(greatest(CASE WHEN coalesce(p_size, 0) = 0 THEN 5 ELSE p_size END, 1), 20) AS INTEGER) AS lim, array_to_string(list_slice(string_split(p_type, ' '), 1, 2), ' ') AS head, CAST(greatest(1, len(p_name) // 2) AS INTEGER) AS tokens FROM part")
def clamps_and_slices(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.clamped(F.col("p_size"), 5, 20).alias("lim"), F.array_join(F.slice(F.split("p_type", " "), 1, 2), " ").alias("head"), X.token_estimate("p_name").alias("tokens"))


@query("SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '') AS search_text, 'name：' || coalesce(p_name, '') || chr(10) || '页码：' || CASE WHEN p_size = p_size % 7 THEN CAST(p_size AS VARCHAR) ELSE p_size || '-' || p_size % 7 END AS header FROM part")
def search_text_project(spark, sf):
    from ..operators.chunking import header

    p = t(spark, sf, "part").withColumn("last", F.col("p_size") % 7)
    return p.select("p_partkey", F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("p_name", "p_brand", "p_type"))).alias("search_text"), header({"name": "p_name"}, "p_size", "last").alias("header"))


NAMES = [(1, "customer#000000007"), (2, "  CUSTOMER#000000012 "), (3, "Customer#1"), (4, "")]


@query(f"SELECT v.mention_id, c.c_custkey FROM {values(NAMES, ['mention_id', 'name'])} JOIN customer c ON lower(trim(v.name)) = lower(trim(c.c_name))")
def exact_name_match(spark, sf):
    mentions = spark.createDataFrame(NAMES, "mention_id int, name string")
    return A.exact_name(mentions, t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("company")), "name").select("mention_id", "c_custkey")


@query("SELECT conv_id, turn, substr(text, 1, CAST(400 - before AS INTEGER)) AS text FROM (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 400")
def running_budget_trim(spark, sf):
    return E.cut_off(t(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", 400, ["conv_id"], ["turn"])


@query(
    """WITH RECURSIVE r AS (SELECT conv_id, turn, '[' || turn || ']' || chr(10) || CASE WHEN length(text) > 120 THEN rtrim(substr(text, 1, 120)) || chr(10) || '...[truncated]' ELSE text END AS block, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, []::VARCHAR[] AS kept, 0::BIGINT AS dropped FROM (SELECT DISTINCT conv_id FROM r)
 UNION ALL SELECT f.conv_id, r.n, CASE WHEN f.used + length(r.block) <= 3000 THEN f.used + length(r.block) ELSE f.used END, CASE WHEN f.used + length(r.block) <= 3000 THEN list_append(f.kept, r.block) ELSE f.kept END, f.dropped + CASE WHEN f.used + length(r.block) <= 3000 THEN 0 ELSE 1 END
 FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, array_to_string(kept, chr(10) || chr(10)) AS context_text, used, dropped FROM f QUALIFY n = max(n) OVER (PARTITION BY conv_id)"""
)
def context_budget_pack(spark, sf):
    from ..config import ContextConfig

    c = t(spark, sf, "conversations")
    out = E.context(c, ContextConfig(token_budget=100, snippet_chars=120), keys=("conv_id",), seq="turn", body="text")
    return out.select("conv_id", "context_text", F.col("used").cast("long").alias("used"), F.size("dropped").cast("long").alias("dropped"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events")
def json_props_extract(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return t(spark, sf, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(F.map_keys(m)).cast("long").alias("n_keys"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, 'done' FROM labels")
def incremental_increment(spark, sf):
    """What a run adds to a checkpoint, and what the checkpoint had."""
    done = t(spark, sf, "labels")
    new = M.unindexed(t(spark, sf, "documents"), done, "doc_id").select("doc_id", "source")
    return new.unionByName(done.select("doc_id", F.lit("done").alias("source")))


@query("SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def time_window_counts(spark, sf):
    from ..streaming.ingest import windowed_counts

    e = t(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return windowed_counts(e, "at", ["event_type"], "1 hour", "1 hour").select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "n")


