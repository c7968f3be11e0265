"""Search, fusion, recall and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MultistageConfig, SearchConfig
from ..functions import text as X
from ..operators import evaluate as V
from ..operators import recall as R
from ..operators import search as S
from ..operators.chunking import metric_chunks
from ..session import shared_folder
from .base import ORACLES, query, t, values

ASKED = [(1, "the tion heat of"), (2, "leur dans une ention")]
TOKENS = "list_distinct(regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+'))"
Q0 = "(SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7)"

#: BM25 of the questions in `asked` over documents: CTEs up to bm25(question_id, id, score).
BM25_SQL = """
asked AS (SELECT question_id, unnest(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'))) AS term FROM q),
toks AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ts FROM documents),
size AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avg_tokens FROM toks),
tf AS (SELECT id, len(ts) AS n_tokens, term, count(*)::DOUBLE AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
bm25 AS (SELECT question_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens))) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), size GROUP BY question_id, id)"""


def chunks(spark, sf):
    """documents in the shape of chunks."""
    d = t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_pdf"), "text", "lang", "n_chars")


def asked(spark, rows=ASKED):
    return spark.createDataFrame(rows, "question_id long, question string").withColumn("terms", X.search_terms("question"))


@query(f"WITH q AS (SELECT * FROM {values(ASKED, ['question_id', 'question'])}), {BM25_SQL} SELECT CAST(question_id AS BIGINT) AS question_id, id, round(score, 6) AS bm25, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25) WHERE rank <= 20")
def bm25_topk(spark, sf):
    hits = S.bm25(chunks(spark, sf), asked(spark)).withColumn("s", F.round("bm25", 9))
    return S.ranked(hits, "s", "rank", 20).select("question_id", "id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


@query(ORACLES["bm25_topk"])
def indexed_bm25_topk(spark, sf):
    """The same through an index that is built once and opened again."""
    path = shared_folder(spark, "index")
    S.TextIndex.build(chunks(spark, sf), path)
    hits = S.bm25(S.TextIndex.open(spark, path), asked(spark)).withColumn("s", F.round("bm25", 9))
    return S.ranked(hits, "s", "rank", 20).select("question_id", "id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


@query("SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(n_tokens) AS BIGINT) AS longest FROM (SELECT id, term, n_tokens, count(*) AS tf FROM (SELECT doc_id AS id, unnest(ts) AS term, len(ts) AS n_tokens FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ts FROM documents)) GROUP BY ALL) GROUP BY term")
def postings_stats(spark, sf):
    p = S.postings(chunks(spark, sf))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("n_tokens").alias("longest"))


@query(f"SELECT 1::BIGINT AS question_id, vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), v), 6) AS dense FROM embeddings, {Q0} ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10")
def dense_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id = 7").select(F.lit(1).cast("long").alias("question_id"), F.col("embedding").alias("vector"))
    hits = S.dense(e, q, "vec_id")
    return S.ranked(hits, "dense", "rank", 10).select("question_id", "id", F.round("dense", 6).alias("dense"))


HYBRID = SearchConfig(top_k=10, candidate_k=50, per_source_limit=2, freshness_weight=0.0)


@query(
    f"""WITH q AS (SELECT * FROM {values(ASKED[:1], ['question_id', 'question'])}), {BM25_SQL},
sp AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm25 QUALIFY r <= 60),
de AS (SELECT vec_id AS id, list_inner_product(CAST(embedding AS DOUBLE[]), v) AS score, row_number() OVER (ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), v) DESC, vec_id) AS r FROM embeddings, {Q0} QUALIFY r <= 80),
m AS (SELECT coalesce(de.id, sp.id) AS id, coalesce(de.score, 0) AS dense, coalesce(1.0 / (60 + de.r), 0) + coalesce(1.0 / (60 + sp.r), 0) AS rrf, de.r AS dr, sp.r AS sr FROM de FULL JOIN sp ON de.id = sp.id),
f AS (SELECT m.*, coalesce(d.source, '') AS source, m.dense + m.rrf + 0.05 AS final FROM m LEFT JOIN documents d ON d.doc_id = m.id),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY final DESC, id) AS sr2 FROM f)
SELECT 1::BIGINT AS question_id, id, CAST(row_number() OVER (ORDER BY final DESC, id) AS BIGINT) AS rank, round(final, 6) AS final,
  array_to_string(list_filter([CASE WHEN dr IS NOT NULL THEN 'dense' END, CASE WHEN sr IS NOT NULL THEN 'sparse' END], lambda x: x IS NOT NULL), '+') AS found_by
FROM c WHERE sr2 <= 2 ORDER BY final DESC, id LIMIT 10"""
)
def hybrid_rrf_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    vector = e.where("vec_id = 7").select(F.lit(1).cast("long").alias("question_id"), F.col("embedding").alias("vector"))
    q = asked(spark, ASKED[:1]).join(F.broadcast(vector), "question_id")
    out = S.hybrid(chunks(spark, sf), e.withColumnRenamed("vec_id", "chunk_id"), q, HYBRID)
    return out.select("question_id", "id", F.col("rank").cast("long").alias("rank"), F.round("final", 6).alias("final"), F.array_join("found_by", "+").alias("found_by"))


@query("SELECT id, source, CAST(rank AS BIGINT) AS rank FROM (SELECT id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, id) AS rank FROM (SELECT doc_id AS id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2) WHERE rank <= 12")
def per_source_cap_topk(spark, sf):
    d = t(spark, sf, "documents").select(F.lit(1).alias("question_id"), F.col("doc_id").alias("id"), "source", "n_chars")
    return S.diversified(d, "n_chars", F.col("source"), 2, 12).select("id", "source", F.col("rank").cast("long").alias("rank"))


@query("SELECT a.conv_id, a.turn AS id, string_agg(CASE WHEN b.turn = a.turn THEN '[matched] ' ELSE '[adjacent] ' END || coalesce(b.text, ''), chr(10) || chr(10) ORDER BY b.turn) AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user' GROUP BY a.conv_id, a.turn")
def adjacent_window(spark, sf):
    c = t(spark, sf, "conversations").withColumn("section", F.lit(None).cast("string")).withColumn("chunk_id", F.struct("conv_id", "turn"))
    hits = c.where("role = 'user'").select("chunk_id", F.lit(1).alias("question_id"))
    out = S.adjacent(hits, c, 1, source_col="conv_id", index_col="turn")
    return out.select("id.conv_id", F.col("id.turn").alias("id"), "context")


def _suppliers(spark, sf):
    """lineitem as chunks of documents by supplier."""
    rows = t(spark, sf, "lineitem")
    return rows.select(F.col("l_suppkey").cast("string").alias("source_pdf"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("company"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("report_type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("publish_date"), (1 - F.col("l_discount")).alias("source_authority_score"))


RECALL_SQL = "SELECT source_pdf, CAST(max(year) AS INTEGER) AS year, max(publish_date) AS publish_date, count(*) AS chunk_count, max(auth) AS authority FROM (SELECT CAST(l_suppkey AS VARCHAR) AS source_pdf, l_returnflag AS code, year(l_shipdate) AS year, strftime(l_shipdate, '%Y-%m-%d') AS publish_date, 1 - l_discount AS auth FROM lineitem) WHERE {where} GROUP BY source_pdf"


@query(f"SELECT source_pdf, year, publish_date, chunk_count, CAST(rank AS BIGINT) AS rank, round(authority + 1.0 / rank, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY authority DESC, publish_date DESC, chunk_count DESC, source_pdf) AS rank FROM ({RECALL_SQL.format(where=chr(99) + 'ode = ' + chr(39) + 'R' + chr(39) + ' AND year = 1996')})) WHERE rank <= 8")
def document_recall(spark, sf):
    out = R.recall(_suppliers(spark, sf), ["year", "publish_date"], code="R", year=1996)
    return out.select("source_pdf", "year", "publish_date", "chunk_count", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"SELECT source_pdf, year, publish_date, chunk_count, CAST(rank AS BIGINT) AS rank, round(authority + 1.0 / rank, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY authority DESC, publish_date DESC, chunk_count DESC, source_pdf) AS rank FROM ({RECALL_SQL.format(where='true')})) WHERE rank <= 8")
def recall_relaxation(spark, sf):
    """No row has the code, so that the filter is relaxed to none."""
    out = R.recall(_suppliers(spark, sf), ["year", "publish_date"], code="none")
    return out.select("source_pdf", "year", "publish_date", "chunk_count", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


SUBS = [(1, "the tion heat of", "heat"), (2, "leur dans une ention", "main"), (3, "zzzz qqqq", "und")]
DOCS_SQL = "docs AS (SELECT source, 1.0 + 1.0 / rank AS doc_score FROM (SELECT source, row_number() OVER (ORDER BY max(n_chars) DESC, count(*) DESC, source) AS rank FROM documents GROUP BY source) WHERE rank <= 5)"


@query(
    f"""WITH q0 AS (SELECT * FROM {values(SUBS, ['question_id', 'question', 'focus'])}), q AS (SELECT question_id, question FROM q0), {BM25_SQL}, {DOCS_SQL},
i AS (SELECT d.doc_id AS id, d.source, d.text, doc_score FROM documents d JOIN docs USING (source)),
h AS (SELECT b.question_id, b.id, i.source, i.text, i.doc_score, q0.focus, row_number() OVER (PARTITION BY b.question_id ORDER BY round(b.score, 9) DESC, b.id) AS place FROM bm25 b JOIN i USING (id) JOIN q0 USING (question_id) WHERE q0.focus IN ('main', 'comparison', '') OR contains(lower(i.text), lower(q0.focus)) QUALIFY place <= 24),
s AS (SELECT q0.question_id, i.id, i.source, i.text, i.doc_score, q0.focus, row_number() OVER (PARTITION BY q0.question_id ORDER BY i.id) AS place FROM q0, i WHERE q0.question_id NOT IN (SELECT question_id FROM h) AND contains(lower(i.text), lower(q0.focus)) QUALIFY place <= 24),
e AS (SELECT * FROM h UNION ALL SELECT * FROM s),
f AS (SELECT *, 1.0 / place + CASE WHEN focus <> '' AND contains(substr(text, 1, 1000), focus) THEN 0.3 ELSE 0 END + 0.1 * doc_score AS score FROM e)
SELECT CAST(question_id AS BIGINT) AS question_id, id AS chunk_id, source AS source_pdf, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id) AS BIGINT) AS rank FROM f QUALIFY rank <= 6"""
)
def multistage_recall(spark, sf):
    c = chunks(spark, sf)
    docs = c.groupBy("source_pdf").agg(F.max("n_chars").alias("n"), F.count("*").alias("chunk_count"), F.lit(1.0).alias("authority")).withColumn("publish_date", F.lpad(F.col("n").cast("string"), 12, "0"))
    top = R.top_documents(docs, 5)
    subs = spark.createDataFrame(SUBS, "question_id long, question string, focus string")
    out = R.multistage(c, top, subs, MultistageConfig())
    return out.select("question_id", "chunk_id", "source_pdf", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def like_fallback(spark, sf):
    d = t(spark, sf, "documents").withColumn("focus", F.lit("LICENSE"))
    return R.focus_filter(d, ["text", "source"]).select("doc_id", "lang")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3 AND c_name ILIKE '%#00000%'")
def question_filter(spark, sf):
    c = t(spark, sf, "customer").withColumn("industry", F.col("c_nationkey"))
    return S.metadata_filter(c, {"industry": 3, "code": "", "year": 0}).where(R.like("c_name", "#00000")).select("c_custkey", "c_mktsegment")


@query("SELECT event_id, round(exp(-greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-03-01'), 0) / 180.0) * CASE event_type WHEN 'click' THEN 0.65 ELSE 0.5 END, 6) AS fresh FROM events")
def freshness_decay(spark, sf):
    e = t(spark, sf, "events")
    from ..functions.classify import freshness_weight

    weight = freshness_weight(F.lit("report"), F.when(F.col("event_type") == "click", "q1").otherwise("none"))
    return e.select("event_id", F.round(S.freshness(F.date_format("ts", "yyyy-MM-dd"), weight, SearchConfig(as_of="2024-03-01")), 6).alias("fresh"))


TERMS = ["the", "tion", "que", "und", "ing", "ent"]


@query(f"SELECT doc_id, round(CAST(CASE WHEN lang = 'en' THEN 0.18 WHEN lang <> '' THEN -0.05 ELSE 0 END + least(0.18, 0.04 * len(list_filter({TERMS!r}, lambda x: contains('thetionundque', x) AND contains(regexp_replace(text, '\\s+', '', 'g'), x)))) AS DOUBLE), 6) AS score FROM documents")
def rule_score(spark, sf):
    d = t(spark, sf, "documents")
    d = d.withColumn("asked", S.query_terms(F.lit("the tion und que"), TERMS)).withColumn("body", X.squeeze("text"))
    s = S.rule_score(F.array(F.lit("en")), F.col("asked"), F.coalesce("lang", F.lit("")), F.col("body"))
    return d.select("doc_id", F.round(s, 6).alias("score"))


@query("SELECT e.vec_id AS id, CASE WHEN d.doc_id IS NOT NULL THEN d.lang ELSE 'none' END AS lang, d.source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def hydrate_override(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("none").alias("lang"))
    return S.hydrated(e, t(spark, sf, "documents"), ["lang", "source"], "doc_id").select("id", "lang", "source")


EVAL_Q = "(SELECT item_id AS question_id, text AS question FROM benchmark)"


@query(
    """WITH q AS (SELECT item_id AS question_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 1, 6), ' ') AS question FROM benchmark), """
    + BM25_SQL
    + """, p AS (SELECT q.question_id, d.doc_id AS id FROM q JOIN benchmark b ON b.item_id = q.question_id JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25 QUALIFY rank <= 10),
g AS (SELECT q.question_id, min(r.rank) AS first_rank FROM q LEFT JOIN p USING (question_id) LEFT JOIN r ON r.question_id = p.question_id AND r.id = p.id GROUP BY q.question_id)
SELECT count(*) AS n_cases, round(avg(CASE WHEN first_rank = 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM g"""
)
def retrieval_metrics(spark, sf):
    """Benchmark passages as cases: their first words are the question, documents with the passage the positives."""
    b, c = t(spark, sf, "benchmark"), chunks(spark, sf)
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN), 1), 1, 6)
    q = b.select(F.col("item_id").alias("question_id"), F.array_distinct(words).alias("terms"))
    hits = S.ranked(S.bm25(c, q).withColumn("s", F.round("bm25", 9)), "s", "rank", 10)
    positives = V.containing(c, b, "chunk_id", "text", "item_id", "text").select(F.col("item_id").alias("question_id"), F.col("chunk_id").alias("id"))
    out = V.summary(V.graded_rows(q.select("question_id"), positives, hits, "question_id"), 10)
    return out.select("n_cases", *(F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_k", "mrr")))


CASE_FORMS = ["{company} {year} {terms}?", "{terms} of {company}, {year}", "{company}: {terms}", "find {terms} ({section})"]


@query(
    """WITH c AS (SELECT doc_id, coalesce(source, '') AS code, doc_id % 3 AS year, coalesce(lang, '') AS report_type, lower(coalesce(text, '')) AS body, regexp_extract_all(lower(text), '\\p{L}{9,}') AS ts FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id) - 1 AS pos, count(*) OVER () AS total FROM c WHERE len(ts) > 0 QUALIFY pos <= 400),
a AS (SELECT *, unnest(generate_series(CASE WHEN pos = 0 THEN least(total, 401) ELSE pos END, 400, least(total, 401))) AS attempt FROM s),
k AS (SELECT *, list_sort(list_transform(ts, lambda x: {'h': md5(concat_ws('|', x, attempt, '42')), 't': x})) AS o FROM a),
m AS (SELECT *, list_transform(o[1:1 + CAST('0x' || substr(md5(concat_ws('|', doc_id, attempt, 'n')), 1, 2) AS INTEGER) % least(2, len(o))], lambda x: x.t) AS terms,
CAST('0x' || substr(md5(concat_ws('|', doc_id, attempt, 'q')), 1, 2) AS INTEGER) % 4 AS form FROM k),
q AS (SELECT *, CASE form WHEN 0 THEN code || ' ' || year || ' ' || array_to_string(terms, '、') || '?' WHEN 1 THEN array_to_string(terms, '、') || ' of ' || code || ', ' || year WHEN 2 THEN code || ': ' || array_to_string(terms, '、') ELSE 'find ' || array_to_string(terms, '、') || ' ()' END AS question FROM m),
p AS (SELECT attempt, any_value(question) AS question, any_value(q.doc_id) AS seed_context, list_sort(list(c.doc_id)) AS positives FROM q JOIN c USING (code, year, report_type) WHERE len(c.ts) > 0 AND len(list_filter(q.terms, lambda x: contains(c.body, x) OR contains(array_to_string(c.ts, ' '), x))) > 0 GROUP BY attempt)
SELECT attempt, question, seed_context, CAST(len(positives) AS INTEGER) AS n_positives, list_max(positives) AS last_positive FROM p QUALIFY row_number() OVER (PARTITION BY question, positives ORDER BY attempt) = 1 ORDER BY attempt LIMIT 20"""
)
def eval_case_gen(spark, sf):
    """Cases by turns over documents, whose long words are the metric terms."""
    d = t(spark, sf, "documents")
    terms = F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}{9,})"), 1), " ")
    c = d.select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("company"), F.lit("").alias("section"), F.lit("").alias("statement_type"), F.coalesce("source", F.lit("")).alias("code"), (F.col("doc_id") % 3).alias("year"), F.coalesce("lang", F.lit("")).alias("report_type"), F.lit("report").alias("doc_type"), F.lit("financial_statement").alias("chunk_type"), "text", terms.alias("metric_terms"))
    made = V.sampled(metric_chunks(c), 20, questions=CASE_FORMS)
    return made.select("attempt", "question", "seed_context", F.size("positive_contexts").alias("n_positives"), F.array_max("positive_contexts").alias("last_positive"))


@query()
def approximate_dense_topk(spark, sf):
    """Random projections instead of a scan: rows are compared with the exact ones by recall in the tests."""
    e = t(spark, sf, "embeddings")
    question = list(e.where("vec_id = 7").first()["embedding"])
    return S.approximate_dense(e, question, 10, "vec_id").select("id", F.round("dense", 6).alias("dense"))
