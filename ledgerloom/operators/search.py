"""Sparse, dense and hybrid search over a DataFrame of chunks, for one question or a DataFrame of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..config import SearchConfig
from ..functions import classify as C
from ..functions import text as X
from ..session import written

TOKEN = r"([\p{L}\p{N}]+)"
FILTERS = ("code", "industry", "year", "report_type", "doc_type", "announcement_category", "chunk_type", "section", "statement_type")


def metadata_filter(df: DataFrame, values: dict[str, object], columns: Sequence[str] = FILTERS) -> DataFrame:
    """Equalities on the columns that have a value; null, '' and 0 mean none. They reach the scan."""
    named = [F.col(c) == F.lit(values[c]) for c in columns if values.get(c) not in (None, "", 0)]
    return df.where(reduce(lambda a, b: a & b, named)) if named else df


def with_tokens(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return chunks.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), 1).alias("tokens"))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """term, id, tf, n_tokens: the full-text index. Write it once and search it often."""
    tokens = with_tokens(chunks, id_col, text_col).select("id", F.size("tokens").cast("long").alias("n_tokens"), F.explode("tokens").alias("term"))
    return tokens.groupBy("term", "id", "n_tokens").agg(F.count("*").alias("tf"))


def corpus_size(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row: n (chunks), avg_tokens."""
    return with_tokens(chunks, id_col, text_col).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_tokens"))


@dataclass(frozen=True)
class TextIndex:
    """A full-text index in a folder: postings that lie sorted by term, so that a search reads the asked terms' parts of
    its files alone, and the corpus's numbers. Built again, it replaces nothing: give each build its own folder."""

    postings: DataFrame
    n: int
    avg_tokens: float

    @staticmethod
    def build(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text") -> "TextIndex":
        rows = postings(chunks, id_col, text_col)
        rows.repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        corpus_size(chunks, id_col, text_col).write.parquet(f"{path}/size")
        return TextIndex.open(chunks.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> "TextIndex":
        size = spark.read.parquet(f"{path}/size").first()
        return TextIndex(spark.read.parquet(f"{path}/postings"), size["n"], size["avg_tokens"] or 0.0)

    def search(self, questions: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
        """question_id, id, bm25 of (question_id, terms)."""
        asked = questions.select("question_id", F.explode(F.array_distinct("terms")).alias("term"))
        tf = self.postings.join(asked.select("term").distinct(), "term").withColumn("tf", F.col("tf").cast("double"))
        return weighed(tf, asked, F.lit(self.n), F.lit(self.avg_tokens), config)


def weighed(tf: DataFrame, asked: DataFrame, n: Column, avg_tokens: Column, config: SearchConfig) -> DataFrame:
    """question_id, id, bm25 from all postings (term, id, tf, n_tokens) of the asked terms (question_id, term)."""
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(config.idf_floor))
    share = F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("n_tokens") / avg_tokens))
    parts = tf.join(df, "term").select("id", "term", (idf * share).alias("part"))
    return parts.join(asked, "term").groupBy("question_id", "id").agg(F.sum("part").alias("bm25"))


def bm25(chunks: DataFrame | TextIndex, questions: DataFrame, id_col: str = "chunk_id", text_col: str = "text", config: SearchConfig = SearchConfig()) -> DataFrame:
    """question_id, id, bm25 (larger is better) for chunks that have any of a question's terms.

    `chunks` is an index, or a table that is scanned: each chunk is cut into tokens once, its tokens meet the asked terms
    by a hash join, and only counts of asked terms are shuffled. Sizes and frequencies are the whole corpus's."""
    if isinstance(chunks, TextIndex):
        return chunks.search(questions, config)
    asked = questions.select("question_id", F.explode(F.array_distinct("terms")).alias("term"))
    rows = with_tokens(chunks, id_col, text_col).select("id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")
    each = rows.select("id", "n_tokens", F.explode_outer("tokens").alias("token"))
    # A chunk's row without a term counts it for the corpus; there's one for each chunk, asked for or not.
    tokens = each.join(asked.select(F.col("term").alias("token"), F.col("term")).distinct(), "token", "left")
    counts = written(tokens.groupBy("id", "n_tokens", "term").agg(F.count("*").cast("double").alias("tf")), "bm25")
    size = counts.groupBy("id").agg(F.max("n_tokens").alias("n_tokens")).agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg")).first()
    return weighed(counts.where("term is not null"), asked, F.lit(size["n"]), F.lit(size["avg"] or 0.0), config)


def ranked(df: DataFrame, score: str, rank: str, limit: int | None = None, by: str | None = "question_id", tie: str = "id") -> DataFrame:
    """Positions 1.. by falling score, ties by id. A limit becomes a group limit before the shuffle."""
    w = (W.partitionBy(by) if by else W.partitionBy()).orderBy(F.col(score).desc(), F.col(tie))
    out = df.withColumn(rank, F.row_number().over(w))
    return out.where(F.col(rank) <= limit) if limit else out


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, questions: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """question_id, id, dense: cosines (vectors have unit length) of all vectors with each question's `vector`.

    The questions are a stated set and are broadcast, the vectors are scanned once where they lie."""
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(F.broadcast(questions.select("question_id", "vector"))).select("question_id", "id", dot("v", "vector").alias("dense"))


def rrf(rank: Column, k: int = 60) -> Column:
    return F.when(rank.isNotNull(), 1.0 / (F.lit(k) + F.greatest(F.lit(1), rank))).otherwise(0.0)


def merged(dense_hits: DataFrame, sparse_hits: DataFrame) -> DataFrame:
    """The candidates of both searches with their scores, ranks and where they come from."""
    both = dense_hits.select("question_id", "id", "dense", "dense_rank").join(sparse_hits.select("question_id", "id", "bm25", "sparse_rank"), ["question_id", "id"], "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("sparse_rank").isNotNull(), "sparse")))
    return both.select("question_id", "id", F.coalesce("dense", F.lit(0.0)).alias("dense"), "dense_rank", F.coalesce(1.0 / (1.0 + F.col("sparse_rank")), F.lit(0.0)).alias("sparse"), "sparse_rank", sources.alias("found_by"))


def freshness(date: Column | str, weight: Column, config: SearchConfig) -> Column:
    """exp(-age in days / decay) times the weight of the kind; no date gives 0, a date to come has age 0."""
    if not config.freshness_weight:
        return F.lit(0.0)
    days = F.datediff(F.lit(config.as_of).cast("date"), X.parsed_date(date))
    return F.when(days.isNotNull(), F.exp(-F.greatest(days, F.lit(0)) / F.lit(max(1.0, config.decay_days))) * weight).otherwise(0.0)


def query_terms(query: Column, terms: list[str] = rules.METRIC_TERMS) -> Column:
    """The terms that a question has, whatever its spaces."""
    return X.let(X.squeeze(query), lambda q: X.terms_in(q, terms))


def rule_score(statement_hints: Column, asked: Column, statement: Column, body: Column) -> Column:
    """Agreement of the statement type, and the share of the question's metric terms that the chunk has. `statement` is
    looked at several times: give a column that's computed."""
    agree = F.when(F.size(statement_hints) == 0, 0.0).when(F.array_contains(statement_hints, statement), 0.18).when(statement != "", -0.05).otherwise(0.0)
    return agree + F.least(F.lit(0.18), F.size(F.filter(asked, lambda x: F.contains(body, x))) * 0.04)


def expanded(questions: DataFrame, expansions: dict[str, str] = rules.QUERY_EXPANSIONS, statements: dict[str, list[str]] = rules.STATEMENT_RULES, terms: list[str] = rules.METRIC_TERMS, enabled: bool = True) -> DataFrame:
    """Adds retrieval_query, statement_hints and metric_hints to (question_id, question)."""
    questions = questions.withColumn("__compact", X.squeeze("question"))
    compact = F.col("__compact")
    parts = F.array_compact(F.array(X.strip("question"), *(F.when(compact.contains(k), F.lit(v)) for k, v in expansions.items())))
    query = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ") if enabled else F.col("question")
    hints = F.array_compact(F.array(*(F.when(C.has(compact, words), F.lit(name)) for name, words in statements.items())))
    return questions.withColumns({"retrieval_query": query, "statement_hints": hints, "metric_hints": X.terms_in(compact, terms)}).drop("__compact")


def final_score(config: SearchConfig, dense_col: Column, dense_rank: Column, sparse_rank: Column, fresh: Column, authority: Column, rule: Column) -> Column:
    hybrid = config.dense_weight * rrf(dense_rank, config.rrf_k) + config.bm25_weight * rrf(sparse_rank, config.rrf_k)
    return dense_col + hybrid + config.freshness_weight * fresh + config.authority_weight * F.coalesce(F.nullif(authority, F.lit(0.0)), F.lit(1.0)) + config.rule_weight * rule


def diversified(scored: DataFrame, score: str, source: Column, per_source: int, top_k: int, by: str = "question_id", tie: str = "id") -> DataFrame:
    """At most `per_source` hits of a source, then the best `top_k`: adds source_rank and rank."""
    s = scored.withColumn("__source", F.coalesce(source, F.lit("")))
    s = s.withColumn("source_rank", F.row_number().over(W.partitionBy(by, "__source").orderBy(F.col(score).desc(), F.col(tie))))
    s = s.where(F.col("source_rank") <= per_source) if per_source else s
    return ranked(s, score, "rank", top_k, by, tie).drop("__source")


def adjacent(hits: DataFrame, chunks: DataFrame, window: int, id_col: str = "chunk_id", source_col: str = "source_id", section_col: str = "section", index_col: str = "chunk_index", text_col: str = "text", keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """keys, id, context: each hit's text with its neighbours' by index in the same source and section, marked."""
    section = F.coalesce(F.col(section_col), F.lit(""))
    own = hits.select(*keys, F.col(id_col).alias("id")).join(chunks.select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), section.alias("sec"), F.col(index_col).alias("at")), "id")
    near = chunks.select(F.col(id_col).alias("n_id"), F.col(source_col).alias("s"), section.alias("sec"), F.col(index_col).alias("n_at"), F.col(text_col).alias("t"))
    # Each hit asks for its few places: a long section isn't met as a whole.
    asked = own.withColumn("n_at", F.explode(F.sequence(F.col("at") - window, F.col("at") + window))).withColumn("n_at", F.col("n_at").cast(near.schema["n_at"].dataType))
    both = asked.join(near, ["s", "sec", "n_at"])
    mark = F.when(F.col("n_id") == F.col("id"), "[matched] ").otherwise("[adjacent] ")
    part = F.struct(F.col("n_at").alias("at"), F.col("n_id").alias("id"), F.concat(mark, F.coalesce("t", F.lit(""))).alias("t"))
    return both.groupBy(*keys, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("context"))


def hydrated(candidates: DataFrame, chunks: DataFrame, columns: Sequence[str], id_col: str = "chunk_id") -> DataFrame:
    """Candidates with the chunk's own columns; where a chunk is found they override, nulls too."""
    right = chunks.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__found"))
    both = candidates.join(right, "id", "left")
    pick = {c: F.when(F.col("__found"), F.col(f"__{c}")).otherwise(F.col(c)) if c in candidates.columns else F.col(f"__{c}") for c in columns}
    return both.withColumns(pick).drop("__found", *(f"__{c}" for c in columns))


def hybrid(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, config: SearchConfig = SearchConfig(), terms: list[str] = rules.METRIC_TERMS, index: TextIndex | None = None) -> DataFrame:
    """Hybrid search of (question_id, question, vector) over chunks: question_id, id, rank, final, dense, sparse, found_by.

    Filters choose the chunks' ids first: vectors meet them before they are compared; BM25's corpus numbers are those
    before the filters. Chunks are read again by the few candidates' ids for the columns that scores need. With an
    `index` of the chunks no text is cut into tokens."""
    plan = expanded(questions, terms=terms).withColumn("terms", X.search_terms("retrieval_query")).withColumn("query_terms", query_terms(F.col("retrieval_query"), terms))
    allowed = metadata_filter(chunks, config.filters).select(F.col("chunk_id").alias("id"))
    sparse = bm25(index or chunks, plan, config=config)
    if config.filters:
        sparse, vectors = sparse.join(allowed, "id", "left_semi"), vectors.join(allowed.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
    near = dense(vectors, plan)
    found = merged(ranked(near, "dense", "dense_rank", config.dense_limit()), ranked(sparse, "bm25", "sparse_rank", config.sparse_limit()))
    columns = [c for c in ("source_pdf", "source_id", "section", "statement_type", "metric_terms", "doc_type", "report_type", "publish_date", "source_authority_score", "display_text", "text") if c in chunks.columns]
    rows = hydrated(found, chunks, columns)
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")
    rows = rows.join(F.broadcast(plan.select("question_id", "statement_hints", "query_terms")), "question_id")
    rows = rows.withColumn("__body", X.first_of(have("display_text"), have("text")))
    # A statement type is inferred where a question asks for one and the chunk has none.
    inferred = F.when((F.size("statement_hints") > 0) & (have("statement_type") == ""), C.statement_type(have("section"), F.col("__body"))).otherwise(have("statement_type"))
    rows = rows.withColumn("__statement", inferred).withColumn("__all", F.when(F.size("query_terms") > 0, X.squeeze(F.concat_ws(" ", have("section"), have("metric_terms"), "__body"))).otherwise(""))
    rule = rule_score(F.col("statement_hints"), F.col("query_terms"), F.col("__statement"), F.col("__all"))
    fresh = freshness(have("publish_date"), C.freshness_weight(have("doc_type"), have("report_type")), config)
    authority = F.col("source_authority_score") if "source_authority_score" in columns else F.lit(1.0)
    scored = rows.withColumn("final", final_score(config, F.col("dense"), F.col("dense_rank"), F.col("sparse_rank"), fresh, authority, rule))
    out = diversified(scored, "final", X.first_of(have("source_pdf"), have("source_id")), config.source_limit(), config.top_k)
    return out.select("question_id", "id", "rank", "final", "dense", "sparse", "found_by")


def approximate_dense(vectors: DataFrame, question: Sequence[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding", bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """The k nearest by random projections, for corpora too large to scan for a question."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select(F.col(id_col).alias("id"), array_to_vector(vector_col).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=42).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(list(question)), k, distCol="distance")
    return near.select("id", (1 - F.col("distance") ** 2 / 2).alias("dense"))
