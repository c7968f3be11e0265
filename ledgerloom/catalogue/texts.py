"""Cleaning, classification, chunking and facts over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import chunking as K
from ..operators import evidence as E
from ..operators import facts as Fx
from ..operators import recall as R
from .base import query, t

WORDS = ["the", "tion", "que", "und", "ing", "license"]


@query("SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS title FROM pages")
def clean_title_tags(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.without_tags("html").alias("title"))


NOISE = "^(\\s*\\d{1,4}\\s*$|.{2,}[.．。·]{3,}\\s*\\d{1,4}\\s*$|.{0,40}(年度报告|半年度报告|季度报告)全文\\s*$)"


@query(f"SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, array_to_string(ls, chr(10)) AS clean FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '{NOISE}')) AS ls FROM documents)")
def line_noise_filter(spark, sf):
    d = t(spark, sf, "documents").withColumn("ls", C.clean_lines(F.col("text")))
    return d.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.array_join("ls", "\n").alias("clean"))


TABLE_SQL = """(SELECT doc_id, text, source, lang, len(ls) >= 3 AND ((kw >= 2 AND num >= 2) OR al >= 5) AS tabular FROM (SELECT *,
  len(list_filter(ls, lambda x: regexp_matches(x, '\\d') AND regexp_matches(x, '[%元万亿,，.]'))) AS num, len(list_filter(ls, lambda x: regexp_matches(x, '\\S+\\s{2,}\\S+'))) AS al,
  len(list_filter(['the', 'tion', 'que', 'und', 'ing', 'license'], lambda k: contains(text, k))) AS kw
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)))"""


@query(f"SELECT doc_id, tabular FROM {TABLE_SQL}")
def table_like_flag(spark, sf):
    return t(spark, sf, "documents").select("doc_id", C.table_like(F.col("text"), WORDS).alias("tabular"))


@query(f"SELECT doc_id, CASE WHEN source = 'src1' THEN 'announcement_event' WHEN source = 'src2' THEN 'image_reference' WHEN tabular AND lang IN ('en', 'de') THEN 'financial_statement' WHEN tabular THEN 'table_like' WHEN lang IN ('en', 'de') THEN 'financial_statement' WHEN lang <> '' THEN 'section_text' ELSE 'other_text' END AS kind FROM {TABLE_SQL}")
def chunk_type_rules(spark, sf):
    kind = F.when(F.col("source") == "src1", "announcement").otherwise("report")
    block = F.when(F.col("source") == "src2", "image_reference").otherwise("paragraph")
    return t(spark, sf, "documents").select("doc_id", C.chunk_type(kind, F.coalesce("lang", F.lit("")), F.col("text"), block, ["en", "de"], WORDS).alias("kind"))


RULES = {"a": ["the", "ing", "ion"], "b": ["que", "leur", "dans"], "c": ["und", "der", "die"]}


@query(
    "SELECT doc_id, CASE WHEN greatest(a, b, c) < 2 THEN '' WHEN a = greatest(a, b, c) THEN 'a' WHEN b = greatest(a, b, c) THEN 'b' ELSE 'c' END AS statement FROM (SELECT doc_id, "
    + ", ".join(f"len(list_filter({words!r}, lambda w: contains(s, w))) AS {k}" for k, words in RULES.items())
    + " FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM documents))"
)
def statement_inference(spark, sf):
    return t(spark, sf, "documents").select("doc_id", C.statement_type(F.lit(""), F.col("text"), RULES).alias("statement"))


@query("SELECT doc_id, array_to_string(list_filter(['the', 'tion', 'que', 'und', 'ing', 'license'], lambda w: contains(regexp_replace(text, '\\s+', '', 'g'), w)), ' ') AS terms FROM documents")
def metric_terms_tags(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(X.terms_in(X.squeeze("text"), WORDS), " ").alias("terms"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(['rights', 'License', 'tion'], lambda w: contains(text, w)), list_filter([CASE WHEN regexp_matches(text, '@mail\\d') THEN '@mail\\d' END, CASE WHEN regexp_matches(text, 'tion') THEN 'tion' END], lambda x: x IS NOT NULL)))), ',') AS matched FROM documents WHERE NOT regexp_matches(text, 'Apache')")
def high_value_filter(spark, sf):
    words = C.high_value_terms(F.col("text"), ["rights", "License", "tion"], {"mail": [r"@mail\d"], "tion": ["tion"]})
    return t(spark, sf, "documents").where(~F.col("text").rlike("Apache")).select("doc_id", F.array_join(words, ",").alias("matched"))


@query("SELECT doc_id, CAST(n AS BIGINT) AS nth, substr(text, CAST(n * 820 + 1 AS BIGINT), 1000) AS part FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 180) / 820.0)) AS BIGINT))) AS n FROM documents WHERE length(text) > 0)")
def fixed_size_windows(spark, sf):
    d = t(spark, sf, "documents").where(F.length("text") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 180) / 820.0))
    return d.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("nth")).select("doc_id", "nth", F.substring("text", (F.col("nth") * 820 + 1).cast("int"), F.lit(1000)).alias("part"))


@query()
def chunk_split(spark, sf):
    """Snapped windows with overlap: each part ends at a stop where one lies late enough."""
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(K.splitter(1400, 180)(F.col("text"))).alias("nth", "part"))
    return d.select("doc_id", "nth", F.length("part").alias("n_chars"), F.sha2(F.col("part").cast("binary"), 256).alias("part_sha256"))


@query()
def report_chunking(spark, sf):
    """Documents as one page each, chunked by lines, paragraphs and sections."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("page_no"), "text")
    return K.chunk_reports(d).select("source_id", "chunk_id", "chunk_index", "chunk_type", F.length("text").alias("n_chars"))


NUM = "[-+]?\\d[\\d,]*(?:\\.\\d+)?%?"
LINES_SQL = f"(SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: length(x) >= 5) AS ls FROM documents)))"
ALIASES = {"rights": ["reserved", "License"], "mail": ["@mail", "example.com"], "phone": ["+1 ("]}


@query(
    f"WITH l AS {LINES_SQL}, h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line_no, {i} AS pos, '{name}' AS metric_name, CASE {' '.join(f'WHEN contains(line, {chr(39)}{a}{chr(39)}) THEN {chr(39)}{a}{chr(39)}' for a in words)} END AS metric_alias, line FROM l" for i, (name, words) in enumerate(ALIASES.items()))
    + f"), n AS (SELECT *, replace(regexp_extract(line, '{NUM}'), ',', '') AS metric_value FROM h WHERE metric_alias IS NOT NULL), k AS (SELECT * FROM n WHERE metric_value <> '' OR metric_name = 'rights') SELECT doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS BIGINT) AS fact_no, metric_name, metric_alias, metric_value, line AS raw_line FROM k"
)
def metric_line_facts(spark, sf):
    out = Fx.chunk_facts(t(spark, sf, "documents"), F.col("text"), "doc_id", ALIASES, ["rights"])
    return out.select("chunk_id", F.col("fact_no").cast("long").alias("fact_no"), "metric_name", "metric_alias", "metric_value", "raw_line")


@query(
    f"WITH l AS {LINES_SQL} SELECT lang, metric, doc_id, value FROM (SELECT d.lang, k.metric, l.doc_id, replace(regexp_extract(l.line, '{NUM}'), ',', '') AS value, row_number() OVER (PARTITION BY d.lang, k.metric ORDER BY l.doc_id, l.line_no) AS n FROM l JOIN documents d USING (doc_id), (VALUES ('@mail'), ('reserved'), ('+1 (')) AS k(metric) WHERE contains(l.line, k.metric) AND regexp_matches(l.line, '\\d')) WHERE n = 1"
)
def first_fact_per_metric(spark, sf):
    found = Fx.chunk_facts(t(spark, sf, "documents"), F.col("text"), "doc_id", {"@mail": ["@mail"], "reserved": ["reserved"], "+1 (": ["+1 ("]}, [])
    rows = found.join(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    first = R.keep_first(rows, F.struct("lang", "metric_name"), [F.col("chunk_id"), F.col("fact_no")])
    return first.select("lang", F.col("metric_name").alias("metric"), F.col("chunk_id").alias("doc_id"), F.col("metric_value").alias("value"))


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{NUM}'), lambda x: replace(x, ',', '')), ' ') AS whole, array_to_string(list_transform(regexp_extract_all(text, '[-+]?\\d{{1,3}}(?:,\\d{{3}})*(?:\\.\\d+)?%?|[-+]?\\d+(?:\\.\\d+)?%?'), lambda x: replace(x, ',', '')), ' ') AS grouped FROM documents")
def number_extract(spark, sf):
    from ..rules import NUMBER, NUMBER_GROUPED

    return t(spark, sf, "documents").select("doc_id", F.array_join(X.numbers("text", NUMBER), " ").alias("whole"), F.array_join(X.numbers("text", NUMBER_GROUPED), " ").alias("grouped"))


@query("SELECT c_custkey, regexp_extract('#' || q || '#', '[^0-9]([0-9]{6})[^0-9]', 1) AS code FROM (SELECT c_custkey, 'name ' || lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 6 ELSE 7 END, '0') || ' of' AS q FROM customer)")
def six_digit_code(spark, sf):
    q = F.concat(F.lit("name "), F.when(F.col("c_custkey") % 3 == 0, F.lpad(F.col("c_custkey").cast("string"), 6, "0")).otherwise(F.lpad(F.col("c_custkey").cast("string"), 7, "0")), F.lit(" of"))
    return t(spark, sf, "customer").select("c_custkey", X.six_digit_code(q).alias("code"))


@query(
    f"WITH l AS {LINES_SQL}, c AS (SELECT doc_id, line_no, line, list_filter(list_transform(string_split(trim(line, '|'), '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l WHERE regexp_matches(line, '\\d')) "
    f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(len(cells) AS BIGINT) AS n_cells, coalesce(list_filter(list_transform(CASE WHEN len(cells) > 1 THEN cells[2:] ELSE cells END, lambda x: regexp_extract(x, '{NUM}')), lambda x: x <> '')[1], regexp_extract(line, '{NUM}')) AS value FROM c"
)
def metric_row_value(spark, sf):
    rows = Fx.lines(t(spark, sf, "documents").select("doc_id", "text"), F.col("text")).where(F.col("line").rlike(r"\d"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size(X.cells(F.col("line"))).cast("long").alias("n_cells"), Fx.first_number(F.col("line")).alias("value"))


@query(
    f"WITH l AS {LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN contains(line, 'License') AND (line = 'License' OR regexp_matches(line, '^\\d+[、.．]')) THEN 'License' WHEN contains(line, 'All rights') AND (line = 'All rights' OR regexp_matches(line, '^\\d+[、.．]')) THEN 'All rights' END AS section FROM l WHERE length(line) <= 40"
)
def heading_detect(spark, sf):
    rows = Fx.lines(t(spark, sf, "documents").select("doc_id", "text"), F.col("text")).where(F.length("line") <= 40)
    rows = rows.withColumn("bare", X.heading("line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), C.section_heading(F.col("bare"), ["License", "All rights"])["section"].alias("section"))


@query(
    "SELECT lang, doc_id, CAST(rank AS BIGINT) AS rank, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT lang, doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM (SELECT lang, doc_id, text, coalesce(nullif(quality, 0) * 0.5, 0) + CASE WHEN contains(text, 'the') OR contains(text, 'The') THEN 0.25 ELSE 0 END + CASE WHEN source <> '' THEN 0.05 ELSE 0 END + CASE WHEN source = 'src3' THEN 0.05 ELSE 0 END AS score, row_number() OVER (PARTITION BY lang, substr(text, 1, 200) ORDER BY doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id)) WHERE n = 1) WHERE rank <= 8"
)
def evidence_rank_top8(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = E.score([F.col("quality") * 0.5], F.col("text"), ["article"], F.coalesce("source", F.lit("")), F.coalesce(F.col("source") == "src3", F.lit(False)), {"article": ["the", "The"]})
    none = F.lit("")
    key = E.dedupe_key(F.lit("filings"), none, none, none, none, none, F.col("text"))
    out = E.ledger(d.withColumn("score", s), key, "score", "doc_id", ["lang"])
    return out.select("lang", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
