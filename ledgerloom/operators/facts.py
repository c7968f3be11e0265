"""Facts out of lines and rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify as C
from ..functions import text as X


def unit_of(body: Column, pattern: str = rules.FACT_UNIT) -> Column:
    return F.coalesce(F.regexp_extract(body, pattern, 1), F.lit(""))


def lines(chunks: DataFrame, text: Column, least: int = 5) -> DataFrame:
    """The chunk's columns with line_no (from 1) and line, stripped, of `least` characters and more."""
    every = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), X.strip), lambda x: F.length(x) >= least)
    return chunks.select("*", F.posexplode(every).alias("p", "line")).withColumn("line_no", F.col("p") + 1).drop("p")


def chunk_facts(chunks: DataFrame, text: Column, id_col: str = "chunk_id", aliases: dict[str, list[str]] = rules.FACT_ALIASES, without_number: list[str] = rules.FACTS_WITHOUT_NUMBER, number: str = rules.NUMBER, unit: str = rules.FACT_UNIT, least: int = 5) -> DataFrame:
    """chunk_id, fact_no, fact_id, metric_name, metric_alias, metric_value, unit, raw_line: for each line and metric the
    first alias that the line has, with the line's first number. The table of metrics is part of the expression,
    so nothing is joined. `number` = rules.NUMBER_GROUPED gives the form that breaks long numbers up."""
    rows = lines(chunks.select(F.col(id_col).alias("chunk_id"), text.alias("__text")), F.col("__text"), least)
    cases = [F.struct(F.lit(i).alias("at"), F.lit(name).alias("metric_name"), C.first_match([(F.col("line").contains(a), a) for a in words]).alias("metric_alias")) for i, (name, words) in enumerate(aliases.items())]
    hits = rows.select("chunk_id", "line_no", F.col("line").alias("raw_line"), unit_of(F.col("__text"), unit).alias("unit"), F.coalesce(F.get(X.numbers("line", number), 0), F.lit("")).alias("metric_value"), F.explode(F.filter(F.array(*cases), lambda c: c["metric_alias"] != "")).alias("m"))
    hits = hits.select("chunk_id", "line_no", "raw_line", "unit", "metric_value", "m.at", "m.metric_name", "m.metric_alias").where((F.col("metric_value") != "") | F.col("metric_name").isin(*without_number, ""))
    numbered = hits.withColumn("fact_no", F.row_number().over(W.partitionBy("chunk_id").orderBy("line_no", "at")))
    return numbered.select("chunk_id", "fact_no", F.concat_ws("_", F.col("chunk_id").cast("string"), F.lpad(F.col("fact_no").cast("string"), 4, "0"), "metric_name").alias("fact_id"), "metric_name", "metric_alias", "metric_value", "unit", "raw_line")


def rows_of(body: Column) -> Column:
    """Lines with | as they are, other lines split where two blanks or more stand."""
    parts = F.transform(F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), X.strip), lambda x: x != ""), lambda x: F.when(x.contains("|"), F.array(x)).otherwise(F.filter(F.transform(F.split(x, r"\s{2,}"), X.strip), lambda y: y != "")))
    return F.flatten(parts)


def metric_row(row: Column, metric: str, aliases: dict[str, list[str]] = rules.EVIDENCE_ALIASES, negative: list[str] = rules.NEGATIVE_HINTS) -> Column:
    """Whether a row is about the metric: an alias is there, and for net profits no sign of another kind of profit."""
    compact = F.lower(X.squeeze(row))
    named = F.lit(False)
    for a in aliases.get(metric, [metric]):
        named = named | compact.contains("".join(a.split()).lower())
    hint = lambda words: C.has(compact, words)
    if metric == "归母净利润":
        return named & ~hint(["扣除", "扣非"]) & (compact.contains("归") | F.lower(row).contains("attributable"))
    if metric == "净利润":
        return named & ~hint(negative) & compact.contains("净利润") & ~compact.contains("归")
    return named


def first_number(row: Column, number: str = rules.NUMBER) -> Column:
    """The first number in the cells after the first, else in the row."""
    cells = X.cells(row)
    data = F.when(F.size(cells) > 1, F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    found = F.filter(F.transform(data, lambda c: F.regexp_extract(c, f"({number})", 1)), lambda v: v != "")
    return F.coalesce(F.get(found, 0), F.regexp_extract(row, f"({number})", 1))


def metric_value(body: Column, metric: str, aliases: dict[str, list[str]] = rules.EVIDENCE_ALIASES, negative: list[str] = rules.NEGATIVE_HINTS, window: int = 220, near: int = 100) -> Column:
    """The number in the first row about the metric; else the first one within `window` characters after an alias
    that no negative hint follows within `near`."""
    rows = F.filter(F.transform(F.filter(rows_of(body), lambda r: metric_row(r, metric, aliases, negative)), lambda r: first_number(r)), lambda v: v != "")
    after = []
    for a in aliases.get(metric, [metric]):
        at = F.locate(a.lower(), F.lower(body))
        tail = F.when(at > 0, F.substring(body, at + len(a), F.lit(window)))
        after.append(F.when(~C.has(F.substring(tail, 1, near), negative), F.nullif(F.regexp_extract(tail, f"({rules.NUMBER})", 1), F.lit(""))))
    return F.coalesce(F.get(rows, 0), *after, F.lit(""))


def content_unit(body: Column) -> Column:
    return C.first_match([(body.contains(u), u) for u in ("千元", "万元", "%")])


def first_facts(evidence: DataFrame, metrics: list[str], rank: str = "rank", body: str = "content", keys: tuple[str, ...] = ("question_id",), carry: tuple[str, ...] = ("citation",)) -> DataFrame:
    """keys, metric, value, unit, evidence rank and `carry`: for each metric the value of the best evidence with one."""
    cases = F.array(*(F.struct(F.lit(m).alias("metric"), metric_value(F.col(body), m).alias("value")) for m in metrics))
    rows = evidence.select(*keys, rank, *carry, content_unit(F.col(body)).alias("unit"), F.explode(cases).alias("f")).select(*keys, rank, *carry, "unit", "f.metric", "f.value").where("value != ''")
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "metric").orderBy(rank))).where("__n = 1").drop("__n")
