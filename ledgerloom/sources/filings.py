"""Reading filings' inputs: company lists, cases, filing lists, parsed pages, recorded payloads."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import rules
from ..functions import classify as C
from ..functions import text as X
from ..operators.maintain import evolved

CASE = "question string, gold_answer string, positive_contexts array<string>, seed_context string, metadata_filter struct<code: string, year: int, report_type: string, doc_type: string, chunk_type: string, statement_type: string>, expected_section string, expected_statement_type string, metric_terms array<string>"


def companies(spark: SparkSession, path: str) -> DataFrame:
    """industry, code (six digits), company, org_id: trimmed, a byte order mark dropped, rows without a code left out."""
    rows = spark.read.csv(path, header=True)
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in rows.columns})
    rows = evolved(rows, {"org_id": "string", "industry": "string", "company": "string"})
    trimmed = rows.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("industry", "code", "company", "org_id"))).where("code != ''")
    return trimmed.withColumn("code", F.when(F.length("code") < 6, F.lpad("code", 6, "0")).otherwise(F.col("code")))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path).where("question is not null")


def work_list(companies_: DataFrame, years: list[int], types: list[str]) -> DataFrame:
    """company x year x type: both lists are parameters, a few values each."""
    return companies_.select("*", F.explode(F.array(*map(F.lit, years))).alias("year")).select("*", F.explode(F.array(*map(F.lit, types))).alias("report_type"))


def report_candidates(items: DataFrame, code: str = "code") -> DataFrame:
    """Filing items (secCode, announcementTitle, adjunctUrl, announcementId, announcementTime) as reports, the newest of
    each code, year and type."""
    rows = items.select(
        F.lpad(F.trim("secCode"), 6, "0").alias("code"),
        X.without_tags("announcementTitle").alias("title"),
        F.coalesce("adjunctUrl", F.lit("")).alias("source_url"),
        F.col("announcementId").alias("announcement_id"),
        X.published("announcementTime").alias("publish_date"),
    ).withColumn("report_type", C.report_type(F.col("title")))
    good = rows.where("title != '' and source_url != '' and report_type != ''")
    # An annual report is published in the year after it.
    good = good.withColumn("year", F.year("publish_date") - F.when(F.col("report_type") == "annual", 1).otherwise(0))
    return good.groupBy("code", "year", "report_type").agg(F.max_by(F.struct("title", "source_url", "announcement_id", "publish_date"), F.struct("publish_date", "announcement_id")).alias("x")).select("code", "year", "report_type", "x.*")


def announcements(items: DataFrame) -> DataFrame:
    """High-value announcements with their category, tags and keywords."""
    rows = items.select(F.lpad(F.trim("secCode"), 6, "0").alias("code"), X.without_tags("announcementTitle").alias("title"), F.coalesce("adjunctUrl", F.lit("")).alias("source_url"), F.col("announcementId").alias("announcement_id"), X.published("announcementTime").alias("publish_date"))
    rows = rows.where((F.col("title") != "") & (F.col("source_url") != "") & ~F.col("title").rlike(rules.ANNOUNCEMENT_EXCLUDED))
    words, tags = C.high_value_terms(F.col("title")), C.categories(F.col("title"))
    return rows.where(F.size(words) > 0).select("*", F.element_at(tags, 1).alias("announcement_category"), F.array_join(tags, ",").alias("announcement_tags"), F.array_join(words, ",").alias("matched_keywords"))


def sources(reports: DataFrame, announcements_: DataFrame) -> DataFrame:
    """Downloaded reports and announcements as one list of sources with aligned columns."""
    done = (F.col("download_status") == "downloaded") & (F.coalesce("pdf_path", F.lit("")) != "")
    report = reports.where(done).select(F.concat_ws("_", "code", "year", "report_type").alias("source_id"), F.lit("report").alias("doc_type"), "code", "company", "year", "report_type", "title", "publish_date", F.lit("").alias("announcement_category"))
    other = announcements_.where(done).select(F.concat_ws("_", "code", "announcement_id").alias("source_id"), F.lit("announcement").alias("doc_type"), "code", "company", F.coalesce(F.substring("publish_date", 1, 4).try_cast("int"), F.lit(0)).alias("year"), F.lit("announcement").alias("report_type"), "title", "publish_date", F.coalesce("announcement_category", F.lit("")).alias("announcement_category"))
    return report.unionByName(other)


def chosen_text(parsers: list[Column], least: int = 500) -> Column:
    """The first parser's text that is long enough; the last one's as it is."""
    return F.coalesce(*(F.when(F.length(p) >= least, p) for p in parsers[:-1]), parsers[-1])


def markdown_pages(files: DataFrame, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """source_id, page_no, text of markdown with page separators ({n} or n, then 20 dashes or more); without any, page 1."""
    marked = F.regexp_replace(F.col(text_col), r"(?m)^\s*\{?(\d+)\}?\s*-{20,}\s*$", "\x1e$1\x1f")
    parts = files.select(F.col(id_col).alias("source_id"), F.posexplode(F.split(marked, "\x1e")).alias("at", "part"))
    number = F.regexp_extract("part", r"^(\d+)\x1f", 1)
    rows = parts.select("source_id", "at", F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") + 1).alias("n"), X.strip(F.regexp_replace("part", r"^\d+\x1f", "")).alias("text"))
    return rows.where("text != ''").groupBy("source_id", F.greatest("n", F.lit(1)).alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def _nodes(node, page: int) -> Iterator[tuple[int, str]]:
    """(page, markdown) of a parser's tree, in reading order."""
    if isinstance(node, str):
        if node.strip():
            yield page, node.strip()
        return
    if isinstance(node, list):
        for x in node:
            yield from _nodes(x, page)
        return
    if not isinstance(node, dict):
        return
    kind, page = str(node.get("type") or "").lower(), int(node.get("page number") or page or 1)
    if kind in ("header", "footer"):
        return
    if kind == "table":
        rows = [[" ".join(t for _, t in _nodes(c, page)) for c in r.get("cells") or []] for r in node.get("rows") or []]
        width = max(map(len, rows), default=0)
        if width:
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            yield page, "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])
        return
    if kind == "heading":
        depth = min(6, max(1, int(node.get("heading level") or 1)))
        text = " ".join(t for _, t in _nodes(node.get("content"), page))
        if text:
            yield page, f"{'#' * depth} {text}"
    else:
        yield from _nodes(node.get("content"), page)
    yield from _nodes(node.get("kids"), page)


def tree_pages(files: DataFrame, id_col: str = "source_id", json_col: str = "json") -> DataFrame:
    """source_id, page_no, text of a parser's JSON trees. Trees nest to any depth, so a table function walks them."""
    @F.udtf(returnType="page_no int, seq int, part string")
    class Walk:
        def eval(self, raw: str):
            for i, (page, part) in enumerate(_nodes(json.loads(raw), 1) if raw else ()):
                yield page, i, part

    parts = files.select(F.col(id_col).alias("source_id"), F.col(json_col).alias("j")).lateralJoin(Walk(F.col("j").outer())).select("source_id", "page_no", "seq", "part")
    return parts.groupBy("source_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def file_path(code: Column, name: Column, title: Column, kind: str = "raw", root: str = "data") -> Column:
    return F.concat(F.lit(f"{root}/{kind}/"), code, F.lit("/"), name, F.lit("_"), X.file_part(title), F.lit(".pdf"))


class PagedSource(DataSource):
    """A paged service as a Spark source, a partition a company: option `companies` (comma-separated), `max_pages`,
    `page_size`. `fetch(company, page, page_size)` gives a page's items as JSON texts; pages end at a short one."""

    fetch: Callable[[str, int, int], list[str]] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return "company string, page int, item string"

    def reader(self, schema):
        return _PagedReader(self.options, type(self).fetch)


class _PagedReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.companies = [c for c in options.get("companies", "").split(",") if c]
        self.most, self.size, self.fetch = int(options.get("max_pages", "10")), int(options.get("page_size", "30")), fetch

    def partitions(self):
        return [InputPartition(c) for c in self.companies]

    def read(self, partition):
        for page in range(1, self.most + 1):
            items = self.fetch(partition.value, page, self.size) if self.fetch else []
            for item in items:
                yield partition.value, page, item
            if len(items) < self.size:
                return


