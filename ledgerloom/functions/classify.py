"""Rule classification, as column expressions: ordered rules become chains of when()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import text as X


def first_match(cases: list[tuple[Column, Column | str]], default: Column | str = "") -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    head, *rest = cases
    return reduce(lambda w, c: w.when(c[0], lit(c[1])), rest, F.when(head[0], lit(head[1]))).otherwise(lit(default))


def has(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(t) for t in terms))


def statement_type(section: Column, body: Column, table: dict[str, list[str]] = rules.STATEMENT_RULES, least: int = 2) -> Column:
    """A keyword in the section decides; else the type with most keywords in section and body, `least` of them,
    the first type winning a tie."""
    def by_body(both: Column) -> Column:
        hits = F.array(*(F.struct(X.count_in(both, words).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(table.items())))
        return X.let(F.array_max(hits), lambda best: F.when(best["n"] >= least, best["name"]).otherwise(""))

    by_section = X.let(X.squeeze(section), lambda head: first_match([(has(head, words), name) for name, words in table.items()]))
    return X.let(by_section, lambda found: F.when(found != "", found).otherwise(X.let(X.squeeze(F.concat_ws("\n", section, body)), by_body)))


def metric_terms(section: Column, body: Column, terms: list[str] = rules.METRIC_TERMS, labels: dict[str, str] = rules.STATEMENT_LABELS, table: dict[str, list[str]] = rules.STATEMENT_RULES) -> Column:
    """The terms in section and body, after the statement's label, joined by spaces."""
    label = X.let(statement_type(section, body, table), lambda s: first_match([(s == k, v) for k, v in labels.items()]))
    found = F.concat(F.array(label), X.let(X.squeeze(F.concat_ws("\n", section, body)), lambda both: X.terms_in(both, terms)))
    return F.array_join(F.array_distinct(F.filter(found, lambda t: t != "")), " ")


def categories(title: Column, table: dict[str, list[str]] = rules.ANNOUNCEMENT_CATEGORIES, other: str = rules.OTHER_CATEGORY) -> Column:
    """All categories with a pattern that the title matches, in the table's order; `other` if there's none."""
    tags = F.array_compact(F.array(*(F.when(title.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in table.items())))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(other)))


def category_patterns(title: Column, table: dict[str, list[str]] = rules.ANNOUNCEMENT_CATEGORIES) -> Column:
    return F.array_compact(F.array(*(F.when(title.rlike(p), F.lit(p)) for patterns in table.values() for p in patterns)))


def high_value_terms(title: Column, keywords: list[str] = rules.HIGH_VALUE, table: dict[str, list[str]] = rules.ANNOUNCEMENT_CATEGORIES) -> Column:
    """Sorted distinct keywords and category patterns of a title."""
    return F.array_sort(F.array_distinct(F.concat(X.terms_in(title, keywords), category_patterns(title, table))))


def report_type(title: Column, table: dict[str, str] = rules.REPORT_TITLES, excluded: str = rules.REPORT_EXCLUDED) -> Column:
    return F.when(title.rlike(excluded), "").otherwise(first_match([(title.rlike(table[k]), k) for k in ("semiannual", "q1", "q3", "annual") if k in table]))


def noise_line(line: Column, announcement: bool = False, noise: list[str] = rules.LINE_NOISE, more: list[str] = rules.ANNOUNCEMENT_NOISE) -> Column:
    patterns = noise + (more if announcement else [])
    return (X.strip(line) == "") | X.strip(line).rlike("(?U)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def clean_lines(body: Column, announcement: bool = False, **tables) -> Column:
    return F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), X.strip), lambda x: ~noise_line(x, announcement, **tables))


def tabular(lines, keywords, units, numeric, aligned):
    """Whether so many lines, distinct keywords, lines with a unit, with numbers and with columns are a table. Counts are
    numbers or columns: this is the one place that knows the thresholds."""
    return (lines >= 3) & ((((keywords >= 2) | (units > 0)) & (numeric >= 2)) | (aligned >= 5))


def numeric_line(line: Column) -> Column:
    return line.rlike(r"\d") & line.rlike("[%元万亿,，.]")


def aligned_line(line: Column) -> Column:
    return line.rlike(r"\S+\s{2,}\S+")


def table_like(body: Column, keywords: list[str] = rules.TABLE_KEYWORDS, unit: str = rules.TABLE_UNIT) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda x: X.strip(x) != "")
    count = lambda test: F.size(F.filter(lines, test))
    return tabular(F.size(lines), X.count_in(body, keywords), body.rlike(unit).cast("int"), count(numeric_line), count(aligned_line))


def chunk_type(doc_type: Column, section: Column, body: Column, block_type: Column, statements: list[str] = rules.STATEMENT_SECTIONS, keywords: list[str] = rules.TABLE_KEYWORDS) -> Column:
    tabular = (block_type == "table_like") | table_like(body, keywords)
    return first_match(
        [
            (doc_type == "announcement", "announcement_event"),
            (block_type == "image_reference", "image_reference"),
            (tabular & has(section, statements), "financial_statement"),
            (tabular, "table_like"),
            (has(section, ["管理层讨论", "经营情况讨论"]), "management_discussion"),
            (has(section, ["风险因素"]), "risk_item"),
            (has(section, ["公司业务概要"]), "business_overview"),
            (has(section, statements), "financial_statement"),
            (section != "", "section_text"),
        ],
        "other_text",
    )


def section_kinds(section: Column) -> Column:
    """struct<plain, tabular>: the types of a report's text and tables under a section."""
    kind = lambda block: chunk_type(F.lit("report"), section, F.lit(""), F.lit(block))
    return F.struct(kind("").alias("plain"), kind("table_like").alias("tabular"))


def section_by_body(section: Column, body: Column, table: dict[str, list[str]] = rules.SECTION_BY_BODY, generic: str = "财务报表") -> Column:
    """The section itself unless blank or generic; else the first whose name or two keywords the body has."""
    return first_match([((section != "") & (section != generic), section), *((body.contains(name) | (X.count_in(body, words) >= 2), name) for name, words in table.items())], section)


def section_heading(bare: Column, sections: list[str] = rules.REPORT_SECTIONS) -> Column:
    """struct<section, level> of a heading line, else null. `bare` is a column of text.heading(line): each of many cases
    looks at it, so it must be computed before."""
    s = bare
    number = r"^(?:[一二三四五六七八九十]+、|\d+[、.．]|（[一二三四五六七八九十\d]+）|\([一二三四五六七八九十\d]+\))"
    prefix = r"^\s*(?:第[一二三四五六七八九十百\d]+[章节]|[一二三四五六七八九十\d]+[、.．]|（[一二三四五六七八九十\d]+）|\([一二三四五六七八九十\d]+\))\s*(.+?)\s*$"
    numbered = s.startswith("第") | s.rlike(number)
    level = F.when(s.startswith("第"), 1).otherwise(2)
    found = lambda name, at: F.struct(F.lit(name).alias("section"), at.cast("int").alias("level"))
    short = [((F.length(s) <= 40) & s.contains(k) & ((s == k) | numbered), found(k, level)) for k in sections]
    title = F.regexp_extract(s, prefix, 1)
    longer = [((F.length(s) <= 50) & s.rlike(prefix) & title.contains(k), found(k, F.lit(2))) for k in sections]
    head, *rest = short + longer
    return reduce(lambda w, c: w.when(*c), rest, F.when(*head))


def freshness_weight(doc_type: Column, report_type: Column, table: dict[str, float] = rules.FRESHNESS) -> Column:
    named = [(doc_type == "announcement", F.lit(table["announcement"])), *((report_type == k, F.lit(v)) for k, v in table.items() if k not in ("announcement", "other"))]
    return first_match(named, F.lit(table["other"]))
