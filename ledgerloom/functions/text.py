"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_of(*cs: Column | str) -> Column:
    """The first that is neither null nor blank, or ''."""
    return F.coalesce(*(blank_to_null(c) for c in cs), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """All white space removed."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", "")


def normalised(c: Column | str) -> Column:
    """Wide spaces made plain, runs of blanks one, at most one empty line in a row, stripped."""
    plain = F.regexp_replace(F.translate(col(c), "　", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))


def name_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))


def without_tags(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", ""))


def heading(c: Column | str) -> Column:
    """A markdown heading's bare text."""
    s = normalised(c)
    for pattern in (r"^\{\d+\}-+\s*", r"^\s{0,3}#{1,6}\s*", r"^\s*[-*+]\s+", r"(?i)</?br\s*/?>", "[*_`]+"):
        s = F.regexp_replace(s, pattern, "")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def file_part(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r'(?U)[\\/:*?"<>|\s]+', "_"), F.lit("_"))


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 2).cast("int"))


def parsed_date(c: Column | str) -> Column:
    """The first ten characters as a date, in one of three forms, else null."""
    s = F.substring(strip(F.coalesce(col(c), F.lit("")).cast("string")), 1, 10)
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")))


def published(millis: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(millis)), "yyyy-MM-dd")


def search_terms(query: Column | str, most: int = 24) -> Column:
    """Lower-cased distinct runs of letters and digits, `most` of them."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(col(query)), F.lit(r"([\p{L}\p{N}]+)"), 1)), 1, most)


def numbers(c: Column | str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(f"({pattern})"), 1), lambda v: F.replace(v, F.lit(","), F.lit("")))


def six_digit_code(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?<!\d)(\d{6})(?!\d)", 1)


def year_in(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?<!\d)(20\d{2})(?!\d)", 1)


def ticker(c: Column | str, stop: Iterable[str]) -> Column:
    """The first ticker that no stop word is: $X, (X), "ticker X", else a bare upper-case word."""
    one, tail = r"([A-Z]{1,5}(?:\.[A-Z])?)", r"(?![A-Z])"
    marked = [F.regexp_extract(col(c), p, 1) for p in (r"\$" + one + tail, r"\(" + one + r"\)", r"(?i)\b(?:ticker|symbol)\s*[:=]?\s*" + one + r"\b")]
    bare = F.regexp_extract_all(col(c), F.lit(rf"(?U)\b{one}\b"), 1)
    every = F.transform(F.concat(F.array(*marked), bare), F.upper)
    good = F.filter(every, lambda t: (t != "") & ~t.isin(*stop))
    return F.coalesce(F.get(good, 0), F.lit(""))


def any_in(c: Column | str, terms: Iterable[str]) -> Column:
    """Whether the text has any of the terms, in any case."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return out


def terms_in(c: Column, terms: Iterable[str]) -> Column:
    """The terms that the text has, in their order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def count_in(c: Column, terms: Iterable[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(c, F.lit(t)).cast("int")
    return out


def trimmed(c: Column | str, most: int) -> Column:
    """At most `most` characters, with a mark where some were cut."""
    return F.when(F.length(col(c)) > most, F.concat(F.rtrim(F.substring(col(c), 1, most)), F.lit("\n...[truncated]"))).otherwise(col(c))


def cells(row: Column) -> Column:
    bare = F.regexp_replace(strip(row), r"^\|+|\|+$", "")
    return F.filter(F.transform(F.split(bare, r"\|"), strip), lambda x: x != "")


def json_object(c: Column | str) -> Column:
    """The text from the first { to the last }."""
    return F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)


def says_yes(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(col(c), F.lit("")))).startswith("y")


def years(c: Column | str) -> Column:
    """'2023-2025,2027' as sorted distinct numbers."""
    parts = F.filter(F.transform(F.split(col(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.sequence(F.element_at(F.split(p, "-"), 1).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(ends)))


def clamped(c: Column, default: int, most: int) -> Column:
    """A limit: null and 0 mean the default; from 1 to `most`."""
    return F.least(F.greatest(F.coalesce(F.nullif(c, F.lit(0)), F.lit(default)), F.lit(1)), F.lit(most))


def cjk_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\x{4e00}-\x{9fff}]", ""))


def image_target(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract(col(c), pattern, 1)
