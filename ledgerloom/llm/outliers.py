"""Rejecting documents as robust multivariate outliers. DataFrame functions only.

Each text becomes a vector of transformed statistics. For every language and source a minimum covariance
determinant estimate gives a centre and a scatter of the most concentrated `share` of its texts. It has three starts:
medians and absolute deviations, the mean and scatter of all, and those of the half that lies nearest to the
medians. From each, two concentration steps take the texts nearest by Mahalanobis distance and estimate anew; the
start whose scatter then has the least determinant goes on, step by step, until its determinant falls no more. A
text whose squared distance from its group's estimate lies beyond `cutoff`, scaled so that the group's median
distance agrees with the chi-squared median, is rejected; so are texts that fail the base rules.

Medians and quantiles are `percentile_approx`, whose sketches merge: no group is gathered in one task, and
one with a third of all rows costs no more than many small ones. A group of fewer than `small` texts is too small
for an estimate of four centres and ten scatters: its texts are held against the estimate of all texts of their
language, and if those are too few against that of all texts.

Defined results: a null or empty text has no words and fails; null languages and sources are groups of their
own; repeated rows count each and get the same verdict; equal distances are all in or all out of a step; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

WINDOW_WORDS = 5
#: The chi-squared distribution with 4 degrees of freedom: its median, and its 1 - 1e-6 quantile as cutoff.
FEATURES, CHI_MEDIAN, CUTOFF = 4, 3.3567, 33.38
FIRST_STEPS, SHARE, SMALL, BROADCAST_GROUPS, SALTS = 2, 0.75, 20, 50_000, 32
#: By what share a determinant must fall for another step.
FALL = 1e-6
#: Standard deviations that are added to every scatter: most texts have no symbols and no repetition at all,
#: and a scatter of zero would reject any other (a regularised determinant estimate).
FLOORS = (0.06, 0.05, 0.1, 0.3)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_letters and `keep`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *(F.col(k).alias(f"k_{k}") for k in keep), text.alias("t"))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    a = base.withColumn("ws", words).withColumn("n_words", F.size("ws").cast("long"))
    a = a.withColumn("flat", F.translate("t", "\t\n\x0b\x0c\r ", "")).withColumn("word_chars", F.length("flat").cast("long"))
    plain = F.translate("t", "#*$%&|<>", "")
    a = a.withColumn("n_symbols", (F.length("t") - F.length(plain)).cast("long"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, "\t\x0b\x0c\r ", "") != "")
    a = a.withColumn("ls", lines).withColumn("n_dup_lines", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"))
    n = WINDOW_WORDS
    at = lambda i: [F.get("ws", i + k) for k in range(n)]
    hashes = F.when(F.size("ws") > n, F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("hs", hashes).withColumn("twice", F.size(F.array_distinct("hs")) < F.size("hs"))
    # Only texts with a repeated window sort theirs: neighbours in that order share a window's words.
    ordered = F.when(F.col("twice"), F.array_sort(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    a = a.withColumn("os", ordered)
    a = a.withColumn("hits", F.filter("os", lambda x, i: F.coalesce(F.get("os", i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.when(i > 0, F.get("os", i - 1)["h"] == x["h"]), F.lit(False))))
    a = a.withColumn("starts", F.array_sort(F.transform("hits", lambda x: x["i"])))
    covered = F.aggregate(F.transform("starts", lambda s, i: F.least(F.lit(n), F.coalesce(F.get("starts", i + 1) - s, F.lit(n)))), F.lit(0), lambda x, y: x + y)
    a = a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return a.select("doc_id", *(F.col(f"k_{k}") for k in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.size("ls").cast("long").alias("n_lines"))


def vector(stats: DataFrame) -> DataFrame:
    """Adds x0 to x3: word length, symbols a word, repetition and line length, on scales that are near normal."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    lines = F.greatest("n_lines", F.lit(1)).cast("double")
    return (
        stats.withColumn("x0", F.log1p(F.col("word_chars") / words))
        .withColumn("x1", F.col("n_symbols") / words)
        .withColumn("x2", F.col("n_repeat_words") / words + F.col("n_dup_lines") / lines)
        .withColumn("x3", F.log1p(words / lines))
    )


X = [f"x{i}" for i in range(FEATURES)]


def _distance(p: str = "p") -> Column:
    """Squared Mahalanobis distance of x from p's centre: forward substitution with its Cholesky factor."""
    z: list[Column] = []
    for i in range(FEATURES):
        s = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            s = s - F.col(f"l{i}{j}") * z[j]
        z.append(s / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _with_factor(df: DataFrame) -> DataFrame:
    """Cholesky factor l of the scatter c, kept regular by FLOORS squared on its diagonal, column by column, and det,
    its determinant."""
    for i in range(FEATURES):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2 if i == j else 0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[i] ** 2 / 4))) if i == j else s / F.col(f"l{j}{j}"))
    diagonal = [F.col(f"l{i}{i}") * F.col(f"l{i}{i}") for i in range(FEATURES)]
    return df.withColumn("det", diagonal[0] * diagonal[1] * diagonal[2] * diagonal[3]).drop(*(f"c{i}{j}" for i in range(FEATURES) for j in range(i + 1)))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """Centre and scatter of x by group, in central moments, whose partial results merge without cancellation."""
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)] + [F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i in range(FEATURES) for j in range(i + 1)]
    return _with_factor(rows.groupBy(*by).agg(*sums))


def _beside(rows: DataFrame, found: DataFrame, by: str, many: bool) -> DataFrame:
    """rows with their group's estimates. Up to BROADCAST_GROUPS groups they are broadcast; beyond, a group's rows are
    dealt over SALTS tasks, so that a large group isn't read by one."""
    if not many:
        return rows.join(F.broadcast(found), by)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)))
    return salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [by, "salt"]).drop("salt")


def _share(c: str, share: float) -> Column:
    return F.percentile_approx(c, F.lit(share), F.lit(10_000))


def _concentrated(rows: DataFrame, now: DataFrame, by: str, share: float, many: bool) -> DataFrame:
    """The estimates (by, start) of the `share` of rows that lie nearest to each estimate of `now`."""
    near = _beside(rows, now, by, many).withColumn("d", _distance())
    limit = stored(near.groupBy(by, "start").agg(_share("d", share).alias("limit")), "mcd-limit")
    both = now.join(limit.withColumnsRenamed({by: "__by", "start": "__start"}), (F.col(by) == F.col("__by")) & (F.col("start") == F.col("__start"))).drop("__by", "__start")
    core = _beside(rows, both, by, many).withColumn("d", _distance()).where("d <= limit")
    return stored(_moments(core.select(by, "start", *X), by, "start"), "mcd-step")


def estimate(rows: DataFrame, by: str = "g", share: float = SHARE) -> DataFrame:
    """g, m, l, det and scale for rows (g, x): one row a group. All passes read the narrow rows alone."""
    middle = stored(rows.groupBy(by).agg(*(_share(x, 0.5).alias(f"m{i}") for i, x in enumerate(X))), "mcd-middle")
    many = middle.count() > BROADCAST_GROUPS
    apart = _beside(rows, middle, by, many).select(by, *(f"m{i}" for i in range(FEATURES)), *(F.abs(F.col(x) - F.col(f"m{i}")).alias(f"a{i}") for i, x in enumerate(X)))
    spread = apart.groupBy(by).agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(FEATURES)), *(F.pow(_share(f"a{i}", 0.5) * 1.4826, F.lit(2)).alias(f"c{i}{i}") for i in range(FEATURES)))
    spread = spread.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(FEATURES) for j in range(i)})
    medians = stored(_with_factor(spread).withColumn("start", F.lit("medians")), "mcd-medians")
    means = _moments(rows, by).withColumn("start", F.lit("means"))
    half = _concentrated(rows, medians, by, 0.5, many).withColumn("start", F.lit("half"))
    now = stored(medians.unionByName(means).unionByName(half), "mcd-starts")
    for _ in range(FIRST_STEPS):
        now = _concentrated(rows, now, by, share, many)
    columns = [c for c in now.columns if c != by]
    best = now.groupBy(by).agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("x")).select(by, "x.*")
    done, open_ = None, stored(best, "mcd-best")
    while True:  # a determinant that fell last time may fall again; the others are done
        new = _concentrated(rows, open_, by, share, many)
        after = stored(open_.join(new.select(F.col(by).alias("__by"), *(F.col(c).alias(f"n_{c}") for c in columns)), F.col(by) == F.col("__by")).withColumn("fell", F.col("n_det") < F.col("det") * (1 - FALL)), "mcd-next")
        settled = after.where("not fell").select(by, *columns)
        done = settled if done is None else done.unionByName(settled)
        open_ = after.where("fell").select(by, *(F.col(f"n_{c}").alias(c) for c in columns))
        if open_.isEmpty():
            break
    found = stored(done, "mcd-found")
    scale = _beside(rows, found, by, many).withColumn("d", _distance()).groupBy(by).agg((_share("d", 0.5) / CHI_MEDIAN).alias("scale"))
    return stored(found.join(scale, by), "mcd")


def _few(groups: DataFrame) -> DataFrame:
    """A table of a row a group: broadcast if there are few; else joined as Spark sees fit, splitting what is skewed."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def reject_outliers(docs: DataFrame, cutoff: float = CUTOFF, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (squared, scaled; null if it failed) and kept."""
    stats = vector(statistics(docs, id_col, text_col, (lang_col, source_col)))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"k_{c}")), F.lit("-"))
    lang, own = F.concat(F.lit("l"), name(lang_col)), F.concat_ws("\x1f", name(lang_col), name(source_col))
    rows = stored(stats.withColumn("base_failed", failed).withColumn("own", own).withColumn("lang", lang).drop(f"k_{lang_col}", f"k_{source_col}"), "outlier-rows")
    good = rows.where(~F.col("base_failed"))
    sizes = stored(good.groupBy("own", "lang").agg(F.count("*").alias("n")), "outlier-groups")
    in_lang = sizes.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"))
    held = sizes.join(in_lang, F.col("lang") == F.col("of_lang"))
    grouped = stored(held.select("own", F.when(F.col("n") >= small, F.col("own")).when(F.col("n_lang") >= small, F.col("lang")).otherwise("*").alias("g")), "outlier-grouped")
    # A text belongs to each estimate that it's part of: its group's, and those that some small group is held against.
    asked = grouped.select(F.col("g").alias("a")).distinct()
    each = good.select(F.explode(F.array("own", "lang", F.lit("*"))).alias("g"), *X)
    placed = stored(each.join(_few(asked), F.col("g") == F.col("a"), "left_semi"), "outlier-x")
    fit = estimate(placed)
    judged = rows.join(_few(grouped), "own", "left").join(_few(fit), "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.greatest("scale", F.lit(1.0))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))


def op10_outliers(spark, sf_dir: str) -> DataFrame:
    return reject_outliers(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
