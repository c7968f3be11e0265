import re
from collections import Counter
from itertools import combinations

import numpy as np

from ledgerloom.llm import outliers as O

WORD = r"[^\x20\x09-\x0D]+"


def stats(t):
    t = t or ""
    w = re.findall(WORD, t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 5)}
    ls = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit), len(ls)


TEXTS = [None, "", " \n", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "one two\none two\n\nthree|four # 5", "é ü\x0bß\t$", "a b c d e f g\n" * 40, "w " * 20_000, "p q r s t u p q r s t v p q r s t"]


def test_statistics_against_brute_force(spark, sf):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as ws")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in O.statistics(df).collect()}
    assert got == {i: stats(t) for i, t in rows}


FLOOR = np.diag(np.array(O.FLOORS) ** 2)


def quantile(v, p):
    return np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]


def distances(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def mcd(x):
    """The same estimate in numpy, with exact quantiles: centre and regularised scatter."""
    def step(m, c, share):
        d = distances(x, m, c)
        core = x[d <= quantile(d, share)]
        return core.mean(0), np.cov(core.T, bias=True) + FLOOR

    m = np.array([quantile(c, 0.5) for c in x.T])
    medians = m, np.diag([(1.4826 * quantile(np.abs(v - k), 0.5)) ** 2 for v, k in zip(x.T, m)]) + FLOOR
    starts = [step(*medians, 0.5), (x.mean(0), np.cov(x.T, bias=True) + FLOOR), medians]
    for _ in range(O.FIRST_STEPS):
        starts = [step(*s, O.SHARE) for s in starts]
    best = min(starts, key=lambda s: np.linalg.det(s[1]))
    while np.linalg.det((new := step(*best, O.SHARE))[1]) < np.linalg.det(best[1]) * (1 - O.FALL):
        best = new
    return best


def scaled(x, of):
    m, c = mcd(of)
    return distances(x, m, c) / max(1.0, quantile(distances(of, m, c), 0.5) / O.CHI_MEDIAN)


def test_least_determinant_of_all_subsets(spark):
    """Small groups with planted outliers: no subset of the size has a smaller determinant, by trying all."""
    r, rows = np.random.default_rng(4), []
    for g in range(6):
        x = r.normal(0, 1, (12, 4)) * [0.5, 1, 2, 1] + g
        x[9:] += r.choice([-1, 1], (3, 4)) * 12
        rows += [(f"g{g}", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")
    for got in O.estimate(df).collect():
        x = np.array([v[1:] for v in rows if v[0] == got.g])
        least = min(np.linalg.det(np.cov(x[list(k)].T, bias=True) + FLOOR) for k in combinations(range(12), 9))
        assert abs(got.det - least) <= 1e-9 * least


def test_ties_and_constants(spark):
    rows = [("same", 1.0, 0.0, 0.0, 2.0)] * 30 + [("two", float(i % 2), 0.0, 0.0, 1.0) for i in range(20)] + [("one", 1.0, 2.0, 3.0, 4.0)]
    got = {r.g: r for r in O.estimate(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")).collect()}
    assert set(got) == {"same", "two", "one"} and all(r.det > 0 for r in got.values())
    assert abs(got["same"].det - np.linalg.det(FLOOR)) < 1e-12


def test_verdicts_against_numpy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    own = {}
    for d in docs:
        own.setdefault((d.lang, d.source), []).append(d)
    vector = lambda s: [np.log1p(s[1] / max(1, s[0])), s[2] / max(1, s[0]), s[4] / max(1, s[0]) + s[3] / max(1, s[5]), np.log1p(max(1, s[0]) / max(1, s[5]))]
    failed = lambda s: s[0] < 10 or 100 * s[4] > 20 * s[0]
    all_stats = {d.doc_id: stats(d.text) for d in docs}
    good = lambda ds: [d.doc_id for d in ds if not failed(all_stats[d.doc_id])]
    want = {}
    for (lang, _), ds in own.items():
        pools = [good(ds), good(d for d in docs if d.lang == lang), good(docs)]
        pool = next((p for p in pools if len(p) >= O.SMALL), pools[-1])
        vectors = lambda ids: np.array([vector(all_stats[i]) for i in ids])
        if pools[0]:
            want.update(zip(pools[0], scaled(vectors(pools[0]), vectors(pool))))
    rows = O.op10_outliers(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.base_failed == failed(all_stats[r.doc_id])
        if r.base_failed:
            assert r.distance is None and not r.kept
        else:
            assert abs(r.distance - want[r.doc_id]) <= 0.02 * max(1, want[r.doc_id])
            if abs(want[r.doc_id] - O.CUTOFF) > 1:
                assert r.kept == (want[r.doc_id] <= O.CUTOFF)


def test_edges(spark):
    rows = [(i, t, None if i % 2 else "en", None) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as g", "2 as own")
    assert O.reject_outliers(df).count() == len(rows)
    assert O.reject_outliers(df.limit(0)).count() == 0


def test_many_groups_are_salted(spark, monkeypatch):
    rows = [(i, "some words of a text that is plain " * (1 + i % 4), f"l{i % 3}", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    a = sorted((r.doc_id, r.kept, round(r.distance or 0, 6)) for r in O.reject_outliers(df, small=10).collect())
    monkeypatch.setattr(O, "BROADCAST_GROUPS", 0)
    assert a == sorted((r.doc_id, r.kept, round(r.distance or 0, 6)) for r in O.reject_outliers(df, small=10).collect())
