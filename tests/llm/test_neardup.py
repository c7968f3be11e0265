import re
from itertools import combinations

import numpy as np

from ledgerloom.llm import neardup


def brute(docs):
    """doc_id -> (set size, component) from all pairs, by inverted lists."""
    sets, lists = {}, {}
    for i, t in docs:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            lists.setdefault(s, []).append(i)
    common = {}
    for ids in lists.values():
        for a, b in combinations(sorted(ids), 2):
            common[a, b] = common.get((a, b), 0) + 1
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def run(df):
    rows = neardup.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_fixture_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_crowded_regions(spark):
    """Many texts share half of their words, and a large group are near copies of one text."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    passage, base, docs = word(60), word(200), []
    docs += [(i, " ".join(word(70) + passage)) for i in range(150)]
    for i in range(150, 300):
        w = list(base)
        for k in rng.integers(0, 200, 3):
            w[k] = f"x{rng.integers(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(300 + k, t.upper()) for k, (_, t) in enumerate(docs[:10])]
    assert run(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)


def test_crowd_is_joined_exactly(spark):
    """Edited copies that are near their base alone, pairs in texts that share most of their words, and many texts that are near none."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]

    def edited(base, n):
        w = list(base)
        for k in rng.choice(len(w) // 6, n, replace=False):
            w[6 * k + 3] = f"x{rng.integers(10**9)}"
        return w

    base, passage, docs = word(300), word(160), []
    docs += [" ".join(edited(base, 8)) for _ in range(400)] + [" ".join(base)]
    for _ in range(60):
        own = passage + word(100)
        docs += [" ".join(own), " ".join(edited(own, 7))]
    far = word(200)
    docs += [" ".join(edited(far, 9)) for _ in range(600)]
    docs = list(enumerate(docs))
    want = brute(docs)
    assert len({c for i, (_, c) in want.items() if i <= 400}) == 1 and len({c for i, (_, c) in want.items() if i > 520}) > 500
    assert run(spark.createDataFrame(docs, "doc_id bigint, text string")) == want


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "a b c d e"), (7, "a b c d e"), (8, "long " * 30000), (9, "É b c d e f"), (10, "é b c d e f")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1L as node", "'x' as words")
    assert run(df) == brute(docs)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    again = neardup.near_duplicates(df.where("doc_id = 6").unionByName(df.where("doc_id = 6"))).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in again] == [(6, 6, True)] * 2


def test_rows_that_share_an_id(spark):
    """Many rows with a null id, and many texts of one id: each text meets its own node alone."""
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10**6, 40))
    texts = [text() for _ in range(120)]
    docs = [(None, t) for t in texts] + [(7, t + " more") for t in texts] + [(8, texts[0])]
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(rows) == len(docs)
    assert sum(r.component_id == 7 for r in rows) >= 239 and sum(r.component_id is None for r in rows) == 0


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "HOT", 3)
    word = lambda n, k: " ".join(f"w{(i * k) % 9973}" for i in range(n))
    docs = [(i, word(60, 3)) for i in range(9)] + [(20 + i, word(60, 3) + f" x{i}") for i in range(5)] + [(30, None), (31, ""), (32, word(50, 7)), (33, word(50, 7)), (34, word(9, 11))]
    assert run(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)
