import hashlib
from collections import defaultdict

import numpy as np

from ledgerloom.llm import lines
from ledgerloom.llm.lines import Cuckoo, LineIndex

BLANK = " \t\n\x0b\x0c\r"
LONG = "This line is long enough to count"


def key(line):
    k = line.strip(BLANK)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(docs):
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(key(x)) < 20 or len(held[key(x)]) < 3 or i == max(held[key(x)])]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


DOCS = [(1, None), (2, ""), (3, f"{LONG}\nshort\n  {LONG.upper()}\t"), (4, f"a\n{LONG}\n"), (5, f"{LONG}\n\n\n{LONG}"), (6, "É" * 20), (7, "É" * 20), (8, "é" * 20), (9, ("word " * 9000) + "\n" + LONG), (4, f"a\n{LONG}\n"), (None, LONG), (10, "x" * 20), (11, "x" * 20), (12, "x" * 20 + "\r"), (12, "other")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'x' as gone", "2 as h1")


def test_against_brute_force(spark):
    assert got(lines.dedup_lines(frame(spark, DOCS))) == brute(DOCS)


def test_without_broadcast(spark):
    assert got(lines.dedup_lines(frame(spark, DOCS), broadcast_bytes=-1)) == brute(DOCS)


def test_shards_that_are_too_large_to_send_split_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBE_ROWS", 2)
    docs = DOCS + [(20 + i, f"{LONG} again") for i in range(9)]
    index = LineIndex.empty(spark, shards=2, broadcast_bytes=-1).insert(frame(spark, docs))
    found = {(r.h1, r.doc_id) for r in index.maybe(index.live()).collect()}
    assert found >= {(r.h1, r.doc_id) for r in index.live().join(index.frequent(), ["h1", "h2"]).collect()}
    assert got(index.rewrite(frame(spark, docs))) == brute(docs)


def test_a_deleted_document_comes_back_with_another_text(spark):
    docs = [(i, f"{LONG}\n{LONG} {i % 2}") for i in range(6)]
    index = LineIndex.empty(spark, parts=2).insert(frame(spark, docs))
    for turn in range(3):
        index = index.delete(frame(spark, docs[4:]))
        docs = docs[:4] + [(i, f"{LONG} {turn % 2}\nother") for i in (4, 5)]
        index = index.insert(frame(spark, docs[4:]))
        assert got(index.rewrite(frame(spark, docs))) == brute(docs)


def test_a_change_counts_only_the_keys_it_touches(spark):
    index = LineIndex.empty(spark).insert(frame(spark, [(i, f"{LONG} {j}") for i, j in enumerate([0, 0, 0, 1, 1, 2])]))
    after = index.insert(frame(spark, [(10, f"{LONG} 1")]))
    assert after.refs.where("gen = 2").count() == 1 and {r.n_docs for r in after.refs.where("gen = 2").collect()} == {3}
    assert sum(r.n_keys for r in after.filters.collect()) == 2


def test_no_rows(spark):
    assert got(lines.dedup_lines(frame(spark, DOCS).limit(0))) == []


def test_insertions_and_deletions_are_reversible(spark):
    first, more = [d for d in DOCS if d[0] in (3, 4, 6, 10)], [d for d in DOCS if d[0] in (5, 7, 8, 9, 11, 12)]
    one = LineIndex.empty(spark).insert(frame(spark, first))
    both = one.insert(frame(spark, more))
    every = first + more
    assert got(both.rewrite(frame(spark, every))) == brute(every)
    back = both.delete(frame(spark, more))
    assert got(back.rewrite(frame(spark, first))) == brute(first)
    again = back.insert(frame(spark, more))
    assert got(again.rewrite(frame(spark, every))) == brute(every)


def test_growth_past_the_first_size_and_a_small_insert(spark):
    many = "\n".join(f"{LONG} {i}" for i in range(200))
    parts = [[(i, LONG) for i in (1, 2, 3)], [(i, many) for i in (4, 5, 6)] + [(7, "z" * 30), (8, "z" * 30)], [(9, "z" * 30)]]
    index, every = LineIndex.empty(spark, shards=1), []
    for part in parts:
        index, every = index.insert(frame(spark, part)), every + part
        assert got(index.rewrite(frame(spark, every))) == brute(every)
    assert sum(r.n_keys for r in index.filters.collect()) == 202


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    rng = np.random.default_rng(5)
    h = rng.integers(-(2**63), 2**63, 20_000)
    c = lines.build(h)
    assert c.has(h).all()
    assert c.has(rng.integers(-(2**63), 2**63, 100_000)).mean() < 0.001
    c.delete(h[:10_000])
    assert c.has(h[10_000:]).all() and c.has(h[:10_000]).mean() < 0.001
    assert not Cuckoo(4).insert(h[:100])


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs))
    assert sorted(tuple(r) for r in lines.op2_lines(spark, sf).collect()) == want
