import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import contexts as C


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """The same tree by recursion over dictionaries."""

    def __init__(self, texts):
        self.n, self.w = Counter(), {}
        for t in texts:
            t = bytes([10]) * C.DEPTH + t
            for i in range(C.DEPTH, len(t)):
                for bit in range(8):
                    for d in range(C.DEPTH + 1):
                        self.n[t[i - d : i][::-1], (256 | t[i]) >> (8 - bit), (t[i] >> (7 - bit)) & 1] += 1
        self.kids = {}
        for c, node, _ in list(self.n):
            if c:
                self.kids.setdefault((c[:-1], node), set()).add(c)

    def log(self, c, node):
        if (c, node) not in self.w:
            own = kt(self.n[c, node, 0], self.n[c, node, 1])
            if len(c) == C.DEPTH:
                self.w[c, node] = (own, 1.0)
            else:
                mixed = np.logaddexp(own, sum(self.log(k, node) for k in self.kids.get((c, node), ()))) - math.log(2)
                self.w[c, node] = (mixed, math.exp(own - mixed) / 2)
        return self.w[c, node][0]

    def score(self, t):
        t, total = bytes([10]) * C.DEPTH + t, 0.0
        for i in range(C.DEPTH, len(t)):
            for bit in range(8):
                node, one, p = (256 | t[i]) >> (8 - bit), (t[i] >> (7 - bit)) & 1, None
                for d in range(C.DEPTH, -1, -1):
                    c = t[i - d : i][::-1]
                    self.log(c, node)
                    a, b = self.n[c, node, 0], self.n[c, node, 1]
                    own = ((b if one else a) + 0.5) / (a + b + 1)
                    stop = self.w[c, node][1]
                    p = own if p is None else stop * own + (1 - stop) * p
                    if a + b == 0:
                        p = None
                p = 0.5 if p is None else p
                total += math.log10(p)
        return total


def bytes_of(t):
    return b" ".join(C.tokens(t)) + b"\n"


def expect(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    train = [t for i, t in docs if not held[i]]
    model = Brute([bytes_of(t) for t in train])
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "\n"]
    n = Counter(w for t in train for w in words(t))
    total, distinct = sum(n.values()), len(n)
    return {i: (held[i], len(words(t)), sum(n[w] > 0 for w in words(t)), total, sum(math.log10((n[w] + 1) / (total + distinct + 1)) for w in words(t)), model.score(bytes_of(t))) for i, t in docs}


def test_lgamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 1e3, 1e9])
    assert C.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("block", [6 << 20, 700])
def test_against_recursion(spark, sf, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(14).collect()
    docs = [(r.doc_id, (r.text or "")[:300]) for r in rows] + [(900, None), (901, ""), (902, "Ä b\x0bC\n\n d"), (903, "the the the")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as block", "'x' as words")
    held = C.fold(C.F.col("doc_id"), 7) == 2
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in C.score_texts(df, held).collect()}
    want = expect(docs)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-5, abs=1e-4)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (None, "a")], "doc_id bigint, text string")
    rows = C.score_texts(df, C.fold(C.F.col("doc_id"), 7) == 2).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert C.score_texts(df.limit(0), C.F.lit(False)).count() == 0
    none = C.score_texts(df, C.F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert none[0].score == pytest.approx(-8 * none[0].n_model_bytes * math.log10(2), rel=1e-4)


def test_counts_beyond_32_bits():
    """What blocks count is summed in 64 bits, and a shard's answer holds it."""
    rows = pa.Table.from_pylist([{"block": b, "kind": "word", "shard": 0, "keys": C._squeeze(np.array([7], np.uint64)), "counts": C._pack(np.array([2**32 - 1], np.uint32))} for b in range(3)], schema=C._ROWS)
    out = C._answer(None)((pa.scalar(0), pa.scalar("word")), rows).to_pylist()
    assert [C._unpack(r["counts"], "<u8").tolist() for r in out] == [[3 * (2**32 - 1)]] * 3


def test_parts_of_a_shard_are_apart():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 20, 5000).astype(np.uint64) << np.uint64(36) | rng.integers(0, 1 << 36, 5000).astype(np.uint64))
    counts = rng.integers(0, 9, len(keys))
    parts = list(C._apart(keys, 300))
    assert len(parts) > 5 and [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and parts[-1].stop == len(keys)
    whole = C.Tree(keys, counts).bits()
    for i, p in enumerate(parts):
        for (p0, s0), (p1, s1) in zip(whole, C.Tree(keys[p], counts[p]).bits()):
            assert np.array_equal(p0[p], p1) and np.array_equal(s0[p], s1)


def test_the_query_on_whole_texts(spark, sf, monkeypatch):
    """op1 on all rows and whole texts: the contract's columns by counting; scores by the tree in one piece."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 60_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in C.op1_ctw(spark, sf).collect()}
    assert len(got) == len(docs)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    words = lambda t: [*C.tokens(t), b""]
    n = Counter(w for i, t in docs if not held[i] for w in words(t))
    total, distinct = sum(n.values()), len(n)
    texts = [bytes_of(t) for _, t in docs]
    found = C.grams(texts)
    keys = np.unique(found)
    own, times = np.unique(found[np.repeat([not held[i] for i, _ in docs], [len(t) for t in texts])], return_counts=True)
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, own)] = times
    tree = C.Tree(keys, counts, low=0)
    logs = np.zeros(len(keys))
    for bit, (p, seen) in enumerate(tree.bits()):
        one = (keys >> np.uint64(7 - bit)) & np.uint64(1)
        logs += np.log10(np.where(seen, p, 0.5)) + 0 * one
    scores = np.add.reduceat(logs[np.searchsorted(keys, found)], np.cumsum([0, *(len(t) for t in texts[:-1])]))
    for (i, t), s in zip(docs, scores):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words(t)), sum(n[w] > 0 for w in words(t)), total)
        assert r.base_score == pytest.approx(sum(math.log10((n[w] + 1) / (total + distinct + 1)) for w in words(t)), rel=1e-9)
        assert r.score == pytest.approx(s, rel=1e-4, abs=1e-3)


def test_a_very_long_text(spark):
    docs = [(1, "ab cd " * 100_000), (2, "ab cd")]
    rows = {r.doc_id: r for r in C.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") == 2).collect()}
    assert rows[1].n_tokens == 200_001 and rows[2].n_known == 3 and rows[1].score > rows[1].base_score / 1000


def test_sixth_byte_of_context_is_used(spark):
    """The last letter of each word is known from its first one, six bytes before."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"{c}mmmmm{c}" for c in rng.choice(["p", "q"], 200))) for i in range(30)]
    held = C.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") == 0).where("held_out").collect()
    assert [r.doc_id for r in held] == [0] and -held[0].score / math.log10(2) < 1.4 * 200
