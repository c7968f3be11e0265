import os
import subprocess
import sys
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality as Q


def slow_logit(net, text):
    """The network by loops, for one text."""
    x = text + bytes(Q.BLOCK * Q.GROUP + Q.TAPS)
    blocks = []
    for b in range(max(1, -(-len(text) // Q.BLOCK))):
        h = [np.maximum(net.bias + sum(net.bytes[x[p + k]] @ net.taps[k] for k in range(Q.TAPS)), 0) for p in range(b * Q.BLOCK, (b + 1) * Q.BLOCK, 2)]
        blocks.append(np.mean(h, axis=0))
    groups = [np.max(blocks[i : i + Q.GROUP], axis=0) for i in range(0, len(blocks), Q.GROUP)]
    chunks = [np.maximum(a, b) for a, b in zip(groups, groups[1:])] or [groups[0]]
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return float(np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2[0])


TEXTS = [b"", b"a", b"The cat sat. " * 30, b"\xff" * 64, b"x y " * 700, b"$$$ ***" * 37]


def test_forward_against_loops_and_in_any_batch():
    net = Q.Net.fresh(3)
    together = Q.forward(net, Q.Layout(TEXTS))
    assert together == pytest.approx([slow_logit(net, t) for t in TEXTS], rel=1e-4, abs=1e-4)
    alone = [float(Q.forward(net, Q.Layout([t]))[0]) for t in TEXTS]
    assert [float(x) for x in together] == alone


def test_gradient_against_differences():
    rng = np.random.default_rng(0)  # of texts without a pattern, whose maxima have no ties
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (130, 500, 2000, 40)]
    net, at, y = Q.Net.fresh(1), Q.Layout(texts), np.array([1, 0, 1, 0], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, Q.forward(net, at).astype(float)) - y * Q.forward(net, at)))
    grads = dict(zip(("bytes", "taps", "bias", "w1", "b1", "w2", "b2"), Q.gradient(net, at, y)))
    for name, g in grads.items():
        w = getattr(net, name)
        for _ in range(6):
            i = tuple(int(rng.integers(n)) for n in w.shape) if name != "bytes" else (int(rng.integers(97, 123)), int(rng.integers(Q.WIDTH)))
            old, e = w[i], 2e-3
            w[i] = old + e
            up = loss()
            w[i] = old - e
            down = loss()
            w[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * e), rel=0.1, abs=3e-3)


def test_threads_do_not_matter():
    code = "import zlib; import numpy as np; from ledgerloom.llm import quality as Q; r = np.random.default_rng(3); t = [bytes(r.integers(32, 123, 900).astype(np.uint8)) for _ in range(80)]; n = Q.fit(t, (np.arange(80) % 2).astype(np.float32), 2); print(zlib.crc32(Q.forward(n, Q.Layout(t)).tobytes()))"
    runs = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "OPENBLAS_NUM_THREADS": n}, capture_output=True, text=True, check=True).stdout for n in ("1", "4")}
    assert len(runs) == 1


def test_letters_alone_can_be_learned():
    """Junk of the same shape as clean text, which only its letters give away."""
    r = np.random.default_rng(0)
    word = lambda low, high: bytes(r.integers(low, high, r.integers(2, 9)).astype(np.uint8))
    texts = [b" ".join(word(97, 111) if i % 2 else word(108, 123) for _ in range(60)) for i in range(300)]
    y = (np.arange(300) % 2).astype(np.float32)
    logit = Q.forward(Q.fit(texts[:200], y[:200], 4), Q.Layout(texts[200:]))
    assert ((logit > 0) == (y[200:] > 0)).mean() > 0.97


def test_the_query_against_loops(spark, sf, monkeypatch):
    """op9 on whole texts: its scores are the network's by loops, its fold and labels those of the contract."""
    monkeypatch.setattr(Q, "learn_folded", lambda *_: Q.Model(Q.Net.fresh(5), 0.5))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op9_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    for r in sorted(rows, key=lambda r: len(texts[r.doc_id] or ""))[:150:10]:
        assert r.score == pytest.approx(1 / (1 + np.exp(-slow_logit(Q.Net.fresh(5), (texts[r.doc_id] or "").encode()))), abs=1e-4)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = Q.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in clean) / len(clean) > 0.97


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 60_000), (3, "b"), (None, "c")], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as quality")
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (9, None)], "doc_id long, quality int")
    one = Q.learn(df, labels)
    assert one.net is None and {r.score for r in Q.score(df, one).collect()} == {1.0}
    none = Q.learn(df, labels.limit(0))
    assert {r.score for r in Q.score(df, none).collect()} == {1.0}
    both = Q.learn(df, labels.union(spark.createDataFrame([(2, 0)], "doc_id long, quality int")))
    rows = Q.score(df, both).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert Q.score(df.limit(0), both).count() == 0
