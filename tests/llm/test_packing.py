import zlib
from itertools import product

import numpy as np
import pytest

from ledgerloom.llm import packing


def check(rows, docs, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in rows) / (len(sequences) * window)


def test_pieces_cover_documents_and_fill_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = packing.op4_pack(spark, sf).collect()
    assert check(rows, [(d.doc_id, d.text) for d in docs.collect()]) > 0.97


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (4, "b́ \x1c it's 12"), *[(i, "same words here " * 300) for i in range(10, 40)]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as start", "2 as bucket")
    rows = packing.pack(df, packing.tokenizer_path()).collect()
    assert check(rows, docs) > 0.9
    assert packing.pack(df.limit(0), packing.tokenizer_path()).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(7, "a b c " * 400)] * 5 + [(None, "x y " * 500)] * 2, "doc_id bigint, text string")
    rows = packing.pack(df, packing.tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 5 * 1201 + 2 * 1001
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(taken, taken[1:]):
        assert s != s2 or o2 == o + n


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 2049, 5000), return_counts=True))}
    combos, over = packing.plan(dict(histogram))
    used = dict(over)
    for combo, times in combos:
        assert sum(combo) <= 2048
        for n in combo:
            used[n] = used.get(n, 0) + times
    assert used == histogram


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1100: 500}, {1: 10}])
def test_plan_edges(histogram):
    combos, over = packing.plan(dict(histogram))
    assert sum(len(c) * t for c, t in combos) + sum(over.values()) == sum(histogram.values())


def test_repeat_counts_are_least_squares():
    """No repeat count can be raised, nor a positive one lowered, with less squares: the optimum of a convex problem."""
    rng = np.random.default_rng(6)
    for window in (6, 9, 12):
        histogram = {n: int(rng.integers(0, 60)) for n in range(1, window + 1)}
        combos = packing.combinations(sorted(n for n, c in histogram.items() if c), window)
        x = packing.solve({n: c for n, c in histogram.items() if c}, combos, sweeps=3000)
        left = {n: c - sum(t * k.count(n) for k, t in zip(combos, x)) for n, c in histogram.items()}
        for combo, t in zip(combos, x):
            slope = sum(left[n] for n in combo)
            assert slope < 0.1 and (t < 1e-6 or slope > -0.1)


def test_least_squares_against_all_whole_counts():
    """On tiny windows no whole numbers of repeats are better."""
    histogram = {1: 3, 2: 5, 3: 4, 4: 2}
    combos = packing.combinations(sorted(histogram), 4)
    cost = lambda x: sum((c - sum(t * k.count(n) for k, t in zip(combos, x))) ** 2 for n, c in histogram.items())
    best = min(cost(x) for x in product(range(6), repeat=len(combos)))
    assert cost(packing.solve(dict(histogram), combos, sweeps=3000)) <= best + 1e-6


def test_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "YOUNG_BYTES", 4000)
    words = packing.Words(packing.tokenizer_path())
    texts = [f"w{i}x." for i in range(300)] + ["y" * 5000]
    ids = [words[t.encode()] for t in texts]
    assert max(map(len, words)) <= packing.LONG_WORD and len(words) + len(words.old) < 80
    assert ids == [words[t.encode()] for t in texts]


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts]


def test_new_words_of_letters_are_found_together():
    encode = packing.Encoder(packing.tokenizer_path())
    one, calls = encode.words.tokenizer, []

    class Counted:
        def encode(self, word, **how):
            calls.append(word)
            return one.encode(word, **how)

        encode_batch_fast = one.encode_batch_fast

    encode.words.tokenizer = Counted()
    names = [a + b + c for a in "abcdefghij" for b in ("xé", "oo", "ßi", "qu") for c in "klmnopqrst"]
    texts = [" ".join(names), " ".join(n + s for n in names for s in (".", ",", "###")), None]
    assert list(encode(texts)) == ids_of(texts) and list(encode(texts)) == ids_of(texts)
    assert 0 < len(calls) < 50


def test_words_of_all_kinds(monkeypatch):
    odd = ["it's", "o'", "don't.", "'S", "x\u0301.", "é.", "e\u0301a", "ＡＢ", "ﬁn", "İx", "ΣΑΣ", "a\u00a0b", "\u00a0", "a\u2028b", "x-y", "a_", "_", "1.5", "12%%", "³", "漢字", "ʰa", "a\x1cb.", "=\u0338", "a=\u0338", "y" * 300, "y" * 300 + ".", "🙂", "ㅤa"]
    texts = [" ".join(odd), *odd, "\n".join(o + "!?" for o in odd), "", None, " \t"]
    want = ids_of(texts)
    assert list(packing.Encoder(packing.tokenizer_path())(texts)) == want
    monkeypatch.setattr(packing, "TOGETHER", 3)
    monkeypatch.setattr(packing, "PORTION", 4)
    monkeypatch.setattr(packing, "YOUNG_BYTES", 2000)
    encode = packing.Encoder(packing.tokenizer_path())
    assert list(encode(texts)) == want and list(encode(texts)) == want
    assert encode.words.held <= 2000


def test_special_tokens_are_found_in_their_own_case():
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "A<|startoftext|>. B", "<|StartOfText|>x<|endoftext|>"]
    assert list(packing.Encoder(packing.tokenizer_path())(texts)) == ids_of(texts)
