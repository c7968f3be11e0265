import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import language as L


def longest(sample, text, at):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return n


def brute_phrases(sample, text):
    """Cross parsing by looking for substrings; a byte that the sample lacks is a phrase."""
    n = at = 0
    while at < len(text):
        at += max(1, longest(sample, text, at))
        n += 1
    return n


def test_automaton_against_substring_search():
    rng = np.random.default_rng(0)
    sample = bytes(rng.integers(97, 101, 400).astype(np.uint8))
    table = L.Automaton(L.classes([sample])[0])
    texts = [bytes(rng.integers(97, 102, n).astype(np.uint8)) for n in (0, 1, 7, 300, 511)]
    got, _ = L.parse([table], texts)
    assert got[:, 0].tolist() == [brute_phrases(sample, t) for t in texts]


def test_phrases_go_on_over_strips(monkeypatch):
    """Random texts, texts that are long pieces of the sample (phrases longer than a strip), and bytes it lacks."""
    rng = np.random.default_rng(1)
    sample = bytes(rng.integers(97, 101, 3000).astype(np.uint8))
    texts = [bytes(rng.integers(97, 102, n).astype(np.uint8)) for n in (512, 513, 1300, 5000)]
    texts += [sample[100:2900], sample[:1500] + b"z" * 700 + sample[700:], sample * 3, b"zz" * 600, (sample[5:700] + b"q") * 5]
    for strip in (512, 7):
        monkeypatch.setattr(L, "STRIP", strip)
        got, sizes = L.parse([L.Automaton(L.classes([sample])[0])], texts)
        assert got[:, 0].tolist() == [brute_phrases(sample, t) for t in texts] and sizes.tolist() == [len(t) for t in texts]


def test_the_query_against_substring_search(spark, sf):
    """op8 on whole texts: fewest phrases a byte by plain search, ties to the first language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    samples = L.samples(docs.where(~held), "doc_id", "text", "lang")
    codes = {k: L.classes([v])[0].tobytes() for k, v in samples.items()}
    rows = {r.doc_id: r for r in L.op8_language(spark, sf).collect()}
    texts = sorted(((r.text or "", r.doc_id) for r in docs.collect()), key=lambda r: len(r[0]))
    assert len(rows) == len(texts)
    for text, i in texts[:90:9]:
        whole = L.classes([text.encode()])[0].tobytes()
        if not any(c.isalpha() for c in text):
            assert rows[i].lang_pred == "und"
            continue
        n = {k: brute_phrases(v, whole) for k, v in codes.items()}
        assert rows[i].lang_pred == min(sorted(n), key=n.get) and abs(rows[i].phrases_per_kb - 1000 * min(n.values()) / len(whole)) < 1e-9


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a"), (3, "same words", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(df, L.learn(df, "doc_id", "text", "lang")).collect()} == {"a"}


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "ALL_BYTES", 100)
    df = spark.createDataFrame([(i, "abcdefgh " * 20, f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert {len(v) for v in L.samples(df, "doc_id", "text", "lang").values()} == {25}


def test_classes_of_many_texts_are_those_of_each():
    texts = [b"", b"  a--B", b"..", "é!É ".encode(), b"", b"x"]
    codes, sizes = L.classes(texts)
    each = [L.classes([t])[0] for t in texts]
    assert sizes.tolist() == [len(e) for e in each] and codes.tolist() == np.concatenate(each).tolist()


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = L.op8_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = [(1, "the cat sat on the mat " * 20, "en"), (2, "le chat est sur la table " * 20, "fr"), (3, None, "en"), (4, "12 ... 34", None), (5, "", None), (6, "the mat", None), (7, "la table", None), (7, "la table", None), (8, "the cat " * 40_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as letters", "'x' as score")
    models = L.learn(df, "doc_id", "text", "lang")
    got = sorted((r.doc_id, r.lang_pred) for r in L.identify(df, models).collect())
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (7, "fr"), (7, "fr"), (8, "en")]
    assert {r.lang_pred for r in L.identify(df, {}).collect()} == {"und"}
    assert L.identify(df.limit(0), models).count() == 0 and L.learn(df.limit(0), "doc_id", "text", "lang") == {}
