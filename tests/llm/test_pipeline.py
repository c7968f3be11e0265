"""Each stage on the one before's table, against what its operator does by brute force elsewhere."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import common
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near
from tests.llm.test_packing import check as check_packing


def test_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    before = docs
    for name, stage in P.STAGES[:-1]:
        before = common.stored(stage(spark, before, sf), "test")
        assert before.columns == list(P.COLUMNS)
        seen[name] = before.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in junk) <= 0.1 * len(junk)
    want = sorted((i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in seen["quality"]]))
    assert sorted((r.doc_id, r.text) for r in seen["lines"]) == want
    near = brute_near([(r.doc_id, r.text) for r in seen["lines"]])
    assert {r.doc_id for r in seen["neardup"]} == {i for i, (_, c) in near.items() if c == i}
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(seen["mix"]) - 1.5 * words(seen["neardup"])) <= 30
    text = {r.doc_id: r.text for r in seen["neardup"]}
    assert all(r.text == text[r.doc_id] or " ".join(r.text.split()) in " ".join(text[r.doc_id].split()) for r in seen["mix"])
    packed = P.pack_windows(spark, before, sf).collect()
    whole = [(r.doc_id, r.text) for r in seen["mix"]]
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert len([r for r in packed if r.start == 0]) == len(whole)
    once = {i for i, _ in whole if sum(j == i for j, _ in whole) == 1}
    assert check_packing([r for r in packed], [(i, t) for i, t in whole if i in once]) > 0.95


def test_stages_take_odd_rows(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "other words", "en", None, 11), (None, "no id here", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as __key")
    long = spark.createDataFrame([(7, "word " * 60_000 + "\n" + "line of some length\n" * 3000, "en", "s", 1)], odd.select("doc_id", "text", "lang", "source", "n_chars").schema).selectExpr("*", "1 as __key")
    odd = odd.withColumnsRenamed({"__key": "__score"}).withColumn("__key", F.lit(2)).unionByName(long.withColumn("__score", F.lit("clash")), allowMissingColumns=True)
    for _, stage in P.STAGES:
        stage(spark, odd, sf).collect()
        assert stage(spark, odd.limit(0), sf).count() == 0
    near = sorted((r.doc_id, r.text) for r in P.keep_one_of_each(spark, odd.where("doc_id is not null"), sf).collect() if r.text and len(r.text) < 100)
    assert near == [(3, "a b c"), (3, "other words")]
    mixed = P.mix_sources(spark, odd, sf).collect()
    assert all(r.text for r in mixed)
