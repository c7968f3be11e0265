from collections import defaultdict

from ledgerloom.llm import mixing


def targets(sizes):
    """Filling by rounds: what is over a source's ceiling is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] >= 2 * sizes[s]}
        if not full:
            out |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), defaultdict(int)
    of = {i: s for i, _, s in docs}
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert len(rows) == len(docs)


DOCS = [(i, "w " * (i * 7 % 90), f"s{i % 5}") for i in range(200)] + [(500, None, None), (501, "a b c", None), (502, "", "empty"), (503, "long " * 9000, "s1")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as bucket", "1 as start")


def test_against_rounds(spark):
    rows = mixing.mix(frame(spark, DOCS), block_words=16).collect()
    check(rows, DOCS)
    assert sorted(rows) == sorted(mixing.mix(frame(spark, DOCS).repartition(3), block_words=16).collect())


def test_spans_are_what_is_taken(spark):
    for r in mixing.mix(frame(spark, DOCS), block_words=16).collect():
        assert sum(x.n for x in r.spans) == r.taken and len(r.spans) == r.n_slots
        assert r.first_slot == (min(x.slot for x in r.spans) if r.spans else None)
        passes = [[w for x in r.spans if x.epoch == e for w in range(x.at, x.at + x.n)] for e in (0, 1)]
        assert all(len(p) == len(set(p)) and all(0 <= w < r.size for w in p) for p in passes)


def test_a_pass_takes_every_block_once_in_a_shuffled_order(spark):
    targets = spark.createDataFrame([("a", 1000, 2000.0, 2000), ("b", 1005, 1500.0, 1500), ("c", 7, 7.0, 7)], "source_key string, source_size long, target double, target_words long")
    rows = mixing.schedule(targets, 10).collect()
    for s, size, words in (("a", 1000, 2000), ("b", 1005, 1500), ("c", 7, 7)):
        own = sorted((r for r in rows if r.source_key == s), key=lambda r: r.slot)
        assert sum(r.take for r in own) == words
        first = [r.block for r in own if r.epoch == 0]
        assert sorted(first) == list(range(-(-size // 10))) and (s == "c" or first != sorted(first))
        assert len({(r.epoch, r.block) for r in own}) == len(own)


def test_many_sources_and_fine_cells(spark, monkeypatch):
    """Ranges of sources, and slots that meet their sources by fine cells."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "CELLS", 8)
    monkeypatch.setattr(mixing, "CELL_SLOTS", 2)
    monkeypatch.setattr(mixing, "SLOTS_TOGETHER", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = [(i, "w " * (i % 13 + 1), f"s{i % 40}") for i in range(300)] + [(900 + i, "w " * 50, "large") for i in range(60)]
    check(mixing.mix(frame(spark, docs), block_words=4).collect(), docs)


def test_repeated_rows_and_none(spark):
    docs = [(1, "a b c d", "x")] * 3 + [(2, "e f", "y")]
    rows = mixing.mix(frame(spark, docs)).collect()
    assert len(rows) == 4 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(frame(spark, docs).limit(0)).count() == 0
    blank = mixing.mix(frame(spark, [(1, None, "x"), (2, " ", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2


def test_slots_are_spread(spark):
    """In any stretch of the schedule a source has near its share of slots."""
    rows = mixing.placed_documents(frame(spark, DOCS), "doc_id", "text", "source")
    slots = mixing.schedule(rows[1], 4).orderBy("slot").collect()
    half = slots[: len(slots) // 2]
    for s in {r.source_key for r in slots}:
        share = sum(r.source_key == s for r in slots) / len(slots)
        assert abs(sum(r.source_key == s for r in half) / len(half) - share) < 0.02
