"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set holds hashes of its distinct five-word shingles. Documents of equal sets are one node. A node's
signature is dealt to `TREES` orders. In each order, nodes that share a prefix of three values form a region;
all pairs of a region of at most `REGION` nodes are candidates. A larger region yields each node with its first one
and is then split by longer prefixes, of six and of twelve values, whose regions yield the same, so that depth adapts
to how crowded a region is. No region is ever gathered in one task unless it has at most `REGION` nodes.

Candidates whose sizes or whose signatures (a byte a value, with a margin of more than four standard deviations)
can't reach the threshold are left out. The rest is confirmed exactly, first the best candidate of every node,
which makes a forest, then all candidates between different trees of that forest; those inside one are linked
already. Components spread the smallest label along links and along labels, in tables in the shared folder.

First ones alone lose links, so nodes of regions that were too large at the first depth (the crowd) are then joined
exactly: two sets that reach the threshold share a shingle among the rarest of each, as many as the threshold lets
be missing and one more. Nodes that share such a shingle and aren't in one component yet are compared by sizes, signatures
and full sets as above. A shingle of more than `POSTED` nodes deals them to chunks; each pair of chunks is a group of
its own, which compares two nodes only at the first shingle of theirs and yields links that connect what isn't
connected in it yet. Frequencies and orders are those of the crowd.

Defined results: texts without words and null texts have an empty set and are linked with nothing; fewer than
five words are one shingle; repeated rows are copies of each other; a null id is never a component's id unless
its component has no other; no rows give no rows; columns other than id and text are ignored. Nodes are known
by a 64-bit hash of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back, removed, stored

WORDS, TREES, PER_TREE, DEPTHS, REGION, BROADCAST_ROWS = 5, 20, 6, (3, 6, 12), 32, 300_000
POSTED, CHUNK, HOT = 32, 512, 100_000  # nodes of a shingle that are paired in one row, and in one of several chunks
VALUES = TREES * PER_TREE
#: A link needs PART * |intersection| >= WHOLE * |union|.
PART, WHOLE = 100, 75
#: 0.75 less 4.5 standard deviations of the mean of VALUES matches.
LEAST_MATCH = 0.75 - 4.5 * (0.75 * 0.25 / VALUES) ** 0.5
_r = np.random.default_rng(20240501)
FACTORS, OFFSETS = _r.integers(0, 2**32, VALUES, np.uint32) | np.uint32(1), _r.integers(0, 2**32, VALUES, np.uint32)
LETTERS = _r.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), BASE if kind == "up" else BACK, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def normal(text: str | None) -> bytes:
    """The words with A-Z lower-cased, one space between them."""
    return b" ".join((text or "").encode().lower().split())


def shingles(words: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a normal text: polynomial hashes of its substrings."""
    if not words:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(words, np.uint8)
    n = len(x)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(LETTERS[x] * _power("up", n)[:n], out=sums[1:])
    gaps = np.flatnonzero(x == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [n]])
    if len(starts) > WORDS:
        starts, ends = starts[: 1 - WORDS], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = (sums[ends] - sums[starts]) * _power("down", n)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[at : at + 2048, None] * FACTORS + OFFSETS).min(0), out=out)
    return out


def prefixes(values: np.ndarray) -> list[np.ndarray]:
    """For each depth the hashed prefix of every tree's order; past its own values a tree goes on with the next one's."""
    turned = np.concatenate([values, values]).astype(np.uint64)
    at = np.arange(TREES) * PER_TREE
    h, out = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), []
    for d in range(DEPTHS[-1]):
        h = (h ^ turned[at + d]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        if d + 1 in DEPTHS:
            out.append(h.view(np.int64).copy())
    return out


SETS = "doc_id bigint, text_hash bigint, node bigint, n_shingles bigint, k0 array<bigint>, k1 array<bigint>, k2 array<bigint>, sketch binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), *((f"k{i}", pa.list_(pa.int64())) for i in range(3)), ("sketch", pa.binary())])


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


@frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, own, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
            found = shingles(normal(text.as_py()))
            if len(found):
                values = signature(found)
                out.append((doc.as_py(), own.as_py(), node_of(found), len(found), *prefixes(values), (values & 255).astype(np.uint8).tobytes()))
            else:
                out.append((doc.as_py(), own.as_py(), None, 0, None, None, None, None))
            if len(out) == 1000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)
        give_back()


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SETS)], schema=_SETS)


@frugal
def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal texts, compressed."""
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part["node"], pa.array([small.compress(normal(t)) for t in part["text"].to_pylist()], pa.binary())], names=["node", "words"])


def _ordered(a, b) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _near_sizes(a, b):
    return F.least(a, b) * PART >= F.greatest(a, b) * WHOLE


def _within(lines: DataFrame, apart=lambda y: F.lit(True)) -> DataFrame:
    """The pairs a < b of each line of nodes that their sizes allow and for which `apart` holds."""
    each = lines.select(F.explode("line").alias("x"), "line")
    near = lambda y: (y["node"] > F.col("x.node")) & _near_sizes(y["n_shingles"], F.col("x.n_shingles")) & apart(y)
    return each.select(F.col("x.node").alias("a"), F.explode(F.filter("line", near)).alias("y")).select("a", F.col("y.node").alias("b"))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b that meet in the forest, and the crowd: nodes of regions that are too large to pair at the first depth."""
    pairs, open_, crowd = [], None, None
    for depth in range(len(DEPTHS)):
        rows = nodes.select("node", "n_shingles", F.posexplode(f"k{depth}").alias("tree", "key"))
        if open_ is not None:
            rows = rows.join(open_, ["node", "tree"], "left_semi")
        sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("n > 1"), "forest-regions")
        pairs.append(sizes.where("n = 2").select(*_ordered(F.col("first"), F.col("last"))))
        members = stored(rows.join(sizes.where("n > 2").select("key", "n", "first"), "key"), "forest-members")
        if depth == 0:
            line = members.where(F.col("n") <= REGION).groupBy("key").agg(F.collect_list(F.struct("node", "n_shingles")).alias("line"))
            pairs.append(_within(line))
        large = members.where(F.col("n") > REGION)
        starred = large if depth == 0 else members
        pairs.append(starred.where(F.col("node") != F.col("first")).select(*_ordered(F.col("first"), F.col("node"))))
        open_ = large.select("node", "tree")
        if crowd is None:
            crowd = stored(large.select("node").distinct(), "forest-crowd")
            if crowd.isEmpty():
                break
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    return stored(every.where("a < b").distinct(), "forest-pairs"), crowd


@frugal
def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of compressed normal texts."""
    big = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = [shingles(big.decompress(w)).view(np.int64) for w in part["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])


PAIRS = "a bigint, b bigint"


def _between(key: tuple, rows: pa.Table) -> pa.Table:
    """Links of different components between two chunks of a shingle's nodes, or inside one: enough to connect what they connect."""
    token, one, two = (k.as_py() for k in key)
    big = zstandard.ZstdDecompressor()
    node, label, n = (rows[c].to_numpy() for c in ("node", "label", "n_shingles"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, VALUES)
    words, tokens, mine = rows["words"], [set(t) for t in rows["tokens"].to_pylist()], rows["chunk"].to_numpy()
    left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
    group = np.unique(label, return_inverse=True)[1]
    sets: dict[int, np.ndarray] = {}
    links = []

    def look(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(big.decompress(words[i].as_py()))
        return sets[i]

    for i in left:
        near = right[(group[right] != group[i]) & (np.minimum(n[right], n[i]) * PART >= np.maximum(n[right], n[i]) * WHOLE)]
        if one == two:
            near = near[node[near] > node[i]]
        for j in near[(sketch[near] == sketch[i]).mean(1) >= LEAST_MATCH]:
            if group[i] == group[j] or min(tokens[i] & tokens[j]) != token:
                continue
            x, y = look(int(i)), look(int(j))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if PART * common >= WHOLE * (len(x) + len(y) - common):
                links.append(sorted((int(node[i]), int(node[j]))))
                group[group == group[j]] = group[i]
    return pa.table({c: pa.array([p[k] for p in links], pa.int64()) for k, c in enumerate("ab")})


def crowded(crowd: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a < b between different components (node, label) in the crowd: enough to connect all that reach the threshold."""
    held = texts.join(crowd, "node", "left_semi").mapInArrow(_unpacked, "node bigint, found array<bigint>")
    tokens = stored(held.select("node", F.explode("found").alias("token")), "crowd-tokens")
    counts = stored(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "crowd-counts")
    common = tokens.join(counts, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("rare"))
    known = nodes.join(crowd, "node", "left_semi").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n_shingles", "sketch")
    # Of n shingles n - ceil(n * WHOLE / PART) + 1 are asked for, rarest first: those of one node come before the common ones.
    asked = F.expr(f"int(n_shingles - (n_shingles * {WHOLE} + {PART - 1}) div {PART} + 1 - (n_shingles - size(rare)))")
    rare = common.join(known.select("node", "n_shingles", "label"), "node").where(asked > 0).select("node", "label", "n_shingles", F.explode(F.slice("rare", F.lit(1), asked)).alias("r"))
    posted = stored(rare.select("node", "label", "n_shingles", F.col("r.token").alias("token")), "crowd-posted")
    sizes = posted.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 1 and low <> high").select("token", "n")
    open_ = stored(posted.join(sizes, "token"), "crowd-open")
    line = open_.where(F.col("n") <= POSTED).groupBy("token").agg(F.collect_list(F.struct("node", "label", "n_shingles")).alias("line"))
    few = stored(_within(line, lambda y: y["label"] != F.col("x.label")).distinct(), "crowd-pairs")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    many = open_.where(F.col("n") > POSTED).groupBy("node").agg(F.collect_list(F.struct("token", "n")).alias("held"))
    many = many.join(known, "node").join(texts, "node").withColumn("tokens", F.col("held.token")).withColumn("h", F.explode("held")).select("*", "h.token", "h.n")
    many = many.withColumn("chunk", F.pmod(F.xxhash64("node", "token"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    many = many.select("token", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "node", "label", "n_shingles", "sketch", "words", "tokens", "chunk")
    found = stored(many.groupBy("token", "one", "two").applyInArrow(_between, PAIRS), "crowd-links")
    return found.unionByName(confirmed(likely(few, nodes), texts)).distinct()


@frugal
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        side = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, VALUES) for c in ("s_a", "s_b")]
        match = (side[0] == side[1]).mean(1)
        keep = match >= LEAST_MATCH
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(match)], names=["a", "b", "match"]).filter(pa.array(keep))


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, match: the pairs that sizes and signatures let reach the threshold."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(_near_sizes("n_a", "n_b"))
    return both.select("a", "b", "s_a", "s_b").mapInArrow(_likely, "a bigint, b bigint, match double")


@frugal
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    big = zstandard.ZstdDecompressor()
    opened: dict[bytes, np.ndarray] = {}

    def look(words: bytes) -> np.ndarray:
        if words not in opened:
            if len(opened) >= 64:
                opened.pop(next(iter(opened)))
            opened[words] = shingles(big.decompress(words))
        return opened[words]

    for batch in batches:
        keep = []
        for wa, wb in zip(batch["w_a"].to_pylist(), batch["w_b"].to_pylist()):
            x, y = look(wa), look(wb)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(PART * common >= WHOLE * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    one = lambda x: texts.select(F.col("node").alias(x), F.col("words").alias(f"w_{x}"))
    both = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b")
    return stored(both.select("a", "b", "w_a", "w_b").mapInArrow(_confirm, PAIRS), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of the links (a, b)."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-graph")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "near-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = stored(labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "near-labels")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(nearer.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "near-labels")
        for past in (labels, nearer):
            removed(past)
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            removed(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    # A row is known by its id and its text: many rows may share either.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    sets = stored(rows.mapInArrow(_sets, SETS), "near-sets")
    own = F.coalesce("doc_id", F.lit(-(2**63)))
    held = sets.where(F.col("node").isNotNull())
    owners = held.groupBy("node").agg(F.min(F.struct(own.alias("own"), "text_hash")).alias("by"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    owners = stored(owners.select("node", "by.own", "by.text_hash", "first_id", "n"), "near-owners")
    first = held.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(3)), F.first("sketch").alias("sketch"))
    nodes = stored(first, "near-nodes")
    met, crowd = candidates(nodes)
    pairs = stored(likely(met, nodes), "near-likely")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd).distinct().join(owners, "node").select("node", "own", "text_hash")
    wanted = stored(wanted, "near-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # else texts are shuffled by id and text
    texts = stored(rows.select(own.alias("own"), "text_hash", "text").join(wanted, ["own", "text_hash"]).select("node", "text").mapInArrow(_named, "node bigint, words binary").dropDuplicates(["node"]), "near-texts")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("match", "a")).alias("a"))
    sure = confirmed(best.select("a", "b"), texts)
    trees = components(sure)
    named = lambda x: trees.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    apart = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b"))
    apart = apart.join(best.select("a", "b"), ["a", "b"], "left_anti")
    more = confirmed(apart, texts)
    links = sure.unionByName(more)
    labels = components(links)
    if not crowd.isEmpty():
        labels = components(links.unionByName(crowded(crowd, nodes, labels, texts)))
    # Components are settled on nodes; a node has any number of copies, a component any number of nodes.
    grouped = stored(owners.join(labels, "node", "left").select("node", "first_id", "n", F.coalesce("label", "node").alias("group")), "near-groups")
    smallest = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("rows"), F.count("*").alias("n")).where("rows > 1").drop("rows")
    named = beside(grouped.select("node", "group", F.col("n").alias("copies")), stored(smallest, "near-smallest"), "group").where("component_id is not null")
    named = stored(named.select("node", "component_id", F.col("copies").alias("n")), "near-named")
    done = beside(sets.select("doc_id", "node", "n_shingles"), named, "node").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def beside(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with `found` beside them where it has their key. `found` has each key once, with n, its number of rows.

    A small table is broadcast; of a large one only the keys of more than HOT rows are, which are few, so that no key's
    rows gather in one task. Rows without a key stay where they are."""
    columns = [c for c in found.columns if c not in (key, "n")]
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop("n")), key, "left")
    hot = F.broadcast(found.where(F.col("n") > HOT).drop("n"))
    many, rest = rows.join(hot, key), rows.join(hot.select(key), key, "left_anti")
    none = rest.where(F.col(key).isNull()).withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in columns})
    return many.unionByName(rest.where(F.col(key).isNotNull()).join(found.drop("n"), key, "left")).unionByName(none)


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
