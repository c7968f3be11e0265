"""Language-model scores by context-tree weighting over bytes.

A text is the byte sequence of its words, A-Z lower-cased, with one space between them and a newline as its end;
before its start stand newlines. Bytes are decomposed into eight binary decisions, each with a context of up to
`DEPTH` preceding bytes. Every node of the tree (context, bits of this byte so far) holds a Krichevsky-Trofimov
estimate; bottom up, a node weighs its own estimate against its children's as in context-tree weighting, and a
decision's probability mixes the estimates of all depths by these weights. A node that no training text reached
takes no part: the deepest node on the way that was reached has the rest of the weight, so that a context that
is new at some depth is predicted from what is known of its nearer bytes.

Counts come from all training texts. Each task gathers its documents to blocks of about `BLOCK_BYTES`; a block keeps
its texts as one compressed row, and sends its distinct contexts with their counts, not its positions, to shards by
the two nearest bytes. A shard sums the counts and weighs the nodes of depth two and more, those of some pairs of
nearest bytes at a time. What the depths below need of the shards is a table of at most 256 x 255 nodes, which the
driver combines: it's bounded by the alphabet. Shards then answer each block with the probability of each of its
distinct contexts, and blocks add up their documents. Blocks and shards are as many as the corpus needs; no model of
the whole corpus is ever in one place. Word counts for the base score go the same way, by 64-bit hashes of words.

Defined results: null texts are empty and have one token, the end; repeated rows are scored each and, if in the
training fold, counted each; with no training rows the model is uniform over bits; no rows give no rows; a null
id belongs to no fold and trains; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, scratch, swept

DEPTH, BLOCK_BYTES, BLOCKS_A_SHARD = 6, 8 << 20, 6
END = 10
_LGAMMA_HALF = 0.5 * log(np.pi)
_table: list[np.ndarray] = []


def lgamma(x: np.ndarray) -> np.ndarray:
    """Of positive floats: Stirling's series at x + 6, stepped down."""
    y = x + 6.0
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    return s - np.log(x * (x + 1) * (x + 2)) - np.log((x + 3) * (x + 4) * (x + 5))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - 2 * _LGAMMA_HALF


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(texts: list[bytes]) -> np.ndarray:
    """For every byte of every text (all end with END) the key of its context and itself: from the top byte down
    the nearest preceding byte, the next nearest, ..., and last the byte."""
    pad = bytes([END]) * 7
    x = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    v = np.lib.stride_tricks.as_strided(x, (max(len(x) - 7, 0), 8), (1, 1)).copy().view("<u8").ravel()  # the byte on top
    byte = v >> np.uint64(56)
    v <<= np.uint64(8)
    v >>= np.uint64(8 * (8 - DEPTH))
    v <<= np.uint64(8)
    v |= byte
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 7)[:-1] - 7  # after each text but the last come the places of the next one's padding
    keep = np.ones(len(v), bool)
    keep[(ends[:, None] + np.arange(7)).ravel()] = False
    return v[keep]


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, their bytes by place."""
    d = np.diff(keys, prepend=np.zeros(1, keys.dtype)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=9).compress(np.ascontiguousarray(d).tobytes())


def _unsqueeze(raw: bytes) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(d.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(d.T).view(kind).ravel()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two nearest bytes of the context."""
    h = (keys >> np.uint64(8 * (DEPTH - 1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _apart(keys: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Parts of a shard's sorted keys that share no pair of nearest bytes: their nodes of depth two and more are apart."""
    edges = np.flatnonzero(np.diff(keys >> np.uint64(8 * (DEPTH - 1)), prepend=~np.uint64(0))) if len(keys) else np.zeros(0, np.int64)
    lo = 0
    for at, end in zip(edges, [*edges[1:], len(keys)]):
        if end - lo > most and at > lo:
            yield slice(lo, at)
            lo = at
    if lo < len(keys):
        yield slice(lo, len(keys))


class Tree:
    """The nodes of depth LOW and more of a shard: sorted distinct keys and their counts, which may be 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int = 2):
        self.low, self.levels = low, {}
        child: list[tuple] | None = None
        for depth in range(DEPTH, low - 1, -1):
            up = None
            if depth < DEPTH:  # leave out the farthest byte; keys of a node then lie apart, so sort again
                short = (keys >> np.uint64(16)) << np.uint64(8) | keys & np.uint64(255)
                order = np.argsort(short, kind="stable")
                edge = np.concatenate([[True], np.diff(short[order]) != 0]) if len(order) else np.zeros(0, bool)
                up = np.empty(len(order), np.int64)
                up[order] = np.cumsum(edge) - 1
                keys, counts = short[order][edge], np.add.reduceat(counts[order], np.flatnonzero(edge)) if len(order) else counts
            child = self._level(depth, keys, counts, child, up)
        self.logs = child  # of depth low, by bit: first key of each node, and the node's weighted log

    def _level(self, depth: int, keys: np.ndarray, counts: np.ndarray, child, up) -> list[tuple]:
        logs, level = [], []
        for bit in range(8):
            node = keys >> np.uint64(8 - bit)
            edge = np.concatenate([[True], np.diff(node) != 0]) if len(node) else np.zeros(0, bool)
            starts, of = np.flatnonzero(edge), np.cumsum(edge) - 1
            one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
            total = np.add.reduceat(counts, starts) if len(starts) else counts
            ones = np.add.reduceat(counts * one, starts) if len(starts) else counts
            a, b = (total - ones).astype(float), ones.astype(float)
            own = log_kt(a, b)
            if child is None:
                weighted, stop = own, np.ones(len(own))
            else:  # a child's node is known by its first key, whose key here belongs to the parent
                first, below = child[bit]
                weighted = np.logaddexp(own, np.bincount(of[up[first]], weights=below, minlength=len(own))) - log(2)
                stop = np.exp(own - weighted) / 2
            level.append((of, one, a, b, stop))
            logs.append((starts, weighted))
        self.levels[depth] = (keys, counts, level, up)
        return logs

    def bits(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each bit and key of depth DEPTH the probability of the byte's own bit, mixed from depth `low` down,
        and whether training reached the node of depth `low`."""
        maps, at = {DEPTH: None}, None
        for depth in range(DEPTH - 1, self.low - 1, -1):
            up = self.levels[depth][3]
            at = up if at is None else up[at]
            maps[depth] = at
        out = []
        for bit in range(8):
            p = seen = None
            for depth in range(DEPTH, self.low - 1, -1):
                of, one, a, b, stop = self.levels[depth][2][bit]
                node = of if maps[depth] is None else of[maps[depth]]
                is_one = one if maps[depth] is None else one[maps[depth]]
                n = a + b
                own = (np.where(is_one == 1, b[node], a[node]) + 0.5) / (n[node] + 1.0)
                p = own if p is None else np.where(seen, stop[node] * own + (1 - stop[node]) * p, own)
                seen = n[node] > 0
            out.append((p, seen))
        return out


class Root:
    """The nodes of depth 0 and 1, from counts [nearest, byte] and the summed logs [nearest, node] of depth 2,
    where a node is 1 followed by the bits so far."""

    def __init__(self, counts: np.ndarray, below: np.ndarray):
        stop1, p1, log1 = self._weigh(counts, below)
        stop0, p0, _ = self._weigh(counts.sum(0)[None], log1.sum(0)[None])
        self.stop1, self.p1, self.stop0, self.p0 = stop1, p1, stop0[0], p0[0]
        self.seen1 = self._totals(counts)[:, :256] > 0

    @staticmethod
    def _totals(counts: np.ndarray) -> np.ndarray:
        n = np.zeros((len(counts), 512))
        n[:, 256:] = counts
        for node in range(255, 0, -1):
            n[:, node] = n[:, 2 * node] + n[:, 2 * node + 1]
        return n

    @classmethod
    def _weigh(cls, counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = cls._totals(counts)
        a, b = n[:, 0:512:2][:, :256], n[:, 1:512:2][:, :256]  # of node k: n[2k], n[2k + 1]
        own = log_kt(a, b)
        mixed = np.logaddexp(own, below) - log(2)
        return np.exp(own - mixed) / 2, (b + 0.5) / (a + b + 1.0), mixed

    def mix(self, keys: np.ndarray, deep: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log10 of the probability of each key's byte, given `Tree.bits`."""
        near, byte = (keys >> np.uint64(8 * DEPTH)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(keys))
        for bit in range(8):
            node, one = (256 | byte) >> (8 - bit), (byte >> (7 - bit)) & 1
            side = lambda p: np.where(one == 1, p, 1 - p)
            p, seen = deep[bit]
            own, stop = side(self.p1[near, node]), self.stop1[near, node]
            p = np.where(seen, stop * own + (1 - stop) * p, own)
            own, stop = side(self.p0[node]), self.stop0[node]
            p = np.where(self.seen1[near, node], stop * own + (1 - stop) * p, own)
            total += np.log10(p)
        return total


ROWS = "block bigint, kind string, shard int, keys binary, counts binary"
_ROWS = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("length", pa.int64())])


def _distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    found = np.sort(found)
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[at], np.diff(at, append=len(found))


def _sums(found: np.ndarray, lengths: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each text the sum of its positions' values, by key. Keys leave 8 bits for one of 256 texts, so that
    positions are sorted as plain numbers and meet the sorted keys in order."""
    out, upto = np.zeros(len(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    for lo in range(0, len(lengths), 256):
        hi = min(len(lengths), lo + 256)
        own = np.repeat(np.arange(hi - lo, dtype=np.uint64), lengths[lo:hi])
        both = np.sort(found[upto[lo] : upto[hi]] << np.uint64(8) | own)
        out[lo:hi] = np.bincount((both & np.uint64(255)).astype(np.int64), weights=values[np.searchsorted(keys, both >> np.uint64(8))], minlength=hi - lo)
    return out


def _block_words(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The same of words and ends; the end is the hash of the empty string."""
    ids: dict[bytes, int] = {}
    index = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in (*s, b"")), np.int64)
    found = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[index]


def _open_block(row: dict):
    """The block's documents in their order: ids, held-out flags and byte sequences."""
    docs, whole = pa.ipc.open_stream(row["counts"]).read_all(), zstandard.ZstdDecompressor().decompress(row["keys"])
    ends = np.cumsum(docs["length"].to_numpy())
    return docs["doc_id"].to_pylist(), docs["held_out"].to_numpy(), [whole[e - n : e] for e, n in zip(ends.tolist(), docs["length"].to_pylist())]


def _block(block: int, shards: int, ids: list, held: list[bool], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its documents, and its distinct contexts and words with their counts, by shard."""
    lengths = [len(t) for t in texts]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS) as w:
        w.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths, pa.int64())], schema=_DOCS))
    whole = zstandard.ZstdCompressor(level=9).compress(b"".join(texts))
    yield pa.RecordBatch.from_pylist([{"block": block, "kind": "docs", "shard": -1, "keys": whole, "counts": sink.getvalue().to_pybytes()}], schema=_ROWS)
    trains = ~np.array(held, bool)

    def sent(kind: str, keys: np.ndarray, counts: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order], prepend=-1))
        picks = [order[lo:hi] for lo, hi in zip(edges, [*edges[1:], len(order)])]
        return pa.RecordBatch.from_pylist([{"block": block, "kind": kind, "shard": int(at[p[0]]), "keys": _squeeze(keys[p]), "counts": _pack(counts[p])} for p in picks], schema=_ROWS)

    found = grams(texts) << np.uint64(1)  # 57 bits, the last one for training texts
    found |= np.repeat(trains, lengths).astype(np.uint64)
    found.sort()
    at = np.flatnonzero(np.diff(found >> np.uint64(1), prepend=~np.uint64(0)))
    keys = found[at] >> np.uint64(1)
    found &= np.uint64(1)
    counts = np.add.reduceat(found, at).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)  # a block has fewer than 2**32 bytes
    del found, at
    yield sent("gram", keys, counts, shard_of(keys, shards))
    split = [t[:-1].split(b" ") if len(t) > 1 else [] for t in texts]
    keys, index = _block_words(split)
    counts = np.bincount(index[np.repeat(trains, [len(s) + 1 for s in split])], minlength=len(keys)).astype(np.uint32)
    yield sent("word", keys, counts, ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64))


def _gather(shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, ids, held, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for i, h, t in zip(some["doc_id"].to_pylist(), some["held_out"].to_pylist(), some["text"].to_pylist()):
                    ids.append(i)
                    held.append(h)
                    texts.append(b" ".join(tokens(t)) + b"\n")
                    size += len(texts[-1])
                    if size >= most:
                        yield from _block(part << 32 | nth, shards, ids, held, texts)
                        nth, ids, held, texts, size = nth + 1, [], [], [], 0
                        give_back()
        if ids:
            yield from _block(part << 32 | nth, shards, ids, held, texts)

    return run


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all blocks, sorted, with their counts."""
    keys = np.concatenate([_unsqueeze(k) for k in rows["keys"].to_pylist()])
    counts = np.concatenate([_unpack(c, "<u4") for c in rows["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    return keys[order][edges], np.add.reduceat(counts[order], edges)


SHALLOW = "near int, node int, n bigint, log double"
_SHALLOW = pa.schema([("near", pa.int32()), ("node", pa.int32()), ("n", pa.int64()), ("log", pa.float64())])


def _shallow(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows (near, node, n, log): for nodes 256 and up the count of a byte after `near`, below that the summed logs
    of depth 2. Of words two rows with near -1: their number (node 0) and how many are distinct (node 1)."""
    keys, counts = _summed(rows)
    if key[1].as_py() == "word":
        return pa.table({"near": [-1, -1], "node": [0, 1], "n": [int(counts.sum()), int((counts > 0).sum())], "log": [0.0, 0.0]}, schema=_SHALLOW)
    n, logs = np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
    for part in _apart(keys):
        tree = Tree(keys[part], counts[part])
        two, c = tree.levels[2][:2]
        near, byte = (two >> np.uint64(16)).astype(np.int64), (two & np.uint64(255)).astype(np.int64)
        n += np.bincount(near << 8 | byte, weights=c, minlength=1 << 16).astype(np.int64)
        for bit, (first, weighted) in enumerate(tree.logs):
            logs += np.bincount(near[first] << 8 | ((256 | byte[first]) >> (8 - bit)), weights=weighted, minlength=1 << 16)
    i, j = np.flatnonzero(n), np.flatnonzero(logs)
    return pa.table({"near": np.concatenate([i >> 8, j >> 8]).astype(np.int32), "node": np.concatenate([(i & 255) + 256, j & 255]).astype(np.int32), "n": np.concatenate([n[i], np.zeros(len(j), np.int64)]), "log": np.concatenate([np.zeros(len(i)), logs[j]])}, schema=_SHALLOW)


def _answer(root: Root):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = _summed(rows)
        if key[1].as_py() == "word":
            values = counts.astype(np.uint64)
        else:
            values = np.empty(len(keys), np.float32)
            for part in _apart(keys):
                values[part] = root.mix(keys[part], Tree(keys[part], counts[part]).bits())
            # Rounded to 15 bits of mantissa, a relative error of 1 / 2**16: the last byte is 0 and takes no room.
            values = ((values.view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)
        out = []
        for block, raw in zip(rows["block"].to_pylist(), rows["keys"].to_pylist()):
            out.append({"block": block, "kind": key[1].as_py(), "shard": key[0].as_py(), "keys": None, "counts": _pack(values[np.searchsorted(keys, _unsqueeze(raw))])})
        return pa.Table.from_pylist(out, schema=_ROWS)

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_model_bytes bigint"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_model_bytes", pa.int64())])


def _score(shards: int, n_train: int, n_distinct: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, held, texts = _open_block(docs.to_pylist()[0])
        got = {(k, s): raw for k, s, raw in zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["counts"].to_pylist())}

        def values(kind: str, at: np.ndarray, dtype: str) -> np.ndarray:
            out = np.empty(len(at), dtype)
            for s in np.unique(at):
                out[at == s] = _unpack(got[kind, int(s)], dtype)
            return out

        found, n_bytes = grams(texts), np.array([len(t) for t in texts])
        keys, _ = _distinct(found)
        score = _sums(found, n_bytes, keys, values("gram", shard_of(keys, shards), "<f4").astype(float))
        split = [t[:-1].split(b" ") if len(t) > 1 else [] for t in texts]
        keys, index = _block_words(split)
        c = values("word", ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), "<u8")[index].astype(float)
        n = np.array([len(s) + 1 for s in split])
        first = np.cumsum(n) - n
        base = np.add.reduceat(np.log10((c + 1) / (n_train + n_distinct + 1)), first)
        known = np.add.reduceat((c > 0).astype(np.int64), first)
        return pa.table([pa.array(ids, pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(score), pa.array(n_bytes)], schema=_SCORES)

    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by the model of those for which the column `held_out` is false."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4, int(size // BLOCK_BYTES + 1) // BLOCKS_A_SHARD)
    # Blocks are written before they are numbered by what comes after: a task that runs again changes nothing.
    path = scratch(spark, "ctw-sent")
    rows.mapInArrow(_gather(shards, BLOCK_BYTES), ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    sent = spark.read.schema(ROWS).parquet(path)
    parts = sent.where("kind != 'docs'").groupBy("shard", "kind")
    few = parts.applyInArrow(_shallow, SHALLOW).groupBy("near", "node").agg(F.sum("n").alias("n"), F.sum("log").alias("log")).collect()
    swept(spark)
    counts, below, n_train, n_distinct = np.zeros((256, 256)), np.zeros((256, 256)), 0, 0
    for near, node, n, logs in few:
        if near < 0:
            n_train, n_distinct = (n, n_distinct) if node == 0 else (n_train, n)
        elif node >= 256:
            counts[near, node - 256] = n
        else:
            below[near, node] = logs
    answers = parts.applyInArrow(_answer(Root(counts, below)), ROWS)
    return sent.where("kind = 'docs'").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shards, n_train, n_distinct), SCORES)


def op1_ctw(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fold(F.col("doc_id"), 7) == 2)
