"""Quality classification by a byte-level convolutional network in numpy.

Every byte has a learned embedding. Learned filters of eight bytes run over the text in steps of two, are averaged
over blocks of 64 bytes and max-pooled over chunks of eight blocks; chunks start every four blocks, overlap by half
and cover the whole document. The mean and the maximum over all chunks go through one hidden layer to one probability.
Nothing about bytes, words or repetition is given by hand.

Sample bound: the network is fitted on the driver on about `TRAIN_ROWS` labelled rows at most, chosen by a hash
of their ids, of which each gives up to `TRAIN_BYTES` bytes (its beginning, middle and end). The fit runs on one
BLAS thread, so that its sums don't depend on the machine's cores. Scoring reads whole documents and has no BLAS
in it: a document's score comes from its own bytes alone, whatever batch it is in.

Defined results: a null or empty text is scored as one block of padding; repeated rows get the same score;
with no labelled rows every score is 1, with labels of one kind that label; labels that contradict each other
count by their mean; no rows give no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import ctypes
import glob
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, frugal, give_back, row_hash

TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, SEED = 4000, 6000, 10, 64, 7
BLOCK, GROUP, FILTERS, TAPS, HIDDEN, WIDTH = 64, 4, 24, 8, 16, 8


@dataclass
class Net:
    bytes: np.ndarray  # [256, WIDTH], the embeddings
    taps: np.ndarray  # [TAPS, WIDTH, FILTERS]
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fresh(seed: int = SEED) -> "Net":
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1, s).astype(np.float32)
        return Net(g(256, WIDTH) * 0.5, g(TAPS, WIDTH, FILTERS) * 0.25, np.zeros(FILTERS, np.float32), g(2 * FILTERS, HIDDEN) * 0.3, np.zeros(HIDDEN, np.float32), g(HIDDEN) * 0.3, np.zeros(1, np.float32))


class Layout:
    """Texts side by side, each from a multiple of BLOCK * GROUP on; after the last block that holds some of it (one at
    least) lies so much padding that no filter there sees the next text."""

    def __init__(self, texts: list[bytes]):
        unit = BLOCK * GROUP
        sizes = np.array([len(t) for t in texts], np.int64)
        held = np.maximum(1, -(-sizes // BLOCK))
        self.units = (held * BLOCK + TAPS) // unit + 1
        self.first = np.cumsum(self.units) - self.units
        raw = b"".join(t + bytes(int(u) * unit - len(t)) for t, u in zip(texts, self.units))
        x = np.frombuffer(raw, np.uint8)
        self.bytes = np.concatenate([x, np.zeros(TAPS, np.uint8)])
        self.n = len(x) // 2  # places of the filters
        # Blocks without text are left out of the maxima.
        nth = np.arange(int(self.units.sum()) * GROUP) - np.repeat(self.first * GROUP, self.units * GROUP)
        self.held = (nth < np.repeat(held, self.units * GROUP))[:, None]
        # Chunks that hold text: groups of GROUP blocks, each with the next one of its document.
        groups = -(-held // GROUP)
        nth = np.arange(int(self.units.sum())) - np.repeat(self.first, self.units)
        self.chunk = nth < np.repeat(np.maximum(1, groups - 1), self.units)
        self.chunks = np.maximum(1, groups - 1)


def one_thread():
    """Sets numpy's BLAS to one thread where it is the library that numpy's own builds bring along."""
    for path in glob.glob(str(Path(np.__file__).parent.parent / "numpy.libs" / "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib := ctypes.CDLL(path), name):
                getattr(lib, name)(1)


def tables(net: Net) -> np.ndarray:
    """[TAPS, 256, FILTERS]: what each byte adds to the filters at each tap."""
    out = np.zeros((TAPS, 256, FILTERS), np.float32)
    for d in range(WIDTH):
        out += net.bytes[None, :, d, None] * net.taps[:, None, d, :]
    return out


def _filtered(net: Net, at: Layout, found: np.ndarray) -> np.ndarray:
    """The filters at each place by table: sums in the order of the taps."""
    h = found[0][at.bytes[0 : 2 * at.n : 2]] + net.bias
    for k in range(1, TAPS):
        h += found[k][at.bytes[k : k + 2 * at.n : 2]]
    return h


def _pooled(at: Layout, h: np.ndarray):
    """Filters at each place, rectified, to block means, maxima of groups and chunks, and each document's features."""
    blocks = h.reshape(-1, BLOCK // 2, FILTERS).mean(1) * at.held
    groups = blocks.reshape(-1, GROUP, FILTERS)
    top = groups.max(1)
    after = np.concatenate([top[1:], np.zeros((1, FILTERS), np.float32)])
    after[at.first + at.units - 1] = 0
    chunk = np.maximum(top, after) * at.chunk[:, None]
    mean = np.add.reduceat(chunk, at.first, axis=0) / at.chunks[:, None]
    most = np.maximum.reduceat(chunk, at.first, axis=0)
    return groups, top, after, chunk, most, np.concatenate([mean, most], axis=1).astype(np.float32)


def forward(net: Net, at: Layout, found: np.ndarray | None = None) -> np.ndarray:
    """Logits of the texts, without BLAS: the same for a text in any batch."""
    h = _filtered(net, at, tables(net) if found is None else found)
    z = _pooled(at, np.maximum(h, 0, out=h))[-1]
    a = np.zeros((len(z), HIDDEN), np.float32) + net.b1
    for i in range(2 * FILTERS):
        a += z[:, i, None] * net.w1[i]
    a = np.tanh(a)
    logit = np.zeros(len(z), np.float32) + net.b2[0]
    for i in range(HIDDEN):
        logit += a[:, i] * net.w2[i]
    return logit


def gradient(net: Net, at: Layout, labels: np.ndarray) -> list[np.ndarray]:
    # Two bytes a row: a filter's taps at a place are TAPS / 2 rows from there on.
    pairs, taps, m = net.bytes[at.bytes].reshape(-1, 2 * WIDTH), net.taps.reshape(TAPS // 2, 2 * WIDTH, FILTERS), at.n
    h = pairs[:m] @ taps[0]
    for j in range(1, TAPS // 2):
        h += pairs[j : j + m] @ taps[j]
    h += net.bias
    np.maximum(h, 0, out=h)
    groups, top, after, chunk, most, z = _pooled(at, h)
    a = np.tanh(z @ net.w1 + net.b1)
    logit = a @ net.w2 + net.b2[0]
    d = (1 / (1 + np.exp(-logit)) - labels).astype(np.float32) / len(labels)
    dw2, db2 = a.T @ d, np.array([d.sum()], np.float32)
    da = d[:, None] * net.w2 * (1 - a * a)
    dw1, db1 = z.T @ da, da.sum(0)
    dz = da @ net.w1.T
    owner = np.repeat(np.arange(len(at.units)), at.units)
    best = (chunk == most[owner]) & at.chunk[:, None]  # equal ones share what comes back
    dchunk = (dz[:, :FILTERS] / at.chunks[:, None])[owner] + best * (dz[:, FILTERS:] / np.add.reduceat(best, at.first, axis=0, dtype=np.int64))[owner]
    dchunk *= at.chunk[:, None]
    dtop = np.where(top > after, dchunk, np.where(top == after, dchunk / 2, 0))
    dafter = dchunk - dtop
    dtop[1:] += dafter[:-1]
    best = groups == top[:, None, :]
    dgroups = best * (dtop / best.sum(1))[:, None, :]
    dblocks = (dgroups.reshape(-1, FILTERS) * at.held).astype(np.float32)
    dh = np.repeat(dblocks / np.float32(BLOCK // 2), BLOCK // 2, axis=0)
    dh *= h > 0
    each = np.zeros_like(pairs)
    for j in range(TAPS // 2):
        each[j : j + m] += dh @ taps[j].T
    dtaps = np.stack([pairs[j : j + m].T @ dh for j in range(TAPS // 2)]).reshape(TAPS, WIDTH, FILTERS)
    each = each.reshape(-1, WIDTH)
    dbytes = np.stack([np.bincount(at.bytes, weights=each[:, i], minlength=256) for i in range(WIDTH)], axis=1).astype(np.float32)
    return [dbytes, dtaps, dh.sum(0), dw1, db1, dw2, db2]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Adam on the mean log loss, with a fixed order of draws: the same rows give the same network."""
    one_thread()
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    names = [f.name for f in fields(Net)]
    m1, m2, t = [np.zeros_like(getattr(net, n)) for n in names], [np.zeros_like(getattr(net, n)) for n in names], 0
    steps = max(epochs, -(-600 * BATCH // max(1, len(texts))) if len(texts) < 600 * BATCH // epochs else epochs)
    for epoch in range(min(steps, 60)):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            g = gradient(net, Layout([texts[i] for i in pick]), labels[pick])
            t += 1
            rate = 0.01 if epoch < min(steps, 60) * 0.7 else 0.002
            for k, n in enumerate(names):
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.01 * (g[k] * g[k] - m2[k])
                getattr(net, n)[...] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)
    return net


def excerpt(text: bytes, most: int = TRAIN_BYTES) -> bytes:
    if len(text) <= most:
        return text
    third, middle = most // 3, len(text) // 2
    return text[:third] + text[middle - third // 2 : middle + third // 2] + text[-third:]


@dataclass
class Model:
    net: Net | None
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        logit = forward(self.net, Layout(texts)) if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model of a bounded sample of the labelled documents."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.avg(label_col).alias("l"))
    n = own.count()
    if not n:
        return Model(None, 1.0)
    point = F.conv(F.substring(row_hash(F.col("l_id")), 1, 8), 16, 10).cast("double") / 2.0**32
    few = F.broadcast(own.where(point < min(1.0, rows / n)))  # about `rows` ids
    picked = docs.join(few, F.col(id_col) == F.col("l_id")).select("l_id", "l", F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("b"))
    n_bytes, third = F.octet_length("b"), TRAIN_BYTES // 3
    piece = F.when(n_bytes <= TRAIN_BYTES, F.col("b")).otherwise(F.concat(F.substring("b", 1, third), F.expr(f"substring(b, int(octet_length(b) / 2) - {third // 2} + 1, {third})"), F.expr(f"substring(b, octet_length(b) - {third} + 1, {third})")))
    found = picked.select("l_id", "l", row_hash(F.col("l_id")).alias("h"), piece.alias("b")).collect()
    found.sort(key=lambda r: (r["h"], bytes(r["b"])))
    y = np.array([r["l"] > 0.5 for r in found], np.float32)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y[0]) if len(y) else 1.0)
    return Model(fit([bytes(r["b"]) for r in found], y), float(y.mean()))


def _parts(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > most or i - at == 500):
            yield at, i
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def score(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """docs with a score; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(as_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(as_col, T.DoubleType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for lo, hi in _parts(pc.binary_length(whole.column(at)).fill_null(0).to_numpy(zero_copy_only=False)):
                part = whole.slice(lo, hi - lo)
                found = own.scores([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, as_col])
            give_back()

    return docs.mapInArrow(run, schema)


HOLD, HOLD_OF, THRESHOLD = 2, 4, 0.7


def learn_folded(spark, sf_dir: str) -> Model:
    """A model that never saw labels of the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(fold(F.col("doc_id"), HOLD_OF) != HOLD)
    return learn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = score(docs, learn_folded(spark, sf_dir))
    held = F.coalesce(fold(F.col("doc_id"), HOLD_OF) == HOLD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
