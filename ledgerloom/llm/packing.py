"""Packing token sequences into windows by non-negative least squares over the histogram of lengths.

Documents are cut into whole windows and a remainder. Shallow combinations of lengths that fill a window
(pairs, and families of three and four) are enumerated; non-negative least squares finds how often each
should occur so that together they use up the histogram; the counts are rounded down, and a greedy packs
what the rounding leaves, longest first. Only remainders that the greedy can't combine within `slack` tokens
are laid end to end and cut at window ends.

The plan works on the histogram, one count for each length up to the window, so it's the same work at any
size; which document takes which place follows from its rank among documents of its length. Ranks go by
buckets, so that one frequent length is ranked in many tasks.

Defined results: a null text is an empty one, whose only id is the end id; repeated rows are packed each;
no rows give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frugal, give_back, stored

WINDOW, END_ID, BUCKETS, SLACK, BROADCAST_ROWS = 2048, 1, 256, 4, 500_000
#: What a generation of words may hold, by their bytes, their ids' and ENTRY for the rest; longer words aren't kept.
YOUNG_BYTES, ENTRY, LONG_WORD = 32 << 20, 130, 256
ALNUM, SIGNS, SPECIAL = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789"), string.punctuation.encode(), b"<|"
#: New words that go to the tokenizer in one call; words whose ids are looked up together, but for texts of a slice.
TOGETHER, PORTION = 200, 50_000

PIECES = "doc_id bigint, text_hash bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


class Words(dict):
    """Ids by word, as little-endian unsigned 32-bit numbers, found when a word is first asked for. Two generations:
    when the young one is full it becomes the old one, from which words that are asked for again come back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.old, self.held = Tokenizer.from_file(path), {}, 0
        # Words of ASCII letters in lower case need nothing but the model.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONG_WORD:
            self.keep({word: ids})
        return ids

    def keep(self, ids: dict[bytes, bytes]) -> None:
        self.update(ids)
        self.held += sum(map(len, ids)) + sum(map(len, ids.values())) + ENTRY * len(ids)
        if self.held > YOUNG_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()

    def of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all these words. New words of letters are found together: a call for each costs several times as much."""
        found = dict(zip(words, map(self.get, words)))
        new = [w for w, ids in found.items() if ids is None]
        old = {w: ids for w, ids in zip(new, map(self.old.get, new)) if ids is not None}
        self.keep(old)
        found.update(old)
        # Signs at the end, after an ASCII letter or digit, are a token of their own, and most words come with several.
        signed, rest = {}, []
        for w in new:
            if w in old or len(w) > LONG_WORD:
                continue
            first = w.rstrip(SIGNS)
            if first and len(first) < len(w) and first[-1] in ALNUM and SPECIAL not in w:
                signed[w] = first
            else:
                rest.append(w)
        if signed:
            parts = self.of({*signed.values(), *(w[len(first) :] for w, first in signed.items())})
            whole = {w: parts[first] + parts[w[len(first) :]] for w, first in signed.items()}
            self.keep(whole)
            found.update(whole)
            known = {w: parts[w] for w in rest if w in parts}
            found.update(known)
            rest = [w for w in rest if w not in known]
        self._together(found, self.plain, [w for w in rest if w.isalpha()])  # bytes: ASCII letters alone
        self._together(found, self.tokenizer, [w for w in rest if not w.isascii() and w.decode().isalpha()])
        found.update((w, self[w]) for w in new if found[w] is None)
        return found

    def _together(self, found: dict[bytes, bytes], tokenizer, words: list[bytes]) -> None:
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) == len(part):  # else one isn't a single word to the tokenizer, and each is found by itself
                whole = ids.tobytes()
                own = dict(zip(part, [whole[a:b] for a, b in zip([0, *last], last)]))
                self.keep(own)
                found.update(own)


def _split(text: str | None) -> list[bytes]:
    """Words in lower case, but for those with the sign of special tokens, which the tokenizer finds before it lower-cases."""
    raw = (text or "").encode()
    return [w if SPECIAL in w else w.lower() for w in raw.split()] if SPECIAL in raw else raw.lower().split()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space and never joins what that separates, so ids are kept by
    lower-case word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = Words(path)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        end, split = np.array([END_ID], "<u4").tobytes(), [_split(t) for t in texts]
        short = [words for words in split if len(words) <= PORTION]
        get = self.words.of(set().union(*short)).__getitem__
        for words in split:
            if len(words) <= PORTION:
                yield b"".join(map(get, words)) + end
            else:
                parts = (words[i : i + PORTION] for i in range(0, len(words), PORTION))
                yield b"".join([b"".join(map(self.words.of(set(p)).__getitem__, p)) for p in parts]) + end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold few rows and, but for single rows, few bytes."""
    at, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch["text"]).to_pylist()):
        if i > at and (held + (n or 0) > size or i - at == rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _pieces(path: str, window: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for batch in _slices(whole):
                out: list[tuple] = []
                for doc, h, ids in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), encode(batch["text"].to_pylist())):
                    n = len(ids) // 4
                    out += [(doc, h, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_ARROW)
            give_back()

    return run


def _cut(path: str):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for batch in _slices(whole):
                crc = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n, ids in zip(batch["start"].to_pylist(), batch["length"].to_pylist(), encode(batch["text"].to_pylist()))]
                yield batch.drop_columns(["text"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return run


def combinations(lengths: list[int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Shallow combinations that fill the window from lengths that occur."""
    have, found = set(lengths), set()
    for a in lengths:
        rest = window - a
        tries = [(a,), (a, rest), (a, a, window - 2 * a), (a, rest // 2, rest - rest // 2), (a, rest // 3, rest - rest // 3), (a, rest // 4, rest - rest // 4), (a, a, a, window - 3 * a), (a, rest // 3, rest // 3, rest - 2 * (rest // 3))]
        found.update(tuple(sorted(t, reverse=True)) for t in tries if sum(t) == window and all(x in have for x in t))
    return sorted(found, reverse=True)


def solve(histogram: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = 60) -> list[float]:
    """Non-negative repeat counts x that minimise the squares of (histogram - sum of combinations),
    by exact coordinate descent."""
    left = {n: float(c) for n, c in histogram.items()}
    columns = [[(n, c.count(n)) for n in set(c)] for c in combos]
    norms = [sum(m * m for _, m in col) for col in columns]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(sum(left[n] * m for n, m in col) / norms[j], -x[j])
            if step > 1e-6 or step < -1e-6:
                x[j] += step
                for n, m in col:
                    left[n] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Combinations with their repeat counts, and the counts of lengths left to be laid end to end."""
    left = {n: c for n, c in histogram.items() if c > 0}
    combos = combinations(sorted(left), window)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((combo, times))
            for n in combo:
                left[n] -= times

    for combo, x in zip(combos, solve(left, combos)):
        use(combo, min([int(x + 1e-6), *(left[n] // combo.count(n) for n in set(combo))]))
    over: dict[int, int] = {}
    present = np.zeros(window + 1, bool)
    for n, c in left.items():
        present[n] = c > 0
    for n in range(window, 0, -1):
        while left.get(n, 0) > 0:
            combo, room = [n], window - n
            while room > 0:
                fit = np.flatnonzero(present[1 : room + 1])
                best = next((int(f) + 1 for f in fit[::-1] if left[int(f) + 1] > combo.count(int(f) + 1)), 0)
                if not best:
                    break
                combo.append(best)
                room -= best
            times = min(left[m] // combo.count(m) for m in set(combo))
            if room > slack:  # what fits worst is cut instead
                over[n] = over.get(n, 0) + left[n]
                left[n] = 0
            else:
                use(tuple(combo), times)
            for m in set(combo):
                present[m] = left[m] > 0
    return out, over


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    pieces = stored(texts.mapInArrow(_pieces(tokenizer_path, window), PIECES), "pack-pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(BUCKETS)))
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: `window` at most
    combos, over = plan(histogram, window)

    # Places by length: ranks [low, high) of a length go to `times` sequences, at one offset. A broadcast table of some thousand rows.
    places, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for combo, times in combos:
        offset = 0
        for n in combo:
            places.append((n, used[n], used[n] + times, sequence, offset, 0))
            used[n] += times
            offset += n
        sequence += times
    at = sequence * window
    for n, c in sorted(over.items(), reverse=True):
        places.append((n, used[n], used[n] + c, 0, at, n))
        at += n * c
    table = spark.createDataFrame(places, "p_length bigint, low bigint, high bigint, first_sequence bigint, place bigint, step bigint")

    upto = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    first = counts.withColumn("first", F.sum("n").over(upto) - F.col("n")).drop("n")
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "text_hash", "start")
    ranked = pieces.withColumn("nth", F.row_number().over(inside) - 1).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    there = F.when(F.col("step") == 0, (F.col("first_sequence") + F.col("rank") - F.col("low")) * window + F.col("place")).otherwise(F.col("place") + (F.col("rank") - F.col("low")) * F.col("step"))
    placed = placed.withColumn("there", there).withColumn("room", window - F.col("there") % window).select("doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", "there", "room")
    if not over:
        return _sequences(placed.drop("text_hash", "room"), window)
    placed = stored(placed, "pack-placed")
    whole = placed.where("length <= room").drop("text_hash", "room")
    split = placed.where("length > room")
    part = lambda start, length, there: F.struct(start.alias("start"), length.alias("length"), there.alias("there"))
    halves = split.select("doc_id", "text_hash", "doc_tokens", F.explode(F.array(part(F.col("start"), F.col("room"), F.col("there")), part(F.col("start") + F.col("room"), F.col("length") - F.col("room"), F.col("there") + F.col("room")))).alias("x")).select("doc_id", "text_hash", "doc_tokens", "x.start", "x.length", "x.there")
    keys = split.select(F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash")).distinct()
    if split.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)  # else every text would be shuffled for a few
    same = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash"))
    own = texts.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "o_doc", "text_hash": "o_hash"})
    joined = halves.join(own, same).drop("o_doc", "o_hash", "text_hash")
    cut = joined.mapInArrow(_cut(tokenizer_path), "doc_id bigint, doc_tokens bigint, start bigint, length bigint, there bigint, ids_crc32 bigint")
    return _sequences(whole.unionByName(cut), window)


def _sequences(rows: DataFrame, window: int) -> DataFrame:
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr(f"there div {window}").alias("sequence_id"), (F.col("there") % window).alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
