"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a sample of labelled text. A text is parsed greedily into
phrases, each the longest match that the automaton has from there on, so a language whose sample shares long
strings with the text needs few phrases. The language with the fewest phrases a byte wins.

Sample bound: `SAMPLE_BYTES` bytes of text a language (less where there are so many languages that all samples would
take more than `ALL_BYTES`), of about `SAMPLE_ROWS` labelled rows in the order of a hash of their ids: whole rows of
at most `ROW_BYTES` first, the beginnings of longer ones only if those don't suffice. An automaton has at most twice
as many states and three times as many transitions as its sample has bytes. The transitions of all states lie in one
array, those of a state at its own offset between those of others, so that what is broadcast is some 30 bytes a
byte of the samples, whose sum is bounded.

Letters alone tell languages apart, so case is dropped and anything between letters is one separator. Texts
are parsed in lockstep: cut into strips of `STRIP` bytes, all strips of a slice of rows advance by one byte together
in numpy. Then each strip is parsed again from the state in which the one before ended, until a phrase begins where
one began the first time: from there on both agree. So the phrases are those of the whole text.

Defined results: a null text, and one without a letter, is `und` with score 0; repeated rows get the same
result; with no labelled rows everything is `und`; ties go to the language that sorts first; whole texts of any
length are parsed; columns other than id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, row_hash

SAMPLE_BYTES, SAMPLE_ROWS, ROW_BYTES, ALL_BYTES, STRIP = 48_000, 96, 6_000, 2 << 20, 512
#: Classes of bytes: A-Z and a-z are 1 to 26, bytes from 128 on (of letters outside ASCII) their own; all else is 0.
CLASSES = np.array([b - 101 if b >= 128 else ord(chr(b).lower()) - 96 if chr(b).isalpha() else 0 for b in range(256)], np.uint8)
N_CLASSES = int(CLASSES.max()) + 1


def classes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' classes end to end, runs of 0 made one and none at a start, and the length of each text."""
    codes = CLASSES[np.frombuffer(b"".join(texts), np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    starts = ends - [len(t) for t in texts]
    starts = starts[starts < len(codes)]
    keep[starts] = codes[starts] > 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], np.diff(upto[np.concatenate([[0], ends])])


class Automaton:
    """The suffix automaton of a string of classes. State 0 is the root and stands for "none", since no transition
    leads to it. The transition of state s by class c is at offset[s] + c, if `owner` there is s."""

    def __init__(self, sample: np.ndarray):
        next_: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sample.tolist():
            new, p = len(next_), last
            next_.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p >= 0:
                q = next_[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(next_)
                    next_.append(dict(next_[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and next_[p].get(c) == q:
                        next_[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self._lay(next_)

    def _lay(self, next_: list[dict[int, int]], look: int = 1024) -> None:
        """States with several transitions go to the first offset where all find room, the others to what is left."""
        room = sum(map(len, next_)) + N_CLASSES * (sum(len(m) > 1 for m in next_) + 2)
        used, self.offset, top, low = np.zeros(room + look + N_CLASSES, bool), np.zeros(len(next_), np.int32), 0, 0
        for s in sorted((s for s, m in enumerate(next_) if len(m) > 1), key=lambda s: (-len(next_[s]), s)):
            own, at = np.array(list(next_[s])), low
            while True:
                free = ~np.logical_or.reduce([used[at + c : at + c + look] for c in own])
                if free.any():
                    break
                at += look
            at += int(free.argmax())
            low = max(low, at - look) if len(own) < 4 else low  # what lies far below is nearly full
            used[at + own] = True
            self.offset[s], top = at, max(top, at)
        single = [s for s, m in enumerate(next_) if len(m) == 1]
        holes = np.flatnonzero(~used[N_CLASSES:])[: len(single)] + N_CLASSES
        self.offset[single] = holes - np.array([next(iter(next_[s])) for s in single], np.int64)
        size = int(max([top, *holes[-1:]])) + N_CLASSES + 1
        self.owner, self.to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for s, moves in enumerate(next_):
            for c, t in moves.items():
                self.owner[self.offset[s] + c], self.to[self.offset[s] + c] = s, t
        self.root = np.zeros(N_CLASSES, np.int32)
        for c, t in next_[0].items():
            self.root[c] = t

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a byte, and where a phrase begins with it. A byte that the sample lacks is a phrase."""
        at = self.offset[state] + c
        to = self.to[at]
        to[self.owner[at] != state] = 0
        begins = state == 0
        fail = np.flatnonzero(to == 0)
        begins[fail] = True
        to[fail] = self.root[c[fail]]
        return to, begins


def phrases(table: Automaton, strips: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases that begin in each strip (a column of `strips`, sorted by falling length) of the parse of whole texts.
    `before` names the strip that comes before in the same text, or is -1."""
    n_strips = strips.shape[1]
    state, began = np.zeros(n_strips, np.int32), np.zeros(strips.shape, bool)
    live = np.searchsorted(-lengths, -np.arange(strips.shape[0]), side="left")
    for i in range(strips.shape[0]):
        n = int(live[i])
        if not n:
            break
        state[:n], began[i, :n] = table.step(state[:n], strips[i, :n])
    first = began.sum(0, dtype=np.int64)
    count, after, passed = first.copy(), np.full(n_strips, -1), np.full(n_strips, -1, np.int32)
    behind = np.flatnonzero(before >= 0)
    after[before[behind]] = behind
    lanes, now = behind, state[before[behind]]
    while len(lanes):
        passed[lanes] = now
        end, change, met = now.copy(), np.zeros(len(lanes), np.int64), np.zeros(len(lanes), bool)
        open_ = np.arange(len(lanes))
        for i in range(strips.shape[0]):
            open_ = open_[(lengths[lanes[open_]] > i) & ~met[open_]]
            if not len(open_):
                break
            at = lanes[open_]
            to, begins = table.step(end[open_], strips[i, at])
            own = began[i, at]
            change[open_] += begins.astype(np.int64) - own
            end[open_] = to
            met[open_[begins & own]] = True
        count[lanes] = first[lanes] + change
        end = np.where(met, state[lanes], end)
        # The strip behind is parsed anew where its text comes to it in another state than was thought.
        behind = after[lanes]
        anew = (behind >= 0) & (passed[behind] != end)
        lanes, now = behind[anew], end[anew]
    return count


def parse(tables: list[Automaton], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text by each table: [text, table]; and the lengths that were parsed."""
    out = np.zeros((len(texts), len(tables)), np.int64)
    codes, sizes = classes(texts)
    n_strips = -(-sizes // STRIP)
    total = int(n_strips.sum())
    if not total or not tables:
        return out, sizes
    owner = np.repeat(np.arange(len(texts)), n_strips)
    nth = np.arange(total) - np.repeat(np.cumsum(n_strips) - n_strips, n_strips)
    lengths = np.minimum(STRIP, sizes[owner] - nth * STRIP)
    padded = np.zeros((total, STRIP), np.uint8)
    padded[np.arange(STRIP) < lengths[:, None]] = codes
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    before = np.where(nth[order] > 0, place[order - 1], -1)
    strips = np.ascontiguousarray(padded[order].T).astype(np.int32)
    for k, table in enumerate(tables):
        out[:, k] = np.bincount(owner[order], weights=phrases(table, strips, lengths[order], before), minlength=len(texts))
    return out, sizes


def samples(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Text by language of rows with a language; see the module's text for its bound."""
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    spark = labelled.sparkSession
    # Twice as many rows as wanted are expected below the limit; the hash orders them.
    limits = spark.createDataFrame([(k, min(1.0, 2.0 * SAMPLE_ROWS / n)) for k, n in counts.items()], "l string, p double")
    point = F.conv(F.substring(row_hash(F.col(id_col)), 1, 8), 16, 10).cast("double") / 2.0**32
    near = named.join(F.broadcast(limits), F.col(lang_col) == F.col("l")).where(point < F.col("p"))
    raw = F.encode(F.col(text_col), "UTF-8")
    rows = near.select("l", row_hash(F.col(id_col)).alias("h"), (F.octet_length(text_col) > ROW_BYTES).alias("cut"), F.substring(raw, 1, ROW_BYTES).alias("b")).collect()
    most, found = min(SAMPLE_BYTES, ALL_BYTES // len(counts)), {}
    for lang in sorted(counts):
        seen, parts, size = set(), [], 0
        for r in sorted((r for r in rows if r["l"] == lang), key=lambda r: (r["cut"], r["h"], bytes(r["b"]))):
            b = bytes(r["b"])
            if b not in seen and size < most:  # a copy teaches nothing
                seen.add(b)
                parts.append(b[: most - size])
                size += len(parts[-1])
        found[lang] = b" ".join(parts)
    return found


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, Automaton]:
    """Automata by language."""
    return {lang: Automaton(classes([b])[0]) for lang, b in samples(labelled, id_col, text_col, lang_col).items()}


def identify(docs: DataFrame, models: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, phrases_per_kb (of the language found): one row for each row of docs."""
    langs, sent = list(models), docs.sparkSession.sparkContext.broadcast(list(models.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for whole in batches:
            for at in _parts(pc.binary_length(whole["text"]).fill_null(0).to_numpy(zero_copy_only=False)):
                batch = whole.slice(at[0], at[1] - at[0])
                texts = [(t or "").encode() for t in batch["text"].to_pylist()]
                counts, sizes = parse(tables, texts)
                rate = counts / np.maximum(1, sizes)[:, None]
                known = np.array(batch["letters"].to_pylist(), bool) & bool(langs)
                best = rate.argmin(1) if langs else np.zeros(len(texts), int)
                least = rate[np.arange(len(texts)), best] if langs else np.zeros(len(texts))
                other = np.sort(rate, axis=1)[:, 1] if len(langs) > 1 else np.ones(len(texts))
                # How much fewer phrases than the next language needs, from a tie (0.5) to none at all (1).
                score = np.where(known, 1 - 0.5 * least / np.maximum(other, 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([langs[b] if k else "und" for b, k in zip(best, known)]), pa.array(np.clip(score, 0, 1)), pa.array(np.where(known, least * 1000, 0.0))], names=["doc_id", "lang_pred", "score", "phrases_per_kb"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, phrases_per_kb double")


def _parts(sizes: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes, or one row."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    models = learn(docs.where(~F.coalesce(held, F.lit(False))), "doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), models).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "phrases_per_kb")
