"""Reversible line deduplication: exact references, with sharded cuckoo filters in front of them.

State is tables in the shared folder, to which changes append. `postings` (h1, h2, doc_id, gen) holds one row for
each document and distinct key of at least `min_chars` code points; a key is a 128-bit hash of the stripped, A-Z
lower-cased line. `refs` (h1, h2, n_docs, last_doc, gen) counts them exactly; the row of the latest generation
holds. `gone` (doc_id, gen) names deleted documents: postings of earlier generations are dead. `filters` (shard,
n_keys, n_buckets, slots) holds, by shard of the key's hash, a cuckoo filter of the keys that at least `min_docs`
documents hold: the keys whose lines go.

A change counts anew only the keys that its documents hold: an insertion adds to their references, a deletion
recounts them from the postings that remain, and either moves only the keys that cross the threshold in or out of
the filters, so that a deletion undoes an insertion. After `parts` changes the tables are written anew as one. A
filter shard that overflows is built anew from the references.

A rewrite probes the filters first, always: lines they don't know stay. The others are joined with `refs`, which
removes the filters' false positives. Filters of at most `broadcast_bytes` are sent to all tasks; larger ones
meet the keys by shard, a shard's keys in groups of about `PROBE_ROWS`, each with a copy of that one filter.

Defined results: a null or empty text is one empty line and stays; repeated rows of one doc_id count as
one document and are each rewritten; no rows give no rows; columns other than id and text are carried along
by `rewrite`, and those named like its own (`n_lines`, `n_dropped`) are replaced; rows with a null id hold
no references and lose no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lowered, frugal, stored

SLOTS = 4  # in a bucket of a filter
BLANK = "\t\n\x0b\x0c\r "


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints over 64-bit hashes; 0 marks a free slot."""

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        assert n_buckets & (n_buckets - 1) == 0
        self.n, self.slots = n_buckets, np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @staticmethod
    def sized(keys: int) -> "Cuckoo":
        return Cuckoo(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8))))))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(self.n - 1)).astype(np.int64)
        return print_, one, one ^ self.jump(print_)

    def jump(self, print_: np.ndarray) -> np.ndarray:
        return ((print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.n - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        f, a, b = self.places(hashes)
        return (self.slots[a] == f[:, None]).any(1) | (self.slots[b] == f[:, None]).any(1)

    def _put(self, f: int, at: int, turn: int) -> bool:
        """Displaces fingerprints from bucket `at` on until one finds a free slot."""
        s = self.slots
        for i in range(500):
            free = np.flatnonzero(s[at] == 0)
            if len(free):
                s[at, free[0]] = f
                return True
            k = (i + turn) % SLOTS
            f, s[at, k] = int(s[at, k]), f
            at ^= int(self.jump(np.array([f], np.uint16))[0])
        return False

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; its contents are then void and a larger one must be built."""
        f, a, b = self.places(hashes)
        todo = np.arange(len(f))
        for place in (a, b):  # all that find room in their first bucket, then in their second one
            todo = todo[np.argsort(place[todo], kind="stable")]
            at = place[todo]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.slots[at] == 0
            fits = nth < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[fits, nth[fits]]
            self.slots[at[fits], slot] = f[todo[fits]]
            todo = todo[~fits]
        return all(self._put(int(f[i]), int(b[i]), int(i)) for i in todo)

    def delete(self, hashes: np.ndarray) -> None:
        f, a, b = self.places(hashes)
        for i in range(len(f)):
            for at in (int(a[i]), int(b[i])):
                found = np.flatnonzero(self.slots[at] == f[i])
                if len(found):
                    self.slots[at, found[0]] = 0
                    break


def build(hashes: np.ndarray) -> Cuckoo:
    room = len(hashes)
    while not (made := Cuckoo.sized(room)).insert(hashes):
        room *= 2
    return made


FILTERS = "shard int, n_keys bigint, n_buckets int, slots binary"


def _filter_row(shard: int, n: int, c: Cuckoo) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([n], pa.int64()), "n_buckets": pa.array([c.n], pa.int32()), "slots": pa.array([c.slots.tobytes()], pa.binary())})


def _open(n_buckets: int, slots: bytes) -> Cuckoo:
    return Cuckoo(n_buckets, np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    h = rows["h1"].to_numpy()
    return _filter_row(key[0].as_py(), len(h), build(h))


def _change_shard(key: tuple, old: pa.Table, rows: pa.Table) -> pa.Table:
    """Applies a shard's additions and removals to its filter; n_keys is -1 if it overflows and must be built anew, larger."""
    sign = rows["sign"].to_numpy() if rows.num_rows else np.zeros(0, np.int32)
    h = rows["h1"].to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    out = [_open(o["n_buckets"], o["slots"]) for o in old.to_pylist()]
    c = out[0] if out else Cuckoo.sized(len(h))
    n = sum(old["n_keys"].to_pylist()) + int((sign > 0).sum()) - int((sign < 0).sum())
    c.delete(h[sign < 0])
    # An overflow loses a fingerprint: what the filter holds is void.
    if not c.insert(h[sign > 0]):
        return _filter_row(key[0].as_py(), -1, Cuckoo(1))
    return _filter_row(key[0].as_py(), n, c)


def _probe_group(key: tuple, pairs: pa.Table, filters: pa.Table) -> pa.Table:
    keep = np.zeros(pairs.num_rows, bool)
    if filters.num_rows and pairs.num_rows:
        own = _open(filters["n_buckets"][0].as_py(), filters["slots"][0].as_py())
        keep = own.has(pairs["h1"].to_numpy())
    return pairs.select(["h1", "h2", "doc_id"]).filter(pa.array(keep))


PROBE_ROWS, SHARD_KEYS = 1_000_000, 50_000
KEY, POSTINGS, REFS = ["h1", "h2"], "h1 bigint, h2 bigint, doc_id bigint, gen int", "h1 bigint, h2 bigint, n_docs bigint, last_doc bigint, gen int"


@dataclass(frozen=True)
class LineIndex:
    """The tables of the state; see the module's text. Every change returns a new index, the old one stays valid."""

    spark: SparkSession
    postings: DataFrame
    refs: DataFrame
    gone: DataFrame
    filters: DataFrame
    gen: int = 0
    since: int = 0  # the generation in which all parts were last written as one
    deleted: bool = False
    shards: int = 64
    min_chars: int = 20
    min_docs: int = 3
    broadcast_bytes: int = 64 << 20
    parts: int = 8

    @staticmethod
    def empty(spark: SparkSession, **parameters) -> "LineIndex":
        make = spark.createDataFrame
        return LineIndex(spark, make([], POSTINGS), make([], REFS), make([], "doc_id bigint, gen int"), make([], FILTERS), **parameters)

    def keys(self, text: Column) -> Column:
        """For each line of the text its key as struct<h1,h2>, null for lines that are too short to count."""
        # One step a transform: inside a lambda nothing that is used twice is computed once.
        lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
        bare = F.transform(lines, lambda line: F.trim(line, F.lit(BLANK)))
        low = F.transform(bare, lambda b: F.when(F.length(b) >= self.min_chars, ascii_lowered(b)))
        return F.transform(low, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("ledger"), k).alias("h2"))))

    def pairs(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """One row for each document and distinct key of it."""
        own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.array_distinct(F.filter(self.keys(F.col(text_col)), lambda k: k.isNotNull())).alias("ks"))
        return own.select("doc_id", F.explode("ks").alias("k")).select(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"), "doc_id")

    def shard(self) -> Column:
        return F.pmod(F.col("h2"), F.lit(self.shards)).cast("int").alias("shard")

    def live(self) -> DataFrame:
        """The postings of documents that weren't deleted since."""
        if not self.deleted:
            return self.postings
        dead = self.gone.groupBy(F.col("doc_id").alias("g_id")).agg(F.max("gen").alias("g_gen"))
        return self.postings.join(dead, (F.col("doc_id") == F.col("g_id")) & (F.col("gen") < F.col("g_gen")), "left_anti")

    def current(self, refs: DataFrame | None = None) -> DataFrame:
        """h1, h2, n_docs, last_doc: the latest row of each key of `refs`."""
        refs = self.refs if refs is None else refs
        if self.gen == self.since:  # one part, which has each key once
            return refs.drop("gen")
        last = refs.groupBy(*KEY).agg(F.max_by(F.struct("n_docs", "last_doc"), "gen").alias("x"))
        return last.select(*KEY, "x.n_docs", "x.last_doc")

    def frequent(self) -> DataFrame:
        return self.current().where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """References of further documents. Ids that the index holds already must be deleted first."""
        gen = self.gen + 1
        new = stored(self.pairs(docs, id_col, text_col).withColumn("gen", F.lit(gen)), "line-postings")
        if not self.gen:
            refs = stored(_counted(new).withColumn("gen", F.lit(gen)), "line-refs")
            return replace(self, postings=new, refs=refs, gen=gen, since=gen)._built()
        added = stored(_counted(new).withColumnsRenamed({"n_docs": "more", "last_doc": "later"}), "line-added")
        then = self.current(self.refs.join(added.select(*KEY), KEY, "left_semi"))
        changed = added.join(then, KEY, "left").select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"), F.coalesce("n_docs", F.lit(0)).alias("was"))
        return self._changed(gen, changed, postings=self.postings.unionByName(new))

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> "LineIndex":
        """Undoes the insertion of documents."""
        gen = self.gen + 1
        ids = stored(doc_ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "line-gone")
        less = stored(self.live().join(ids, "doc_id", "left_semi").groupBy(*KEY).agg(F.count_distinct("doc_id").alias("less")), "line-less")
        left = _counted(self.live().join(ids, "doc_id", "left_anti").join(less.select(*KEY), KEY, "left_semi"))
        n = F.coalesce("n_docs", F.lit(0))
        changed = less.join(left, KEY, "left").select(*KEY, n.alias("n_docs"), "last_doc", (n + F.col("less")).alias("was"))
        return self._changed(gen, changed, deleted=True, gone=self.gone.unionByName(ids.withColumn("gen", F.lit(gen))))

    def _changed(self, gen: int, changed: DataFrame, **state) -> "LineIndex":
        """The index after a change, given the new references of the keys it touched and what they were."""
        changed = stored(changed.withColumn("gen", F.lit(gen)), "line-refs")
        after = replace(self, gen=gen, refs=self.refs.unionByName(changed.drop("was")), **state)
        up, down = F.col("n_docs") >= self.min_docs, F.col("was") >= self.min_docs
        moves = changed.where(up != down).select("h1", F.when(up, 1).otherwise(-1).alias("sign"), self.shard())
        filters = stored(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(_change_shard, FILTERS), "line-filters")
        full = filters.where("n_keys < 0").select("shard")
        if not full.isEmpty():
            built = after.frequent().select("h1", self.shard()).join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_build_shard, FILTERS)
            filters = stored(filters.where("n_keys >= 0").unionByName(built), "line-filters")
        after = replace(after, filters=filters)
        if (filters.agg(F.sum("n_keys")).first()[0] or 0) // SHARD_KEYS + 1 > self.shards:
            after = after._built(2)
        return after if gen - self.since < self.parts else after.compacted()

    def _built(self, spare: int = 1) -> "LineIndex":
        """All filters anew, of as many shards as the frequent keys ask for."""
        keys = self.frequent().select(*KEY)
        made = replace(self, shards=max(self.shards, spare * (keys.count() // SHARD_KEYS + 1)))
        filters = keys.select("h1", made.shard()).groupBy("shard").applyInArrow(_build_shard, FILTERS)
        return replace(made, filters=stored(filters, "line-filters"))

    def compacted(self) -> "LineIndex":
        """The same state as one part a table."""
        gen = F.lit(self.gen)
        postings = stored(self.live().select(*KEY, "doc_id", gen.alias("gen")), "line-postings")
        refs = stored(self.current().where("n_docs > 0").withColumn("gen", gen), "line-refs")
        return replace(self, postings=postings, refs=refs, gone=self.gone.limit(0), deleted=False, since=self.gen)

    def maybe(self, pairs: DataFrame) -> DataFrame:
        """The pairs (h1, h2, doc_id) whose key the filters know."""
        held = self.filters.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        return self._sent(pairs) if held <= self.broadcast_bytes else self._met(pairs)

    def _sent(self, pairs: DataFrame) -> DataFrame:
        sent, shards = self.spark.sparkContext.broadcast([tuple(r) for r in self.filters.select("shard", "n_buckets", "slots").collect()]), self.shards

        @frugal
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {s: _open(b, raw) for s, b, raw in sent.value}
            for batch in batches:
                h1, h2 = batch["h1"].to_numpy(zero_copy_only=False), batch["h2"].to_numpy(zero_copy_only=False)
                at, keep = h2 % shards, np.zeros(len(h1), bool)
                order = np.argsort(at, kind="stable")
                edges = np.flatnonzero(np.diff(at[order], prepend=-1))
                for lo, hi in zip(edges, [*edges[1:], len(order)]):
                    rows = order[lo:hi]
                    if (s := int(at[rows[0]])) in known:
                        keep[rows] = known[s].has(h1[rows])
                yield batch.filter(pa.array(keep))

        return pairs.mapInArrow(probe, pairs.schema)

    def _met(self, pairs: DataFrame) -> DataFrame:
        own = pairs.withColumn("shard", self.shard())
        salts = stored(own.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("salts")), "line-salts")
        salted = own.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "h1"), "salts").cast("int"))
        spread = salts.select(F.col("shard").alias("f_shard"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("f_salt"))
        copies = self.filters.join(spread, F.col("shard") == F.col("f_shard")).select("f_shard", "f_salt", "n_buckets", "slots")
        return salted.groupBy("shard", "salt").cogroup(copies.groupBy("f_shard", "f_salt")).applyInArrow(_probe_group, "h1 bigint, h2 bigint, doc_id bigint")

    def doomed(self) -> DataFrame:
        """doc_id, gone: by document the keys whose lines it loses, for documents that lose any."""
        hit = self.maybe(self.live().select(*KEY, "doc_id")).join(self.frequent(), KEY).where("doc_id < last_doc")
        return hit.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("gone"))

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with the text rewritten, plus n_lines and n_dropped."""
        docs = docs.drop("n_lines", "n_dropped")
        gone = self.doomed().select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
        joined = docs.join(gone, F.col(id_col) == F.col("__id"), "left").drop("__id")
        joined = joined.withColumn("__keys", F.when(F.col("__gone").isNotNull(), self.keys(F.col(text_col))))
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return joined.mapInArrow(_rewriter(text_col), schema)


def _rewriter(text_col: str):
    """Drops the lines whose keys are gone; only documents that lose some are looked at line by line."""
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            n_lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
            dropped = np.zeros(batch.num_rows, np.int64)
            hit = np.flatnonzero(pc.is_valid(batch["__gone"]).to_numpy(zero_copy_only=False))
            if len(hit):
                out = texts.to_pylist()
                for i in hit.tolist():
                    gone = {(k["h1"], k["h2"]) for k in batch["__gone"][i].as_py()}
                    lines = out[i].split("\n")
                    kept = [x for x, k in zip(lines, batch["__keys"][i].as_py()) if k is None or (k["h1"], k["h2"]) not in gone]
                    dropped[i] = len(lines) - len(kept)
                    out[i] = "\n".join(kept)
                texts = pa.array(out, pa.string())
            columns = [texts if c == text_col else batch.column(j) for j, c in enumerate(batch.schema.names[:-2])]
            yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(dropped)], names=[*batch.schema.names[:-2], "n_lines", "n_dropped"])

    return run


def _counted(postings: DataFrame) -> DataFrame:
    """Repeated rows of a document count once; each stage of the count combines before its shuffle."""
    return postings.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Inserts all documents in an empty index and rewrites them by it."""
    return LineIndex.empty(docs.sparkSession, **parameters).insert(docs, id_col, text_col).rewrite(docs, id_col, text_col)


def op2_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH ws AS (SELECT chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' AS b),
docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM docs),
keyed AS (SELECT *, translate(trim(line, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines, ws),
refs AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last_doc AS gone FROM keyed k LEFT JOIN refs r ON k.key = r.key)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
