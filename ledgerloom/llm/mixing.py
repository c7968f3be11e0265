"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are laid end to end in a hashed order and cut into blocks of equal numbers of words.
Golden-ratio points, mapped through the cumulative target shares, deal slots to sources. A source's r-th slot
takes the r-th of its blocks in a shuffled order (a stride that has no divisor in common with their number; the
shorter last block comes last), starting again after all were taken. The last slot of a source is cut so that
its words meet the target. What is taken of a document are the spans that the slots take of its blocks.

Sources may be as many as hosts: running sums over them go by ranges of their order, those over the slots or
buckets of one source in two levels, so that none is summed in one task.

Defined results: null or blank texts have size 0 and nothing is taken of them; a null source is a source of
its own, last in order; repeated rows and repeated ids are rows of their own; no rows give no rows; columns
other than the id, text and source are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, row_hash, stored

#: Words in a block, slots that are ranked together, rows that are summed together, and rows of one range or bucket.
BLOCK_WORDS, SLOTS_TOGETHER, FAN, RANGE_ROWS, BUCKET_ROWS = 1024, 4096, 64, 100_000, 256
#: Coarse cells of the unit interval (a power of two), and the slots that a fine cell has on average.
CELLS, CELL_SLOTS = 4096, 16
#: round(2**31 / golden ratio), odd: its multiples modulo 2**31 are a golden-ratio sequence in exact integers.
GOLDEN, PERIOD = 1327217885, 2**31
#: Primes. A number of blocks that the first one divides takes the second one as its stride.
STRIDES = (10_000_019, 10_000_079)


def in_order(rows: DataFrame, n: int, order: list[str], **sums: Column) -> DataFrame:
    """rows with, for each name, the sum of its column over the rows before in the order, which has no ties."""
    placed = rows.withColumns({f"__{c}": v for c, v in sums.items()}).repartitionByRange(ceil(n / RANGE_ROWS) or 1, *order)
    placed = stored(placed.withColumn("__range", F.spark_partition_id()), "mix-ranges")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    held = placed.groupBy("__range").agg(*(F.sum(f"__{c}").alias(f"own_{c}") for c in sums))
    ranges = before(W.partitionBy(F.lit(0)).orderBy("__range"))  # a row for RANGE_ROWS sources
    held = held.select("__range", *(F.coalesce(F.sum(f"own_{c}").over(ranges), F.lit(0)).alias(f"base_{c}") for c in sums))
    inside = before(W.partitionBy("__range").orderBy(*order))
    out = placed.withColumns({c: F.coalesce(F.sum(f"__{c}").over(inside), F.lit(0)) for c in sums}).join(held, "__range")
    return out.withColumns({c: F.col(c) + F.col(f"base_{c}") for c in sums}).select(*rows.columns, *sums)


def upto(rows: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the group that come before by the whole number `order`."""
    rows = rows.withColumn("__few", F.expr(f"{order} div {FAN}"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    many = rows.groupBy(group, "__few").agg(F.sum(value).alias("__own"))
    many = many.select(group, "__few", F.coalesce(F.sum("__own").over(before(W.partitionBy(group).orderBy("__few"))), F.lit(0)).alias("__base"))
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(before(W.partitionBy(group, "__few").orderBy(order))), F.lit(0)))
    return rows.join(many, [group, "__few"]).withColumn(out, F.col(out) + F.col("__base")).drop("__few", "__base")


def source_targets(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """source_key, source_size, target, target_words for rows (source_key, size): one row a source.

    Targets fill up like water: sources sorted by ceiling to weight, a prefix of which is full."""
    own = stored(sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")), "mix-own")
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    all_weight = float(n // len(weights) * sum(weights) + sum(weights[: n % len(weights)]))
    ranked = in_order(own, n, ["source_key"], nth=F.lit(1).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    level = ranked.withColumn("cap", F.col("source_size") * F.lit(ceiling)).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = in_order(level, n, ["ratio", "source_key"], full=F.col("cap"), spent=F.col("weight"))
    level = stored(level.withColumn("rate", (F.lit(total * share) - F.col("full")) / (F.lit(all_weight) - F.col("spent"))), "mix-level")
    rate = level.agg(F.max(F.when(F.col("rate") < F.col("ratio"), F.col("rate")))).first()[0]
    target = F.when(F.col("rate") < F.col("ratio"), F.lit(rate) * F.col("weight")).otherwise(F.col("cap"))
    return level.select("source_key", "source_size", F.least("cap", target).alias("target")).withColumn("target_words", F.round("target").cast("long"))


def dealt_points(need: DataFrame, slots: int) -> DataFrame:
    """slot, source_key, batch: the source in whose interval [low, high) each slot's point lies.

    A coarse cell that lies in one interval names its source by itself: a table of CELLS rows at most, which is
    broadcast. Points of the other cells meet their sources by fine cells of a few points each."""
    points = need.sparkSession.range(slots).select(F.col("id").alias("slot"), (((F.col("id") % PERIOD) * GOLDEN % PERIOD) / F.lit(float(PERIOD))).alias("u"))
    grid = CELLS * (slots // (CELLS * CELL_SLOTS) + 1)
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS)).withColumn("fine", F.floor(F.col("u") * grid))
    upon = lambda low, high, of: F.explode(F.sequence(F.floor(low * of), F.least(F.floor(high * of), F.lit(of - 1).cast("long"))))
    cells = need.select("source_key", "low", "high", upon(F.col("low"), F.col("high"), CELLS).alias("cell"))
    begin, end = F.col("cell") / CELLS, (F.col("cell") + 1) / CELLS
    cells = stored(cells.withColumn("whole", (F.col("low") <= begin) & (F.col("high") >= end)), "mix-cells")
    whole = cells.where("whole").select("cell", F.col("source_key").alias("alone"))
    at = points.join(F.broadcast(whole), "cell", "left")
    fine = cells.where("not whole").select("source_key", "low", "high", upon(F.greatest(F.col("low"), begin), F.least(F.col("high"), end), grid).alias("fine")).distinct()
    met = at.where("alone is null").join(fine, "fine").where("u >= low and u < high").select("slot", "source_key")
    return at.where("alone is not null").select("slot", F.col("alone").alias("source_key")).unionByName(met).withColumn("batch", F.expr(f"slot div {SLOTS_TOGETHER}"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots in order: slot, source_key, epoch, block, take (words from the start of that block)."""
    block = F.lit(block_words)
    need = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    need = need.withColumn("slots", (F.expr("target_words div source_size") * F.col("blocks") + F.ceil((F.col("target_words") % F.col("source_size")) / block)).cast("long")).where("slots > 0")
    n, slots = need.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    need = in_order(need, n, ["source_key"], before=F.col("slots"))
    need = stored(need.withColumn("low", F.col("before") / F.lit(slots)).withColumn("high", (F.col("before") + F.col("slots")) / F.lit(slots)), "mix-sources")
    dealt = stored(dealt_points(need, slots), "mix-dealt")
    counts = stored(dealt.groupBy("source_key", "batch").agg(F.count("*").alias("n")), "mix-batches")
    first = upto(counts, "source_key", "batch", "n", "first").select("source_key", "batch", "first")
    ranked = dealt.join(first, ["source_key", "batch"]).withColumn("nth", F.col("first") + F.row_number().over(W.partitionBy("source_key", "batch").orderBy("slot")) - 1)
    # The points miss a source's number of slots by the sequence's discrepancy, a few: those follow at the end.
    have = need.join(counts.groupBy("source_key").agg(F.sum("n").alias("have")), "source_key", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    late = have.where("have < slots").select("source_key", "have", F.explode(F.sequence("have", F.col("slots") - 1)).alias("nth")).select((F.lit(slots) + F.col("nth") - F.col("have")).cast("long").alias("slot"), "source_key", "nth")
    placed = ranked.select("slot", "source_key", "nth").unionByName(late).join(need.select("source_key", "source_size", "target_words", "blocks", "slots"), "source_key").where("nth < slots")
    placed = placed.withColumn("epoch", F.expr("nth div blocks")).withColumn("turn", F.col("nth") % F.col("blocks")).withColumn("even", F.expr(f"source_size div {block_words}"))
    stride = F.when(F.col("even") % STRIDES[0] == 0, F.lit(STRIDES[1])).otherwise(F.lit(STRIDES[0])) % F.col("even")
    placed = placed.withColumn("block", F.when(F.col("turn") < F.col("even"), F.col("turn") * stride % F.col("even")).otherwise(F.col("turn")))
    there = F.col("turn") * block  # words that the slots before took in this epoch
    take = F.least(block, F.col("source_size") - there, F.col("target_words") - F.col("epoch") * F.col("source_size") - there)
    return placed.select("slot", "source_key", "epoch", "block", take.alias("take"))


def placed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, tag_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their first word's place in the hashed run of their source, and the sources' targets.

    The running sum goes by buckets of the hashed order, so that a source with most rows is still
    summed in many tasks: sums a bucket, then sums inside one."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    buckets = docs.count() // BUCKET_ROWS + 1
    sized = docs.select(F.col(id_col).alias("doc_id"), key.alias("source_key"), size.alias("size"), F.coalesce(row_hash(F.col(id_col)), F.lit("")).alias("order"), (F.col(tag_col) if tag_col else F.lit(0)).cast("long").alias("tag"))
    at = F.conv(F.rpad(F.substring("order", 1, 8), 8, "0"), 16, 10).cast("long")
    sized = stored(sized.withColumn("bucket", F.shiftright(at * F.lit(buckets), 32)), "mix-sizes")
    sums = stored(sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("own")), "mix-buckets")
    offsets = upto(sums, "source_key", "bucket", "own", "offset").select("source_key", "bucket", "offset")
    inside = W.partitionBy("source_key", "bucket").orderBy("order", "size", "tag")
    run = sized.withColumn("nth", F.row_number().over(inside)).withColumn("start", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    run = run.join(offsets, ["source_key", "bucket"]).withColumn("start", F.col("start") + F.col("offset"))
    return run.select("doc_id", "tag", "source_key", "bucket", "nth", "size", "start"), stored(source_targets(sized), "mix-targets")


SPANS = "array<struct<epoch: bigint, at: bigint, n: bigint, slot: bigint>>"


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tag_col: str | None = None) -> DataFrame:
    """doc_id, tag, size, source_size, target, taken, first_slot, n_slots, spans: one row for each row of docs.

    spans (epoch, at, n, slot) are the words taken, in order: n words after the first `at` ones, in that pass over
    the source, by that slot. `tag` is the number in `tag_col`, by which a caller tells rows apart."""
    run, targets = placed_documents(docs, id_col, text_col, source_col, tag_col)
    run = stored(run, "mix-run")
    parts = run.where("size > 0").select("source_key", "bucket", "nth", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    met = parts.join(schedule(targets, block_words), ["source_key", "block"])
    there = F.col("block") * F.lit(block_words)
    begin = F.greatest("start", there)
    met = met.withColumn("at", begin - F.col("start")).withColumn("n", F.least(F.col("start") + F.col("size"), there + F.col("take")) - begin).where("n > 0")
    taken = met.groupBy("source_key", "bucket", "nth").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"), F.array_sort(F.collect_list(F.struct("epoch", "at", "n", "slot"))).alias("spans"))
    none = F.lit(0).cast("long")
    full = run.join(taken, ["source_key", "bucket", "nth"], "left").join(targets.select("source_key", "source_size", "target"), "source_key")
    return full.select("doc_id", "tag", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def op7_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('0' || source, '1') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS ord
  FROM documents),
own AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
ranked AS (SELECT k, source_size, 2.0 * source_size AS cap,
                  CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM own),
level AS (SELECT *, cap / w AS ratio,
  ((SELECT sum(source_size) FROM own) * 1.5 - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER before, 0)) AS rate
  FROM ranked WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT k, source_size,
  CAST(least(cap, CASE WHEN rate < ratio THEN w * max(CASE WHEN rate < ratio THEN rate END) OVER () ELSE cap END) AS DOUBLE) AS target FROM level),
need0 AS (SELECT k, source_size, CAST(round(target) AS BIGINT) AS words, CAST(ceil(source_size / 1024) AS BIGINT) AS blocks, source_size // 1024 AS even FROM targets WHERE source_size > 0),
need1 AS (SELECT *, (words // source_size) * blocks + CAST(ceil((words % source_size) / 1024) AS BIGINT) AS slots FROM need0),
need AS (SELECT *, CAST(sum(slots) OVER () AS BIGINT) AS every, CAST(sum(slots) OVER (ORDER BY k) AS BIGINT) AS upto FROM need1 WHERE slots > 0),
points AS (SELECT slot, ((slot % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT max(every) FROM need))) AS slot)),
dealt AS (SELECT slot, k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS nth
  FROM points JOIN need ON u >= (upto - slots)::DOUBLE / every AND u < upto::DOUBLE / every),
have AS (SELECT need.k, every, slots, count(dealt.k) AS have FROM need LEFT JOIN dealt ON dealt.k = need.k GROUP BY ALL),
late AS (SELECT every + nth - have AS slot, k, nth FROM (SELECT k, every, have, unnest(range(have, slots)) AS nth FROM have)),
turns AS (SELECT d.slot, n.*, nth // blocks AS epoch, nth % blocks AS turn FROM (SELECT slot, k, nth FROM dealt UNION ALL SELECT slot, k, nth FROM late) d JOIN need n ON n.k = d.k WHERE nth < slots),
slots AS (SELECT slot, k, CASE WHEN turn < even THEN turn * ((CASE WHEN even % 10000019 = 0 THEN 10000079 ELSE 10000019 END) % even) % even ELSE turn END AS block,
  least(1024, source_size - turn * 1024, words - epoch * source_size - turn * 1024) AS take FROM turns),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k ORDER BY ord, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start FROM sized),
parts AS (SELECT rid, k, start, size, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM placed WHERE size > 0),
met AS (SELECT rid, slot, least(start + size, p.block * 1024 + take) - greatest(start, p.block * 1024) AS n FROM parts p JOIN slots s ON s.k = p.k AND s.block = p.block),
taken AS (SELECT rid, sum(n) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM met WHERE n > 0 GROUP BY rid)
SELECT p.doc_id, p.size, t.source_size, t.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken, CAST(x.first_slot AS BIGINT) AS first_slot, CAST(coalesce(x.n_slots, 0) AS BIGINT) AS n_slots
FROM placed p JOIN targets t ON t.k = p.k LEFT JOIN taken x ON x.rid = p.rid
"""
