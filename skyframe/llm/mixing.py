"""Mixing sources to target weights by a golden-ratio schedule of equal-token blocks (operator 3)."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_in_order, running_sum, save, table, unused, word_count

#: Words of a block at most and at least, and blocks that the smallest target should have.
BLOCK, LEAST_BLOCK, BLOCKS = 512, 64, 128
#: The golden-ratio point of slot i is (i * STEP mod PERIOD) / PERIOD, in whole numbers and so alike on every machine.
PERIOD, STEP = 2**31, 1327217885
WEIGHTS = (5, 2, 1)
CELLS = 4096


def source_targets(digest: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, source_rank, target) of each source of ``digest`` (source, size).

    Sources are ranked by code point, null last; ``weights`` repeat over the ranks and split
    ``share`` times all sizes. A target stops at ``repeats`` times its source's size and the rest
    is split anew by weight among the others until none is above: the level is found by sums over
    the table, one row each time, not by looking at sources on the driver.
    """
    sizes = digest.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = number_in_order(sizes, ["_null", "source"], "source_rank", "mix-sources").drop("_null")
    cycle = F.array(*map(F.lit, weights))
    ranked = save(
        ranked.withColumn("weight", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int"))).withColumn(
            "cap", F.col("source_size") * repeats
        ),
        "mix-ranked",
    )
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        all_, at_cap, free, n = ranked.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))
        ).first()
        if not free or n == full:
            break
        level, full = (share * all_ - (at_cap or 0)) / free, n
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))


def block_words(targets: DataFrame) -> int:
    """Words of a block: fewer where a source is small, so that whole blocks come near its target."""
    least = targets.where("target >= 1").agg(F.min("target")).first()[0]
    return BLOCK if least is None else max(LEAST_BLOCK, min(BLOCK, int(least) // BLOCKS))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(source_rank, block, slot): which slot takes which of a source's blocks, 0, 1, 2, ... in slot order.

    Slot i's golden-ratio point falls into one source's stretch of the cumulative targets; slots
    are ranked per source by running sums over chunks of slots, so a hot source is no single task.
    A source with words whose stretch no point meets gets one slot behind all others.
    """
    words = save(targets.select("source_rank", F.floor("target").cast("long").alias("words"), F.floor(F.col("source_rank") / 1024).alias("chunk")), "mix-words")
    total = words.agg(F.sum("words")).first()[0] or 0
    stretches = running_sum(words, "words", [], "chunk", ["source_rank"], "low").where("words > 0").withColumn("high", F.col("low") + F.col("words"))
    cell = lambda x: F.floor(F.col(x) / F.lit(max(total, 1)) * CELLS).cast("int")
    spread = stretches.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high")))).select("source_rank", "low", "high", "cell")
    n = -(-total // block)
    slots = targets.sparkSession.range(n).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", F.floor(F.pmod(F.pmod(F.col("slot"), F.lit(PERIOD)) * STEP, F.lit(PERIOD)) / F.lit(float(PERIOD)) * total).cast("long"))
    dealt = slots.withColumn("cell", cell("point")).join(spread, "cell").where("point >= low and point < high")
    dealt = save(dealt.select("source_rank", "slot", F.floor(F.col("slot") / 65536).alias("chunk"), F.lit(1).cast("long").alias("one")), "mix-slots")
    ranked = running_sum(dealt, "one", ["source_rank"], "chunk", ["slot"], "block").select("source_rank", "block", "slot")
    missed = stretches.join(dealt.select("source_rank").distinct(), "source_rank", "left_anti")
    return ranked.unionByName(missed.select("source_rank", F.lit(0).cast("long").alias("block"), (F.col("source_rank") + n).cast("long").alias("slot")))


def mix(digest: DataFrame, targets: DataFrame, slots: DataFrame, block: int, seed: int = 42) -> DataFrame:
    """The mix as runs of words: columns of ``digest`` with source_size, target, pass, taken, first_slot and last_slot; a row that the mix leaves out comes once, with taken 0.

    ``digest`` is a table with doc_id, source, size and ``row``, a number of each row of its own.
    The documents of a source follow each other in the order of a keyed hash of doc_id, and again
    from the start until the stream is twice as long as the source. It is cut into blocks of equal
    words. ``slots`` (source_rank, block, slot) says which blocks are taken, and when: the first
    blocks of each source, as many as it has slots. Of a document each pass takes ``taken`` words,
    the first at ``first_slot``. A source's last block ends at its target; words beyond the cap of
    the target (the stream's end) don't exist, so no document gives more than twice its size.
    """
    dealt = save(slots, "mix-schedule")
    known = targets.select("source", "source_size", "source_rank", "target", "cap")
    blocks = dealt.groupBy("source_rank").agg(F.count("*").alias("blocks"))
    known = known.join(blocks, "source_rank", "left").withColumn("end", F.least(F.col("cap"), F.coalesce("blocks", F.lit(0)) * F.lit(block), F.floor("target")).cast("long"))
    ranked = digest.join(known.withColumnRenamed("source", "mix_source"), F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    mixed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    # Null ids share a hash and go by size, so their bucket is cut by size, between those of smaller and of larger hashes.
    shared = md5(f":{seed}".encode()).hexdigest()
    inside = F.when(F.col("hash") < shared, 0).when(F.col("hash") == shared, 1 + F.least(F.col("size"), F.lit(CELLS))).otherwise(CELLS + 2)
    ranked = ranked.withColumn("hash", mixed).withColumn("bucket", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int") * (CELLS + 3) + inside)
    placed = running_sum(save(ranked, "mix-ranked-docs"), "size", ["source_rank"], "bucket", ["hash", "doc_id", "size", "row"], "at")
    size = F.greatest("source_size", F.lit(1))
    passes = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("end") / size) - 1))
    rows = placed.withColumn("pass", F.explode(passes)).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size"))
    rows = rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("from") + F.col("size"), F.col("end")) - F.col("from")).cast("long"))
    rows = rows.where("taken > 0 or pass = 0")
    for name, at in (("first_slot", F.col("from")), ("last_slot", F.col("from") + F.col("taken") - 1)):
        own = dealt.select("source_rank", F.col("block").alias("own"), F.col("slot").alias(name))
        # Rows that take nothing have no block; keys of their own spread them.
        rows = rows.withColumn("own", F.when(F.col("taken") > 0, F.floor(at / block)).otherwise(-1 - F.pmod(F.xxhash64("row"), F.lit(2**20))).cast("long")).join(own, ["source_rank", "own"], "left").drop("own")
    return rows.select(*digest.columns, "source_size", "target", "pass", "taken", "first_slot", "last_slot")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and row of every document, as a table: texts are read once."""
    return save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()), "mix-digest")


def scheduled_mix(digest: DataFrame) -> DataFrame:
    """:func:`mix` of ``digest`` by its own targets and the golden-ratio schedule."""
    targets = source_targets(digest)
    block = block_words(targets)
    return mix(digest, targets, schedule(targets, block), block)


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, in the order of its slots: a row for each pass in which at least half of a document's words are taken.

    Documents come whole, at the slot of their first word; only the one at which a source's last
    block ends is rounded to all or none. Documents without words are left out. Columns keep their
    names, whatever they are; no rows give none.
    """
    names, row, slot = docs.columns, unused("mix_row", docs), unused("mix_slot", docs)
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs", "zstd")
    digest = numbered.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col(row).alias("row"))
    taken = scheduled_mix(save(digest, "mix-digest")).where("taken > 0 and 2 * taken >= size")
    mixed = numbered.join(taken.select(F.col("row").alias(row), F.col("first_slot").alias(slot)), row)
    return mixed.repartitionByRange(slot, row).sortWithinPartitions(slot, row).select(*names)


def op3_mix_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each of all documents, and the slot of the first of them (-1: none)."""
    pieces = scheduled_mix(mix_digest(table(spark, sf_dir, "documents")))
    taken = pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.coalesce(F.min("first_slot"), F.lit(-1)).alias("first_slot"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':42') AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), c AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
         1.5 * sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w
), l AS (
  SELECT first((total - capped) / free ORDER BY ratio, source) FILTER ((total - capped) / free <= ratio) AS level FROM c
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * level) AS target FROM w, l
), u AS (
  SELECT *, floor(target)::BIGINT AS words, coalesce(sum(floor(target)::BIGINT) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM t
), b AS (
  SELECT coalesce(greatest({LEAST_BLOCK}, least({BLOCK}, (min(target) FILTER (target >= 1))::BIGINT // {BLOCKS})), {BLOCK}) AS block, sum(words)::BIGINT AS total FROM u
), slots AS (
  SELECT i AS slot, floor(((i % {PERIOD}) * {STEP} % {PERIOD}) / {PERIOD}.0::DOUBLE * total)::BIGINT AS point
  FROM (SELECT unnest(range((total + block - 1) // block)) AS i, total FROM b)
), dealt AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM slots JOIN u ON point >= low AND point < low + words
), n AS (
  SELECT u.source, u.source_size, u.target, least(2 * u.source_size, greatest(count(slot), (u.words > 0)::INT) * any_value(block), u.words)::BIGINT AS ends, count(slot) AS n_slots
  FROM u JOIN b ON true LEFT JOIN dealt ON dealt.source IS NOT DISTINCT FROM u.source GROUP BY u.source, u.source_size, u.target, u.words
), p AS (
  SELECT d.*, n.source_size, n.target, ends,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
), q AS (
  SELECT *, (greatest(0, least(begins + size, ends) - begins) + greatest(0, least(begins + source_size + size, ends) - begins - source_size))::BIGINT AS taken FROM p
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot ELSE -1 END AS first_slot
FROM q JOIN b ON true LEFT JOIN dealt ON dealt.source IS NOT DISTINCT FROM q.source AND k = begins // block
"""
