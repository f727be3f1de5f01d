"""SimHash near-duplicates found by covering locality-sensitive hashing (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, save, table, with_row_numbers
from .components import connected_components

RADIUS = 4
#: Fingerprints of a block; blocks of one bucket are compared two at a time, each pair in a group of its own.
BLOCK = 2048
#: Rows of bucket comparisons that are done in one group, about.
TOGETHER = 2_000


def fingerprint(text: bytes | None, n: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if over half of its word n-grams' XXH64 (seed 42) have it; no words give 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < n:
        return xxh64_intdigest(b" ".join(words), 42)
    count, ones = len(words) - n + 1, np.zeros(64, "i8")
    for at in range(0, count, 1 << 16):  # bounded memory whatever the length
        part = words[at : min(at + (1 << 16), count) + n - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(n)), strict=False))
        hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's 64 bits as a signed long) of every row of ``docs`` (doc_id, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 masks of 64 bits such that any ``radius`` bits lie outside of at least one of them.

    Each bit gets a vector over GF(2) of radius + 1 places (all nonzero vectors about equally
    often, in a shuffled order); mask v holds the bits whose vector has an odd product with v.
    ``radius`` vectors span no more than ``radius`` dimensions, so a nonzero v is orthogonal to all.
    """
    top = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation([1 + k % (top - 1) for k in range(64)]).tolist()
    return [sum(1 << bit for bit, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each place of ``left`` the places of ``right`` within the radius."""
    for i, x in enumerate(left):
        hit = np.flatnonzero(np.bitwise_count(right ^ x) <= radius)
        if len(hit):
            yield i, hit


def _spanning(pairs: Iterator[tuple[int, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Of the pairs given, those that join two trees so far: at most n - 1 with the same components."""
    tree, out = np.arange(n), []
    for i, others in pairs:
        trees = tree[others]
        for other in np.unique(trees[trees != tree[i]]).tolist():
            out.append((i, int(others[trees == other][0])))
            tree[tree == other] = tree[i]
    return out


def near_pairs(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of different fingerprints that hold together every class of the link "at most ``radius`` bits differ".

    ``fps`` has one distinct long column fp. Every linking pair shares the key of at least one
    table; buckets of one fingerprint are left out by a summed count; larger ones are dealt to
    blocks by a hash, and all pairs of blocks are compared, each in a group of at most about two
    blocks. A comparison reports a spanning forest of its links, never all of them.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    tables = F.explode(F.arrays_zip(F.array(*map(F.lit, range(len(masks)))).alias("t"), F.array(*map(F.lit, masks)).alias("m")))
    keyed = fps.select("fp", tables.alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Both sides grow with the fingerprints, so neither is broadcast.
    members = save(keyed.hint("merge").join(shared, ["t", "key"]), "simhash-buckets")
    # Fingerprints alone with one other in their bucket, as in most buckets, need no Python.
    two = members.where("n = 2").groupBy("t", "key").agg(F.min("fp").alias("u"), F.max("fp").alias("v"))
    two = two.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = members.where("n > 2").withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    placed = dealt.withColumn("pair", F.explode(others)).select("t", "key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "b", "fp")
    # Many comparisons share a group, as most are of a few rows.
    groups = 1 + dealt.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0] // TOGETHER
    spread = F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(groups))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for (_, _, i, j), part in rows.groupby(["t", "key", "i", "j"], sort=False):
            part = np.sort(part[["fp", "b"]].to_records(index=False), order="fp")
            fp = np.ascontiguousarray(part["fp"])
            x = fp.view("u8")
            if i == j:
                found = _spanning(_near(x, x, radius), len(x))
            else:
                a, b = np.flatnonzero(part["b"] == i), np.flatnonzero(part["b"] == j)
                found = _spanning(((int(a[k]), b[hit]) for k, hit in _near(x[a], x[b], radius)), len(x))
            us += [fp[k] for k, _ in found]
            vs += [fp[k] for _, k in found]
        return pd.DataFrame({"u": np.array(us, "i8"), "v": np.array(vs, "i8")})

    more = placed.withColumn("spread", spread).groupBy("spread").applyInPandas(compare, "u long, v long")
    return two.union(more).distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that can be reached over links of at most ``radius``
    differing bits, the row's own included. Null texts count as empty; texts without words have
    fingerprint zero and are linked like any other. Rows that repeat a doc_id link through their
    own texts. A null doc_id is never the smallest while others are in reach; a component of
    nulls alone has a null component_id.
    """
    prints = save(fingerprints(docs), "simhash-prints")
    firsts = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    parts = connected_components(near_pairs(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = firsts.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return join_counted(prints, save(named.join(smallest, "component").select("fp", "copies", "component_id"), "simhash-named"), ["fp"], "copies")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with exactly one row of each component: one of the smallest doc_id, a null one only where there are no others.

    Rows are linked by their numbers, so those that share a doc_id are judged by their own texts.
    """
    numbered, row = with_row_numbers(docs, "simhash-docs")
    parts = simhash_components(numbered.select(F.col(row).alias("doc_id"), "text"), radius).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = parts.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
