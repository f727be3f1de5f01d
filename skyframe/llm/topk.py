"""Exact top-k search by inner product with KD-trees per shard (operator 1)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

#: Vectors of a shard and of a tree's leaf; queries of a block. A task holds one shard and one block of queries.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 16384, 256, 4096
#: Rows, those of the smallest hashes, from which regions of space are cut, and regions at most: their boxes are what tasks hold.
SAMPLE_ROWS, REGIONS = 20_000, 4096


BOX = pa.schema([("dim", pa.int32()), ("region", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])


class KDTree:
    """Median splits of the widest dimension; every node has the tight box of its rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.low, self.high, self.span, self.children = [], [], [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = self.order[start:end]
            low, high = rows[own].min(axis=0), rows[own].max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            if end - start > leaf and len(low) and (high > low).any():
                middle = (end - start) // 2
                widest = int(np.argmax(high.astype("f8") - low.astype("f8")))
                self.order[start:end] = own[np.argpartition(rows[own, widest], middle)]
                todo += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that any vector of each node's box could have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the fastest type in which all their inner products are exact: doubles, longs or Python's integers."""
    most = 1
    for a in arrays:
        most *= max(1, int(np.abs(a.astype("f8")).max(initial=0)))
    most *= max(1, arrays[0].shape[1])
    return [a.astype("f8" if most < 2**52 else "i8" if most < 2**62 else object) for a in arrays]


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query place, row place, score): what of ``rows`` may be among the ``k`` best of each query, ties to smaller ids.

    ``least`` is a score that the query's k-th best reaches at any rate. Every query visits the
    leaves of the KD-tree in the order of their boxes' bounds and stops where the bound is below
    the better of it and its k-th score so far; equal ones are visited. Queries that are at the
    same leaf at the same time are answered together.
    """
    if not len(rows) or not len(queries):
        return []
    rows, queries = _numbers(rows, queries)
    tree, n = KDTree(rows), len(rows)
    most = float(np.abs(rows.astype("f8")).max(initial=0) * np.abs(queries.astype("f8")).max(initial=0)) * max(1, rows.shape[1])
    if rows.dtype != np.float64 or most * n >= 2**62:
        return _search_large(tree, ids, rows, query_ids, queries, least, k)
    # A score and the place among the ids, smaller first, are one whole number.
    by_id = np.argsort(ids, kind="stable")
    behind = np.empty(n, "i8")
    behind[by_id] = n - 1 - np.arange(n)
    none = -(2**62)
    leaves = [i for i, (left, _) in enumerate(tree.children) if left < 0]
    spans = [tree.order[slice(*tree.span[i])] for i in leaves]
    out: list[tuple[int, int, int]] = []
    for start in range(0, len(queries), 2048):
        asked, own_ids, floor = queries[start : start + 2048], query_ids[start : start + 2048], np.maximum(least[start : start + 2048], -(2.0**52))
        bounds = tree.bounds(asked)[:, leaves]
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth, best = floor.copy(), np.full((len(asked), k), none)
        live = np.arange(len(asked))
        for turn in range(len(leaves)):
            leaf = order[live, turn]
            more = bounds[live, leaf] >= kth[live]
            live, leaf = live[more], leaf[more]
            if not len(live):
                break
            grouped = np.argsort(leaf, kind="stable")
            for part in np.split(grouped, np.flatnonzero(np.diff(leaf[grouped])) + 1):
                at, own = live[part], spans[leaf[part[0]]]
                ranked = (asked[at] @ rows[own].T).astype("i8") * n + behind[own]
                ranked[own_ids[at][:, None] == ids[own][None, :]] = none
                both = np.concatenate([best[at], ranked], axis=1)
                best[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kth[live] = np.maximum(kth[live], np.where(best[live].min(axis=1) > none, best[live].min(axis=1) // n, floor[live]))
        q, place = np.nonzero((best > none) & (best // n >= floor[:, None]))
        found = best[q, place]
        out += zip((start + q).tolist(), by_id[n - 1 - found % n].tolist(), (found // n).tolist(), strict=True)
    return out


def _search_large(tree: KDTree, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """:func:`search` for numbers whose inner products no double holds, query by query."""
    out: list[tuple[int, int, int]] = []
    for start in range(0, len(queries), 1024):
        bounds = tree.bounds(queries[start : start + 1024])
        for q, bound in enumerate(bounds, start):
            kth, heap = least[q], [(-bound[0], 0)]
            best_s, best_i = rows[:0, 0] if rows.shape[1] else np.zeros(0), np.zeros(0, "i8")
            while heap and -heap[0][0] >= kth:
                node = heapq.heappop(heap)[1]
                left, right = tree.children[node]
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                own = tree.order[slice(*tree.span[node])]
                scores = rows[own] @ queries[q] if rows.shape[1] else np.zeros(len(own))
                hit = (scores >= kth) & (ids[own] != query_ids[q])
                if not hit.any():
                    continue
                best_s, best_i = np.concatenate([best_s, scores[hit]]), np.concatenate([best_i, own[hit]])
                if len(best_s) > k:
                    top = np.lexsort((ids[best_i], -best_s))[:k]
                    best_s, best_i = best_s[top], best_i[top]
                if len(best_s) == k:
                    kth = max(kth, best_s.min())
            out += [(q, int(i), min(max(int(s), -(2**63)), 2**63 - 1)) for s, i in zip(best_s.tolist(), best_i.tolist(), strict=True)]
    return out


def _searched(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, query_ids = rows["vec_id"].to_numpy("i8"), queries["query_id"].to_numpy("i8")
    dim = int(key[0])
    data = np.array(rows["q"].tolist(), "i8").reshape(len(rows), dim)
    asked = np.array(queries["q"].tolist(), "i8").reshape(len(queries), dim)
    least = queries["least"].to_numpy("f8", na_value=-np.inf)
    found = search(ids, data, query_ids, asked, least, k)
    return pd.DataFrame(
        {"query_id": query_ids[[x[0] for x in found]], "vec_id": ids[[x[1] for x in found]], "score": np.array([x[2] for x in found], "i8")}
    )


def cut_space(sample: np.ndarray, regions: int) -> list[tuple[int, float]]:
    """Splits (component, value) of a complete KD-tree over ``sample``, level by level; rows above a value go right. ``regions`` is a power of 2."""
    parts, splits = [sample], []
    while len(parts) < regions:
        halves = []
        for rows in parts:
            widest = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) and rows.shape[1] else 0
            value = float(np.median(rows[:, widest])) if len(rows) and rows.shape[1] else 0.0
            splits.append((widest, value))
            right = rows[:, widest] > value if rows.shape[1] else np.zeros(len(rows), bool)
            halves += [rows[~right], rows[right]]
        parts = halves
    return splits


def regions_of(rows: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """Region of each row: all rows go down the splits a level at a time."""
    node = np.zeros(len(rows), "i8")
    if splits and len(rows):
        component, value = np.array([c for c, _ in splits]), np.array([v for _, v in splits])
        for _ in range((len(splits) + 1).bit_length() - 1):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), component[node]] > value[node])
    return node - len(splits)


def _lists(column: pa.ListArray, dims: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the lists of one dimension in an Arrow column without nulls."""
    at = np.flatnonzero(dims == dim)
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return at, flat[offsets[at][:, None] + np.arange(dim)]


def exact_topk(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query among all other rows.

    ``vectors`` has vec_id and ``q``, whole numbers. A bounded sample cuts space into regions by
    median splits; every row goes to its region, and a region of more than ``shard_rows`` is dealt
    to several shards by a hash of vec_id, so equal vectors in any number are no hot shard. Each
    shard's task builds its own KD-tree and answers a block of queries. Queries first search their
    own shard; the k-th score found there goes with them and first meets the tight boxes of the
    regions: only shards whose bound reaches it are asked at all, and rows are sent only to blocks
    that ask. Ties go to smaller ids. Queries meet rows of their own dimension only. Rows with a
    null id or vector take no part, repeated rows count once, a query's own id is no candidate, and
    other columns are left behind. No queries or no candidates give no rows.
    """
    spark = vectors.sparkSession
    base = vectors.where("vec_id is not null and q is not null").select(F.col("vec_id").cast("long"), F.col("q").cast("array<bigint>"), is_query.alias("asks"))
    base = save(base.withColumn("dim", F.size("q")).dropDuplicates(["vec_id", "q"]), "topk-vectors")
    sample: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE_ROWS).select("dim", "q").collect():
        sample.setdefault(r.dim, []).append(r.q)
    total = base.count()
    some = sum(map(len, sample.values()))
    splits = {}
    for dim, rows in sample.items():
        wanted = min(REGIONS, total * len(rows) / max(some, 1) / shard_rows)
        splits[dim] = cut_space(np.array(rows, "f8").reshape(len(rows), dim), 1 << max(0, math.ceil(math.log2(max(wanted, 1)))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, region = batch.column(3).to_numpy(), np.zeros(batch.num_rows, "i4")
            for dim in np.unique(dims).tolist():
                at, rows = _lists(batch.column(1), dims, dim)
                region[at] = regions_of(rows, splits.get(dim, []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=["vec_id", "q", "asks", "dim", "region"])

    base = save(base.mapInArrow(placed, "vec_id long, q array<long>, asks boolean, dim int, region int"), "topk-placed")

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[tuple, list] = {}
        for batch in batches:
            dims, regions = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at, rows = _lists(batch.column(0), dims, dim)
                for region in np.unique(regions[at]).tolist():
                    own = rows[regions[at] == region]
                    box = boxes.setdefault((dim, region), [0, own[0], own[0]])
                    box[:] = box[0] + len(own), np.minimum(box[1], own.min(axis=0)), np.maximum(box[2], own.max(axis=0))
        for (dim, region), (n, low, high) in boxes.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "region": region, "n": n, "low": low.tolist(), "high": high.tolist()}], BOX)

    def joined(key: tuple, boxes: pd.DataFrame) -> pd.DataFrame:
        low, high = np.min(np.stack(boxes["low"].tolist()), axis=0), np.max(np.stack(boxes["high"].tolist()), axis=0)
        return pd.DataFrame([{"dim": key[0], "region": key[1], "n": boxes["n"].sum(), "low": low, "high": high}])

    # One row for each region, of which there are REGIONS a dimension at most.
    schema = "dim int, region int, n long, low array<long>, high array<long>"
    boxes: dict[int, list] = {}
    for r in base.select("q", "dim", "region").mapInArrow(boxed, schema).groupBy("dim", "region").applyInPandas(joined, schema).collect():
        boxes.setdefault(r.dim, []).append((r.region, -(-r.n // shard_rows), r.low, r.high))
    shards = spark.createDataFrame([(dim, region, n) for dim, own in boxes.items() for region, n, _, _ in own], "dim int, region int, shards int")
    salted = base.join(F.broadcast(shards), ["dim", "region"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    rows = salted.select("vec_id", "q", "dim", "region", "salt")
    queries = salted.where("asks").select(F.col("vec_id").alias("query_id"), "q", "dim", "region", "salt")
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
    keys = ["dim", "region", "salt", "block"]

    def asked(of: DataFrame) -> DataFrame:
        needed = of.select(*keys).distinct()
        sent = rows.join(needed, ["dim", "region", "salt"])
        sent = sent.select(*[F.col(c).alias(c) for c in ("vec_id", "q", *keys)])  # the two sides share no columns
        return sent.groupBy(*keys).cogroup(of.groupBy(*keys)).applyInPandas(
            lambda key, left, right: _searched(key, left, right, k), "query_id long, vec_id long, score long"
        )

    def best(of: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return of.withColumn("rank", place).where(F.col("rank") <= k)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, least = batch.column(2).to_numpy(), batch.column(6).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at, asked = _lists(batch.column(1), dims, dim)
                asked = asked.astype("f8")
                home, salt = batch.column(3).to_numpy()[at], batch.column(4).to_numpy()[at]
                for region, shards, low, high in boxes.get(dim, []):
                    bound = np.maximum(asked, 0) @ np.array(high, "f8") + np.minimum(asked, 0) @ np.array(low, "f8")
                    # Bounds in doubles may be a rounding short.
                    hit = ~(bound + 1e-9 * np.abs(bound) + 1 < least[at])
                    for s in range(shards):
                        own = np.flatnonzero(hit & ((home != region) | (salt != s)))
                        if len(own):
                            part = batch.take(pa.array(at[own]))
                            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(own), region, "i4")), pa.array(np.full(len(own), s, "i4")), part.column(5), part.column(6)], names=part.schema.names)

    first = save(asked(queries.withColumn("least", F.lit(None).cast("double"))), "topk-home")
    known = best(first).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    away = queries.join(known, "query_id", "left").select("query_id", "q", "dim", "region", "salt", "block", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    away = save(away.mapInArrow(reached, "query_id long, q array<long>, dim int, region int, salt int, block int, least double"), "topk-away")
    return best(first.union(asked(away))).select("query_id", "rank", "vec_id", "score")


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    value = embedding.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(value, lambda x: F.floor(x * scale).cast("long")))


def op1_topk_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every vector whose id is divisible by 20 among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("q"))
    return exact_topk(vectors, F.col("vec_id") % 20 == 0, 20)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
