"""Centroid clustering with float32 screening and exact integers where the screen can't tell (operator 12).

Products of vectors and centroids come from a float32 matrix product. Its rounding error is bounded
for any order of summation, so every centroid gets an interval that its true distance lies in. A
vector whose lowest interval overlaps no other is decided; of the others only the overlapping
centroids are compared again, in exact integers, the smaller number winning ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spool import discard
from .common import save, table
from .topk import quantised

#: Unit roundoff of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53
#: The largest long; distances and sums beyond are returned as it.
LONGEST = 2**63 - 1


def exact_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows to rows, whole numbers of any size: longs, or Python's where they might not do."""
    most = sum(int(max(-int(a.min()), int(a.max()), 0)) if a.size else 0 for a in (x, c))
    if most * most * max(x.shape[-1], 1) >= LONGEST:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=-1)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (rows, centroids) of |c|^2 - 2 x c, which orders centroids as their distance does.

    A float32 dot product of d terms is off by gamma |x| |c| at most, whatever the order of its
    sums; three more roundings cover the operands and a fused product. Where float32 overflows the
    interval is everything.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (x.astype("f4") @ c.astype("f4").T).astype("f8")
        x2, c2 = ((a.astype("f8") ** 2).sum(axis=1) for a in (x, c))
    d = x.shape[1]
    gamma = 1.01 * (d + 3) * U32 if d * U32 < 0.01 else np.inf
    slack = 8 * (d + 4) * U64  # of the float64 sums, norms and differences
    error = 2 * gamma * np.sqrt(x2)[:, None] * np.sqrt(c2)[None, :] * (1 + slack) + slack * (c2[None, :] + 2 * np.abs(dots))
    score = c2[None, :] - 2 * dots
    sure = np.isfinite(score) & np.isfinite(error)
    return np.where(sure, score - error, -np.inf), np.where(sure, score + error, np.inf)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest of the centroids ``c`` for each of the rows ``x`` (whole numbers), ties to the smaller number, and how many rows needed exact integers."""
    low, high = intervals(x, c)
    short = low <= high.min(axis=1, keepdims=True)
    out = short.argmax(axis=1)
    open_ = np.flatnonzero(short.sum(axis=1) > 1)
    if len(open_):
        i, j = np.nonzero(short[open_])
        exact = exact_squares(x[open_[i]], c[j])
        order = np.lexsort((j, exact, i)) if exact.dtype != object else np.array(sorted(range(len(i)), key=lambda k: (i[k], exact[k], j[k])))
        first = np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])
        out[open_] = j[order][first]
    return out, len(open_)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(vectors: DataFrame, c: np.ndarray) -> list:
    """(cluster, place, total) rows: exact sums of the components of each cluster's vectors; place ``dim`` has their number."""
    dim = c.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of high and low halves are longs for over 2^31 vectors of a task.
        high, low = (np.zeros((len(c), dim + 1), "i8") for _ in range(2))
        for batch in batches:
            x = _rows(batch.column(0), dim)
            if len(x):
                cluster, _ = nearest(x, c)
                order = np.argsort(cluster, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
                wide = np.c_[x[order], np.ones(len(x), "i8")]
                high[cluster[order][at]] += np.add.reduceat(wide >> 32, at)
                low[cluster[order][at]] += np.add.reduceat(wide & 0xFFFFFFFF, at)
        some = np.flatnonzero(high[:, dim] | low[:, dim])
        place = np.tile(np.arange(dim + 1, dtype="i4"), len(some))
        columns = [pa.array(np.repeat(some, dim + 1).astype("i4")), pa.array(place), pa.array(high[some].ravel()), pa.array(low[some].ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "high", "low"])

    parts = vectors.select("q").mapInArrow(work, "cluster int, place int, high long, low long")
    total = lambda name: F.sum(F.col(name).cast("decimal(20,0)"))
    return parts.groupBy("cluster", "place").agg((total("high") * F.lit(2**32).cast("decimal(10,0)") + total("low")).cast("decimal(38,0)").alias("total")).collect()


def moved(c: np.ndarray, sums: list) -> np.ndarray:
    """Centroids replaced by the componentwise floor of their vectors' mean; those without vectors stay."""
    dim, out = c.shape[1], c.copy()
    totals = {(r.cluster, r.place): int(r.total) for r in sums}
    for j in range(len(c)):
        if n := totals.get((j, dim)):
            out[j] = [totals[j, k] // n for k in range(dim)]
    return out


def fit_centroids(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centroids (k, dim) after ``rounds`` of Lloyd's algorithm over all of ``vectors`` (vec_id, q: whole numbers, all of one dimension), a table.

    They start as the vectors whose ids have the smallest hashes; fewer vectors give fewer. The driver holds centroids only.
    """
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(start.asc_nulls_last(), "q").limit(k).select("q").collect()
    c = np.array([r.q for r in first], "i8")
    for _ in range(rounds if len(first) else 0):
        c = moved(c, _sums(vectors, c))
    return c


def assign(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, ``cluster`` and ``distance`` (squared, exact) of every row of ``vectors`` (vec_id, q) to the nearest of ``c``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), c.shape[1])
            cluster = nearest(x, c)[0] if len(x) else np.zeros(0, "i8")
            distance = np.minimum(exact_squares(x, c[cluster]), LONGEST).astype("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype("i4")), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "q").mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of ``vectors`` (vec_id, embedding) that takes part.

    Vectors take part if they have ``dim`` components, none null or not finite; the others have no
    row. Components are floor(scale * x), at most a long. Each row is a vector of its own, repeated
    and null ids too (a null id starts no centroid while others are left). Equal distances go to
    the smaller number. Sums beyond a long are the largest long. No vectors give no rows.
    """
    kept = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("q")).where(F.size("q") == dim)
    kept = save(kept, "centroid-vectors")
    c = fit_centroids(kept, k, rounds)
    if not len(c):
        discard(kept)
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    done = save(assign(kept, c), "centroid-rows")
    discard(kept)
    sums = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    capped = lambda n: min(n, LONGEST)
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    info = [(j, capped(n), capped(sum(sums.values())), digest(c[j])) for j, n in sums.items()]
    about = vectors.sparkSession.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int) -> str:
    """CTEs of the rounds: a<i> assigns to the centroids c<i>, c<i+1> are the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT vec_id, arg_min(cluster, distance * 16 + cluster) AS cluster, min(distance) AS distance FROM (
    SELECT vec_id, cluster, list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT AS distance FROM e, c{i}) GROUP BY vec_id
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN e USING (vec_id), range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster)
)""")
    return ", ".join(steps)


OP12_SQL = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, q AS c FROM e QUALIFY cluster < 16
), {_rounds(3)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""
