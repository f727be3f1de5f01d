"""Near-duplicate vectors by sorted projection passes (operator 7)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spool import discard, sweep
from .common import join_counted, number_in_order, save, table
from .components import connected_components
from .simhash import _spanning

#: Sign hashes that make up a sort key, neighbours compared on either side, rows of a block, rows of comparisons done in one group.
BITS, WINDOW, BLOCK, TOGETHER = 48, 64, 2048, 20_000
#: Vectors sent to windows at once: passes of a round follow each other in steps of so many, one pass at least, and free their disk between.
AT_ONCE = 1 << 22
#: Chance with which a pair just at the threshold should meet in some pass.
RECALL = 0.98


def passes_for(n: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes of one round, which find a pair just at the threshold with this chance: a sort key tells rows apart by about log2(n / window) bits, in all of which the pair must agree. Holds for evenly spread vectors; whether it was enough is measured."""
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(n, 2) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _unit(values: list | None) -> np.ndarray | None:
    """The vector over its length in doubles; None where it has none or isn't finite."""
    if not values or None in values:
        return None
    x = np.array(values, "f8")
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most
    return x / np.sqrt(x @ x)


def _units(embeddings: np.ndarray) -> np.ndarray:
    """Vectors of one dimension, which all take part, over their lengths in doubles."""
    x = np.stack(embeddings).astype("f8")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each dimension of a column of vectors that take part, its places and unit vectors."""
    vectors, dims = column.to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _units(vectors[at])


@lru_cache(maxsize=8)
def _planes(seed: int, dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((passes * BITS, dim))


def _directions(vectors: DataFrame) -> DataFrame:
    """row, vec_id, dim and sign (equal for equal directions) of ``vectors`` (row, vec_id, embedding); dim null where a vector takes no part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(value.as_py()) for value in batch.column(2)]
            dims = [None if x is None else len(x) for x in units]
            signs = [None if x is None else hashlib.sha256((x + 0.0).tobytes()).digest() for x in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(signs, pa.binary())], names=["row", "vec_id", "dim", "sign"])

    return vectors.select("row", "vec_id", "embedding").mapInArrow(rows, "row long, vec_id long, dim int, sign binary")


def _means(values: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all unit vectors of each dimension; a task sends one sum a dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch.column(0)):
                own = total.setdefault(dim, [0, np.zeros(dim)])
                own[0] += len(x)
                own[1] += x.sum(axis=0)
        counts, vectors = [n for n, _ in total.values()], [x.tolist() for _, x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["n", "x"])

    found: dict[int, list] = {}
    for r in values.select("embedding").mapInArrow(sums, "n long, x array<double>").collect():
        own = found.setdefault(len(r.x), [0, 0.0])
        own[0] += r.n
        own[1] = own[1] + np.array(r.x)
    return {dim: x / n for dim, (n, x) in found.items()}


def _keyed(values: DataFrame, turns: range, passes: int, seed: int, means: dict[int, np.ndarray]) -> DataFrame:
    """first, dim and the sort keys of the passes ``turns`` of ``values`` (first, embedding): the sides of planes through the mean."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype="i8")
        for batch in batches:
            dims, keys = np.zeros(batch.num_rows, "i4"), np.zeros((batch.num_rows, len(turns)), "i8")
            for dim, at, x in _by_dim(batch.column(1)):
                dims[at] = dim
                planes = _planes(seed, dim, passes)[turns.start * BITS : turns.stop * BITS]
                keys[at] = ((x - means[dim]) @ planes.T > 0).reshape(-1, len(turns), BITS) @ powers
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(turns), dtype="i4")), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), lists], names=["first", "dim", "keys"])

    return values.select("first", "embedding").mapInArrow(rows, "first long, dim int, keys array<long>")


def _shared(keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading bits that each of the sorted keys shares with the ones ``window`` places before and after; -1 where there is none."""
    before, after = np.full(len(keys), -1), np.full(len(keys), -1)
    if len(keys) > window:
        shared = BITS - np.frexp((keys[window:] ^ keys[:-window]).astype("f8"))[1]
        before[window:], after[:-window] = shared, shared
    return before, after


def _chance(x: np.ndarray, keys: np.ndarray, before: np.ndarray, after: np.ndarray, planes: np.ndarray, mean: np.ndarray, threshold: float) -> np.ndarray:
    """Chance of each row that a vector just at the threshold from it, in any direction, lies inside its window.

    Such a vector leaves the window on the side to which the first bit that differs takes it, if
    the row at that edge shares more bits; where it shares as many, half of them do. The vector's
    place along a plane's normal is about normally distributed.
    """
    bit = (keys[:, None] >> np.arange(BITS - 1, -1, -1)) & 1 == 1
    at, long = x @ planes.T, (planes**2).sum(axis=1)
    spread = np.sqrt(np.maximum((1 - threshold**2) * (long - at**2) / max(x.shape[1] - 1, 1), 1e-24))
    z = np.clip(np.where(bit, 1, -1) * (threshold * at - planes @ mean) / spread, -8, 8)
    agree = 1 / (1 + np.exp(-1.5976 * z - 0.07056 * z**3))
    so_far = np.cumprod(agree, axis=1)
    differs = np.hstack([np.ones((len(x), 1)), so_far[:, :-1]]) * (1 - agree)
    edge, j = np.where(bit, before[:, None], after[:, None]), np.arange(BITS)
    lost = (differs * ((j < edge) + 0.5 * (j == edge))).sum(axis=1) + so_far[:, -1] * ((before == BITS) | (after == BITS))
    return np.clip(1 - lost, 0, 1 - 1e-12)


def _round(values: DataFrame, threshold: float, window: int, block: int, seed: int, at_once: int) -> list[DataFrame]:
    """One round of passes over ``values`` (first, embedding), as the tables of its steps: links (u, v), and rows with v null and, as ``missed``, the log of the chance that a pass missed a link of u just at the threshold.

    A step has as many passes as send ``at_once`` vectors, or one; what it shuffled and sorted is freed
    before the next, so disk grows with the vectors and not with the passes.
    """
    n = values.count()
    passes, means, found = passes_for(n, threshold, window), _means(values), []
    step = max(1, at_once // max(n, 1))
    for at in range(0, passes, step):
        found.append(_step(values, range(at, min(at + step, passes)), passes, means, threshold, window, block, seed))
        if step < passes:
            sweep(values.sparkSession)
    return found


def _step(values: DataFrame, turns: range, passes: int, means: dict[int, np.ndarray], threshold: float, window: int, block: int, seed: int) -> DataFrame:
    """The passes ``turns`` of a round's ``passes``, as a table."""
    keyed = _keyed(values, turns, passes, seed, means).select("first", "dim", F.posexplode("keys").alias("turn", "key"))
    keyed = keyed.select("first", "dim", (F.col("turn") + turns.start).alias("pass"), "key")
    sorted_ = number_in_order(keyed, ["dim", "pass", "key", "first"], "place", "vector-order")
    home, inside = F.floor(F.col("place") / block), F.col("place") % block
    # The rows of both neighbouring blocks that windows reach.
    blocks = F.array_compact(F.array(home, F.when(inside >= block - window, home + 1), F.when((inside < window) & (home > 0), home - 1)))
    windows = sorted_.select("first", "dim", "pass", "key", "place", F.explode(blocks).alias("block")).join(values, "first")

    # Of the rows from a window's start on, those up to ``window`` places after each.
    band = np.tril(np.triu(np.ones((window, 2 * window), bool), 1), window)

    def neighbours(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", ignore_index=True)
        own = (part["place"] // block == key[0]).to_numpy()
        ids, keys, us, vs, seen, missed = part["first"].to_numpy("i8"), part["key"].to_numpy("i8"), [], [], [], []
        for (dim, turn), at in part.groupby(["dim", "pass"]).indices.items():
            x, mine = _units(part["embedding"].to_numpy()[at]), own[at]
            for s in range(0, len(at), window):
                ahead = x[s : s + 2 * window]
                hit = (x[s : s + window] @ ahead.T >= threshold) & mine[s : s + 2 * window]
                i, j = np.nonzero(hit & band[: len(hit), : len(ahead)])
                us.append(ids[at[s + i]])
                vs.append(ids[at[s + j]])
            before, after = _shared(keys[at], window)
            planes = _planes(seed, int(dim), passes)[turn * BITS : (turn + 1) * BITS]
            chance = _chance(x[mine], keys[at[mine]], before[mine], after[mine], planes, means[int(dim)], threshold)
            seen.append(ids[at[mine]])
            missed.append(np.log1p(-chance))
        u, v = (np.concatenate(c) if c else np.zeros(0, "i8") for c in (us, vs))
        # A forest with the same components is enough here.
        names, places = np.unique(np.concatenate([u, v]), return_inverse=True)
        order = np.argsort(places[: len(u)], kind="stable")
        left, right = places[: len(u)][order], places[len(u) :][order]
        starts = np.flatnonzero(np.diff(left, prepend=-1))
        tree = _spanning(zip(left[starts].tolist(), np.split(right, starts[1:]), strict=True) if len(u) else iter(()), len(names))
        links = pd.DataFrame({"u": names[[i for i, _ in tree]], "v": names[[j for _, j in tree]]}, dtype="Int64").assign(missed=0.0)
        chances = pd.DataFrame({"u": pd.array(np.concatenate(seen), "Int64"), "v": pd.array([None] * sum(map(len, seen)), "Int64"), "missed": np.concatenate(missed)})
        return pd.concat([links, chances], ignore_index=True)

    return save(windows.groupBy("block").applyInPandas(neighbours, "u long, v long, missed double"), "vector-found")


def link_components(vectors: DataFrame, threshold: float = 0.95, window: int = WINDOW, block: int = BLOCK, seed: int = 42, at_once: int = AT_ONCE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Vectors of equal direction are one class from the start. Each pass sorts the classes by
    concatenated signs of random projections less their mean and compares each with its next
    ``window`` neighbours, block by block with the last rows of the block before; ``at_once`` vectors
    are sent at a time (one pass at least), which changes no result. For every class
    the chance is measured, from the bits it shares with the rows at its window's edges, that a
    link just at the threshold was met in no pass; classes where it is above 1 - RECALL go through
    another round, with planes through the mean of those left, until there are none or a round
    joins no more. The links found by all passes are united into components; then, since a dense group may be wider than a window,
    every two classes of a component are compared exactly, two blocks at a time, and counted. So
    links are missed only between components that no pass joined. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, and nor do vectors of
    different dimensions. Rows are told apart by numbers of their own, so those that repeat a
    vec_id, or have a null one, count as vectors of their own. A null vec_id is never a component's
    smallest while there are others; a component of nulls alone has a null component_id, and all
    its rows are kept. Other columns are left behind; an empty table gives no rows.
    """
    dealt = save(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding"), "vector-rows")
    rows = save(_directions(dealt), "vector-directions")
    by_class = rows.where("dim is not null").groupBy("dim", "sign").agg(F.min("row").alias("first"), F.min("vec_id").alias("smallest"), F.count("*").alias("copies"))
    classes = save(by_class, "vector-classes")
    values = save(dealt.join(classes.select(F.col("first").alias("row")), "row", "left_semi").select(F.col("row").alias("first"), "embedding"), "vector-values")
    discard(dealt)

    live, edges, joined, turn = values, None, 0, 0
    while True:
        steps = _round(live, threshold, window, block, seed + turn, at_once)
        found = reduce(DataFrame.union, steps)
        more = found.where("v is not null").select("u", "v")
        edges = save((more if edges is None else edges.union(more)).distinct(), "vector-edges")
        parts = save(connected_components(edges), "vector-components")
        missed = found.where("v is null").groupBy(F.col("u").alias("first")).agg(F.sum("missed").alias("missed")).where(F.col("missed") > math.log(1 - RECALL))
        past, live = live, save(live.join(missed, "first", "left_semi"), "vector-live")
        discard(*steps, *([past] if turn else []))
        before, joined = joined, parts.where("node != component").count()
        if (turn and joined == before) or not live.limit(1).count():
            break
        turn += 1
    parts = parts.withColumnRenamed("node", "first")
    sized = parts.groupBy("component").agg(F.count("*").alias("n"))
    members = parts.join(sized, "component").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = members.join(classes.select("first", "copies"), "first").withColumn("b", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
    groups = 1 + (members.agg(F.sum("blocks")).first()[0] or 0) // TOGETHER
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    pairs = members.withColumn("pair", F.explode(others)).select("component", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "b", "first", "copies")
    pairs = pairs.join(values, "first").withColumn("spread", F.pmod(F.xxhash64("component", "i", "j"), F.lit(groups)))

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), at in part.groupby(["component", "i", "j"]).indices.items():
            own = part.iloc[at]
            x, copies, side = _units(own["embedding"].to_numpy()), own["copies"].to_numpy("i8"), own["b"].to_numpy()
            link = x @ x.T >= threshold
            np.fill_diagonal(link, False)
            if i != j:
                link &= side[:, None] != side[None, :]
            out.append(pd.DataFrame({"first": own["first"].to_numpy("i8"), "links": link @ copies}))
        return pd.concat(out)

    links = pairs.groupBy("spread").applyInPandas(counted, "first long, links long").groupBy("first").agg(F.sum("links").alias("links"))
    smallest = parts.join(classes.select("first", "smallest"), "first").groupBy("component").agg(F.min("smallest").alias("least"))
    info = classes.join(links, "first", "left").join(parts.join(smallest, "component"), "first", "left")
    least = F.when(F.col("component").isNull(), F.col("smallest")).otherwise(F.col("least"))
    info = info.select("dim", "sign", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), least.alias("component_id"), F.lit(True).alias("there"))
    out = join_counted(rows.select("vec_id", "dim", "sign"), save(info, "vector-info"), ["dim", "sign"], "copies")
    component = F.when(F.col("there"), F.col("component_id")).otherwise(F.col("vec_id"))
    kept = component.isNull() | F.coalesce(component == F.col("vec_id"), F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op7_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all vectors, whatever their labels."""
    return link_components(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.v FROM reach JOIN links ON links.u = reach.other
)
SELECT vec_id, coalesce((SELECT count(*) FROM links WHERE links.u = reach.vec_id), 0)::BIGINT AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
"""
