"""Vector code compression: product codebooks trained by heap Lloyd (operator 13).

Vectors are cut into parts, each with a codebook of its own. Blocks of vectors keep, for every part
position and entry, a heap of the parts assigned there, keyed by slack: a lower bound of the
distance to any other entry less an upper bound of the distance to its own. When entries move, a
part's slack shrinks at most by how far its own entry and the farthest other one moved. Those
movements add up by entry; a part is popped, and compared with all entries exactly, only when its
key is no longer above its entry's sum. Keys are stored with the sum at the time added, so that the
parts that stay are never touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import unused
from ..spool import discard
from .centroids import LONGEST, exact_squares
from .common import join_counted, save, table
from .topk import quantised

#: Vectors of a block; its heaps are one row of the state.
BLOCK = 8192
#: Relative rounding of bounds and movements, far above that of a square root and a sum in float64.
SLACK = 2.0**-48


def all_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows ``x`` to all rows ``c``: doubles that hold whole numbers exactly, or Python's integers."""
    most = sum(int(max(-int(a.min()), int(a.max()))) for a in (x, c))
    if most * most * x.shape[1] < 2**51:
        x, c = x.astype("f8"), c.astype("f8")
        return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    x, c = x.astype(object), c.astype(object)
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower index, and its slack, rounded down."""
    squares = all_squares(x, c)
    best = squares.argmin(axis=1).astype("i8")
    if len(c) == 1:
        return best, np.full(len(x), np.inf)
    two = np.sqrt(np.sort(squares, axis=1)[:, :2].astype("f8"))
    return best, two[:, 1] * (1 - SLACK) - two[:, 0] * (1 + SLACK)


def movements(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the slack of a part of each entry shrinks at most when the entries move from ``old`` to ``new``, rounded up."""
    far = np.sqrt(exact_squares(old, new).astype("f8")) * (1 + SLACK)
    if len(far) == 1:
        return far
    top = np.argsort(far)[-2:]
    others = np.where(np.arange(len(far)) == top[1], far[top[0]], far[top[1]])
    return (far + others) * (1 + SLACK)


class Heaps:
    """The heaps of one part position of a block, stored one after the other by entry; ``end`` has where each one ends."""

    def __init__(self, key: np.ndarray, row: np.ndarray, end: np.ndarray):
        self.key, self.row, self.end = key, row, end
        self.open: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, entry: np.ndarray, key: np.ndarray, entries: int) -> Heaps:
        """Heaps of all rows; sorted keys are a heap."""
        order = np.lexsort((key, entry))
        return cls(key[order], order, np.searchsorted(entry[order], np.arange(entries), "right"))

    def heap(self, j: int) -> list[tuple[float, int]]:
        """The heap of entry ``j`` as a list; only those asked for are ever made."""
        if j not in self.open:
            a, b = self.end[j - 1] if j else 0, self.end[j]
            self.open[j] = list(zip(self.key[a:b].tolist(), self.row[a:b].tolist(), strict=True))
        return self.open[j]

    def pop(self, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and rows of the parts whose keys are no longer above their entry's limit."""
        out: list[tuple[int, int]] = []
        for j, limit in enumerate(limits.tolist()):
            a, b = self.end[j - 1] if j else 0, self.end[j]
            if a < b and self.key[a] <= limit:  # the first of a heap is its smallest
                heap = self.heap(j)
                while heap and heap[0][0] <= limit:
                    out.append((j, heappop(heap)[1]))
        found = np.array(out, "i8").reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def push(self, entry: np.ndarray, row: np.ndarray, key: np.ndarray) -> None:
        for j, i, k in zip(entry.tolist(), row.tolist(), key.tolist(), strict=True):
            heappush(self.heap(j), (k, i))

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows, ends = [], [], []
        for j in range(len(self.end)):
            a, b = self.end[j - 1] if j else 0, self.end[j]
            key, row = self.key[a:b], self.row[a:b]
            if j in self.open:
                own = self.open[j]
                key, row = np.array([k for k, _ in own], "f8"), np.array([i for _, i in own], "i8")
            keys.append(key)
            rows.append(row)
            ends.append(len(key))
        return np.concatenate(keys), np.concatenate(rows), np.cumsum(ends)

    def entries(self) -> np.ndarray:
        """The entry of each row."""
        _, row, end = self.stored()
        out = np.empty(len(row), "i8")
        out[row] = np.repeat(np.arange(len(end)), np.diff(np.r_[0, end]))
        return out


def _halves(entry: np.ndarray, x: np.ndarray, entries: int, sign: int = 1) -> np.ndarray:
    """(2, entries, width + 1): sums of the high and low halves of the parts of each entry, and their numbers, as longs."""
    wide = np.c_[x, np.ones(len(x), "i8")]
    out = np.zeros((2, entries, wide.shape[1]), "i8")
    for half, values in enumerate((wide >> 32, wide & 0xFFFFFFFF)):
        np.add.at(out[half], entry, sign * values)
    return out


#: A block's state besides its rows: components by vector, and by part position heaps and sums.
STATE = "parts array<long>, heap_key array<double>, heap_row array<long>, heap_end array<long>, sums array<long>, scanned long"


def _packed(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(n)) for n in names]


def _one(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.ravel())) for a in arrays]


def _unpacked(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def first_state(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of ``vectors`` (columns, and q: whole numbers of one dimension) with all parts compared with all entries of ``books`` (parts, entries, width)."""
    parts, entries, width = books.shape
    names = [c for c in vectors.columns if c != "q"]
    schema = ", ".join([f"`{f.name}` array<{f.dataType.simpleString()}>" for f in vectors.select(*names).schema] + [STATE])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                q = batch.column(batch.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
                stored, sums = [], np.zeros((parts, 2, entries, width + 1), "i8")
                for p in range(parts):
                    entry, slack = scan(q[:, p], books[p])
                    stored.append(Heaps.of(entry, slack, entries).stored())
                    sums[p] = _halves(entry, q[:, p], entries)
                own = _one(q, *(np.stack(s) for s in zip(*stored, strict=True)), sums)
                yield pa.RecordBatch.from_arrays([*_packed(batch, names), *own, pa.array([parts * len(q)])], names=[*names, *[c.split()[0] for c in STATE.split(", ")]])

    return vectors.mapInArrow(work, schema)


def next_state(state: DataFrame, books: np.ndarray, limits: np.ndarray) -> DataFrame:
    """``state`` after the parts whose keys are not above ``limits`` (parts, entries: movements so far) are compared with the entries of ``books``."""
    parts, entries, width = books.shape
    kept = [c for c in state.columns if c not in ("heap_key", "heap_row", "heap_end", "sums", "scanned")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                q = _unpacked(column["parts"], i).reshape(-1, parts, width)
                key, row = (_unpacked(column[c], i).reshape(parts, -1) for c in ("heap_key", "heap_row"))
                end, sums = _unpacked(column["heap_end"], i).reshape(parts, entries), _unpacked(column["sums"], i).reshape(parts, 2, entries, width + 1).copy()
                stored, scanned = [], 0
                for p in range(parts):
                    heaps = Heaps(key[p], row[p], end[p])
                    was, rows = heaps.pop(limits[p])
                    if len(rows):
                        now, slack = scan(q[rows, p], books[p])
                        heaps.push(now, rows, slack + limits[p][now])
                        left = was != now
                        sums[p] += _halves(was[left], q[rows[left], p], entries, -1) + _halves(now[left], q[rows[left], p], entries)
                        scanned += len(rows)
                    stored.append(heaps.stored())
                own = _one(*(np.stack(s) for s in zip(*stored, strict=True)), sums)
                yield pa.RecordBatch.from_arrays([*[column[c].slice(i, 1) for c in kept], *own, pa.array([scanned])], names=[*kept, "heap_key", "heap_row", "heap_end", "sums", "scanned"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*kept, "heap_key", "heap_row", "heap_end", "sums", "scanned").schema)
    return state.mapInArrow(work, schema)


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the componentwise floor of their parts' mean; those without parts stay. The driver gets as many numbers as the codebooks have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's longs hold the halves of 2^31 vectors.
        total = np.zeros(books.shape[0] * 2 * books.shape[1] * (books.shape[2] + 1), "i8")
        for batch in batches:
            for i in range(batch.num_rows):
                total += _unpacked(batch.column(0), i)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype="i4")), pa.array(total)], names=["at", "n"])

    rows = state.select("sums").mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()
    flat = np.zeros(books.shape[0] * 2 * books.shape[1] * (books.shape[2] + 1), object)
    for r in rows:
        flat[r["at"]] = int(r.n)
    sums = flat.reshape(books.shape[0], 2, books.shape[1], books.shape[2] + 1)
    whole, out = sums[:, 0] * 2**32 + sums[:, 1], books.copy()
    for p, j in zip(*np.nonzero(whole[:, :, -1]), strict=True):
        out[p, j] = [int(s) // int(whole[p, j, -1]) for s in whole[p, j, :-1]]
    return out


def coded(state: DataFrame, books: np.ndarray, names: list[str], code: str, error: str) -> DataFrame:
    """Rows of the blocks again, with ``code`` (two hex digits a part) and ``error`` (squared distances to the entries, summed over parts)."""
    parts, entries, width = books.shape
    hexes = np.array([f"{j:02x}" for j in range(entries)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                q = _unpacked(column["parts"], i).reshape(-1, parts, width)
                key, row = (_unpacked(column[c], i).reshape(parts, -1) for c in ("heap_key", "heap_row"))
                end = _unpacked(column["heap_end"], i).reshape(parts, entries)
                entry = np.stack([Heaps(key[p], row[p], end[p]).entries() for p in range(parts)], axis=1)
                total = sum(exact_squares(q[:, p], books[p][entry[:, p]]).astype(object) for p in range(parts))
                digits = ["".join(x) for x in hexes[entry]]
                errors = np.minimum(total, LONGEST).astype("i8")
                rows = [column[n].slice(i, 1).flatten() for n in names]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(digits, pa.string()), pa.array(errors)], names=[*names, code, error])

    fields = {f.name: f.dataType.elementType.simpleString() for f in state.select(*names).schema}
    schema = ", ".join(f"`{n}` {fields[n]}" for n in names) + f", `{code}` string, `{error}` long"
    return state.select(*names, "parts", "heap_key", "heap_row", "heap_end").mapInArrow(work, schema)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (vec_id, embedding, others; embedding left out) that are finite with ``code`` and ``error``, a table, and the codebooks (parts, entries, width).

    Components are floor(scale * x), at most a long. A codebook starts as that part of the vectors
    of smallest id (nulls last, equal ids by their components), of which all coded vectors have the
    dimension: a vector whose dimension is another one, or not a multiple of ``parts``, keeps its
    row with null code and error. Null vectors and those with null or non-finite components have no
    row. Repeated rows are vectors of their own. An error beyond a long is the largest long. The
    codebooks are null codes' too: no vectors, no rows and an array without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"an index of two hex digits has 1 to 256 entries, not {entries}")
    if clash := [c for c in vectors.columns if c in ("code", "error")]:
        vectors = vectors.withColumnsRenamed({c: unused(f"input_{c}", vectors) for c in clash})
    private = {c: f"in_{c}" for c in vectors.columns if c != "embedding"}
    kept = vectors.select(*[F.col(f"`{c}`").alias(p) for c, p in private.items()], quantised(F.col("embedding"), scale).alias("q")).where("q is not null")
    fits = (F.size("q") > 0) & (F.size("q") % parts == 0)
    order = F.col("in_vec_id").asc_nulls_last()
    head = kept.where(fits).orderBy(order, "q").limit(1).select(F.size("q")).first()
    dim = head[0] if head else 0
    back = lambda df: df.select(*[F.col(f"`{p}`").alias(c) for c, p in private.items()], "code", "error")
    others = back(kept.where(F.size("q") != dim).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")}))
    if not dim:
        return save(others, "codes"), np.zeros((parts, 0, 0), "i8")
    same = kept.where(F.size("q") == dim)
    first = same.orderBy(order, "q").limit(entries).select("q").collect()
    books = np.array([r.q for r in first], "i8").reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    state, limits = save(first_state(same, books), "codes-state"), np.zeros(books.shape[:2])
    for _ in range(rounds):
        new = moved_books(state, books)
        limits = (limits + np.stack([movements(a, b) for a, b in zip(books, new, strict=True)])) * (1 + SLACK)
        books, past = new, state
        state = save(next_state(past, books, limits), "codes-state")
        discard(past)
    out = save(back(coded(state, books, list(private.values()), "code", "error")).unionByName(others), "codes")
    discard(state)
    return out, books


def op13_codes_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors and their errors, also summed by label, nulls together."""
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = rows.withColumn("label_key", key)
    most = F.lit(LONGEST).cast("decimal(38,0)")
    sums = rows.groupBy("label_key").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"), F.count("*").alias("copies"))
    numbers = ",".join(map(str, books.ravel().tolist()))
    whole = join_counted(rows, save(sums, "codes-labels"), ["label_key"], "copies")
    return whole.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def _rounds(rounds: int) -> str:
    """CTEs of the rounds: a<i> assigns to the entries c<i>, c<i+1> are the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, distance * 64 + entry) AS entry, min(distance) AS distance FROM (
    SELECT vec_id, part, entry, {" + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, 5))} AS distance FROM p JOIN c{i} USING (part)) GROUP BY vec_id, part
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN p USING (vec_id, part), range(1, 5) t(i) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry)
)""")
    return ", ".join(steps)


OP13_SQL = f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, place, part::INTEGER AS part, q[4 * part + 1 : 4 * part + 4] AS x FROM e, range(16) t(part)
), c0 AS (
  SELECT part, place AS entry, x AS c FROM p WHERE place < 64
), {_rounds(2)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM codes JOIN e USING (vec_id)
"""
