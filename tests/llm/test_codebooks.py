import hashlib

import numpy as np

from skyframe.llm.centroids import LONGEST, cluster_vectors, exact_squares, intervals, nearest
from skyframe.llm.codes import Heaps, compress, first_state, movements, moved_books, next_state, op13_codes_heap, scan
from skyframe.spool import save

from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def brute_nearest(x, c):
    """Plain integers: (entry, squared distance) of each row, ties to the smaller number."""
    return [min((sum((a - b) ** 2 for a, b in zip(r, e, strict=True)), j) for j, e in enumerate(c))[::-1] for r in x]


def means(x, entries, c):
    out = [list(e) for e in c]
    for j in range(len(c)):
        own = [r for r, e in zip(x, entries, strict=True) if e == j]
        if own:
            out[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return out


def test_intervals_hold_the_truth_and_ties_go_down():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 2**24 + 1, 2**40):
        x, c = rng.integers(-scale, scale + 1, (200, 17)), rng.integers(-scale, scale + 1, (9, 17))
        c[5] = c[2]
        low, high = intervals(x, c)
        true = np.array([[int(sum(int(b) ** 2 for b in e)) - 2 * sum(int(a) * int(b) for a, b in zip(r, e, strict=True)) for e in c] for r in x], object)
        assert (low <= true).all() and (true <= high).all()
        got, exact = nearest(x, c)
        assert got.tolist() == [j for j, _ in brute_nearest(x.tolist(), c.tolist())]
        assert exact < len(x)  # the screen decides some
    huge = np.array([[2**62, -(2**62)], [1, 1]])
    assert nearest(huge, huge[::-1])[0].tolist() == [1, 0] and exact_squares(huge[:1], huge[1:])[0] > LONGEST


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.integers(-40, 40, 6) / 64 + 1e-3).tolist()) for i in range(120)] + [(200 + i, [0.25] * 6) for i in range(60)]
    others = [(300, [0.1] * 5), (301, None), (302, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (303, [NAN] * 6), (304, [INF] * 6)]
    df = spark.createDataFrame(vectors + others, "vec_id long, embedding array<double>")
    rows = cluster_vectors(df, 7, 3, 6).collect()
    q = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    first = sorted(q, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:7]
    c = [q[i] for i in first]
    for _ in range(3):
        c = means(list(q.values()), [j for j, _ in brute_nearest(q.values(), c)], c)
    want = {i: e for i, e in zip(q, brute_nearest(q.values(), c), strict=True)}
    assert {r.vec_id: (r.cluster, r.distance) for r in rows} == want and len(rows) == len(q)
    for r in rows:
        assert r.cluster_inertia == sum(d for j, d in want.values() if j == r.cluster) and r.inertia == sum(d for _, d in want.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clusters_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, q string, cluster int"
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [0.5, 0.5], "a", 1), (None, [0.5, 0.5], "a", 1), (4, [0.0, 1.0], "b", 2), (4, [0.0, 1.0], "b", 2), (5, [3e38, -3e38], None, None)]
    got = cluster_vectors(spark.createDataFrame(rows, schema), dim=2).collect()
    assert len(got) == 5 and {r.inertia for r in got} == {0}
    got = cluster_vectors(spark.createDataFrame(rows, schema), k=1, dim=2).collect()
    assert len(got) == 5 and {r.inertia for r in got} == {LONGEST}


def brute_codes(rows, parts, entries, rounds, scale):
    """(codes, errors) by vec_id and the codebooks, in plain integers."""
    q = {i: [int(np.floor(scale * x)) for x in v] for i, v in rows}
    width = len(next(iter(q.values()))) // parts
    codes, errors, books = {i: "" for i in q}, dict.fromkeys(q, 0), []
    for p in range(parts):
        x = [q[i][p * width : (p + 1) * width] for i in q]
        c = [q[i][p * width : (p + 1) * width] for i in sorted(q)[:entries]]
        for _ in range(rounds):
            c = means(x, [j for j, _ in brute_nearest(x, c)], c)
        for i, (j, d) in zip(q, brute_nearest(x, c), strict=True):
            codes[i] += f"{j:02x}"
            errors[i] += d
        books.append(c)
    return codes, errors, books


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + rng.integers(0, 3)).tolist()) for i in rng.permutation(300).tolist()] + [(400 + i, [0.5] * 8) for i in range(80)]
    others = [(600, None), (601, [NAN] * 8), (602, [None] * 8), (603, [])]
    df = spark.createDataFrame([(i, v, "l", "e") for i, v in rows + others] + [(700, [1.0] * 7, "l", "e"), (701, [1.0] * 4, None, None)], "vec_id long, embedding array<double>, code string, parts string")
    for entries, rounds in ((16, 2), (5, 6), (1, 1), (256, 1)):
        out, books = compress(df.repartition(3), 4, entries, rounds, 16)
        codes, errors, want = brute_codes(rows, 4, entries, rounds, 16)
        got = {r.vec_id: r for r in out.collect()}
        assert books.tolist() == want
        assert {i: (r.code, r.error) for i, r in got.items()} == {i: (codes[i], errors[i]) for i in codes} | {700: (None, None), 701: (None, None), 603: (None, None)}
        assert out.columns == ["vec_id", "input_code", "parts", "code", "error"]


def test_heaps_pop_only_what_movement_has_violated(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (2000, 4))
    books = x[:16].reshape(1, 16, 4).copy()
    entry, slack = scan(x, books[0])
    heaps = Heaps.of(entry, slack, 16)
    limits = rng.random(16) * 60
    was, rows = heaps.pop(limits)
    assert set(rows.tolist()) == set(np.flatnonzero(slack <= limits[entry]).tolist()) and (entry[rows] == was).all()
    heaps.push(was, rows, slack[rows] + 100)
    key, row, end = heaps.stored()
    for a, b in zip(np.r_[0, end[:-1]], end, strict=True):
        own = key[a:b]
        assert all(own[i] <= own[k] for i in range(len(own)) for k in (2 * i + 1, 2 * i + 2) if k < len(own))
    assert (Heaps(key, row, end).entries() == entry).all()
    # Of clustered vectors later rounds compare a part of all again, and still find what a full scan finds.
    centre = rng.integers(-4000, 4000, (16, 4))
    x = (centre[rng.integers(0, 16, 2000)] + rng.integers(-100, 100, (2000, 4)))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "in_vec_id long, q array<long>").coalesce(1)
    books = centre.reshape(1, 16, 4).copy()
    state, limits = save(first_state(df, books), "t"), np.zeros((1, 16))
    for _ in range(3):
        new = moved_books(state, books)
        limits += movements(books[0], new[0])[None]
        books = new
        state = save(next_state(state, books, limits), "t")
    r = state.select("heap_key", "heap_row", "heap_end", F.col("scanned")).first()
    assert r.scanned < 500
    assert (Heaps(np.array(r.heap_key), np.array(r.heap_row), np.array(r.heap_end)).entries() == scan(x, books[0])[0]).all()


def test_codes_of_awkward_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    out, books = compress(spark.createDataFrame([], schema))
    assert out.count() == 0 and books.size == 0
    rows = [(None, [0.5] * 16, None), (3, [3e38] * 16, 1), (3, [3e38] * 16, 1), (4, [-3e38] * 16, None), (5, None, 2)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_codes_heap(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}
    out, _ = compress(spark.createDataFrame(rows, schema), entries=1, rounds=0)
    assert sorted(r.error for r in out.collect()) == [0, 0, LONGEST, LONGEST]
