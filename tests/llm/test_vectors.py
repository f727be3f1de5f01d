import numpy as np
from conftest import Components

from skyframe.llm.components import connected_components
from skyframe.llm.embedding_dedup import link_components
from skyframe.llm.topk import KDTree, cut_space, exact_topk, quantised, regions_of

from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(40)]
    brute = Components({x for e in edges for x in e})
    for a, b in edges:
        brute.join(a, b)
    df = spark.createDataFrame(edges + [(None, 5)], "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: brute.find(x) for x in brute.up}
    assert connected_components(df.limit(0)).count() == 0


def test_tree_boxes_are_tight_and_bounds_hold():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(-9, 9, (300, 5)).astype("f8"), rng.integers(-9, 9, (20, 5)).astype("f8")
    tree = KDTree(rows, 16)
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.span):
        own = rows[tree.order[a:b]]
        assert (tree.low[node] == own.min(axis=0)).all() and (tree.high[node] == own.max(axis=0)).all()
        assert (bounds[:, node] >= (queries @ own.T).max(axis=1)).all()


def brute_topk(rows, k):
    out = set()
    for q, a in rows:
        if q % 4 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(b) == len(a))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(150)] + [(200 + i, [1, 2]) for i in range(6)] + [(300, [2**40, 1, 1, 1]), (304, [2**40, 2**40, 0, 0])]
    df = spark.createDataFrame([*rows, rows[0], (None, [1, 1, 1, 1]), (999, None)], "vec_id long, q array<long>")
    for shard_rows in (1000, 30, 4):
        got = exact_topk(df, F.col("vec_id") % 4 == 0, 5, shard_rows).collect()
        want = {(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in brute_topk(rows, 5)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert exact_topk(df.limit(0), F.lit(True), 5).count() == 0


def test_quantised(spark):
    df = spark.createDataFrame([([0.1, -0.1],), ([NAN, 1.0],), ([INF, 1.0],), ([None, 1.0],), (None,)], "embedding array<float>")
    assert [r[0] for r in df.select(quantised(F.col("embedding"))).collect()] == [[6, -7], None, None, None, None]


def brute_links(rows, threshold):
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in unit}
    parts = Components([i for i, _ in rows])
    for i, js in links.items():
        for j in js:
            parts.join(i, j)
    return {i: (len(links.get(i, [])), parts.find(i), parts.find(i) == i) for i, _ in rows}


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size in (1, 2, 5, 90, 40):
        centre = rng.normal(size=16)
        for _ in range(size):
            rows.append((n, (centre + 0.1 * rng.normal(size=16)).tolist()))
            n += 1
    rows += [(n + i, v) for i, v in enumerate([rows[3][1], (2 * np.array(rows[3][1])).tolist(), [0.0] * 16, [NAN] + [1.0] * 15, [None] + [1.0] * 15, None, [], [1.0, 2.0], [2.0, 4.0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("own")).withColumn("place", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_components(df, 0.95, window=8, block=32).collect()}
    assert got == brute_links(rows, 0.95)
    assert link_components(df.limit(0)).count() == 0


def test_links_step_by_step(spark):
    """Passes two at a time link what all at once do, and the tables of their steps are gone."""
    from skyframe.spool import saved_tables, sweep

    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=16)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, link_components(df, 0.95, window=4, block=32, at_once=n).collect())) for n in (2 * 120, 1 << 22)]
    assert found[0] == found[1] and any(links for _, links, _, _ in found[0])
    sweep(spark)
    left = [t.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in saved_tables(spark)]
    assert "vector-order" not in left and "vector-found" not in left and "vector-rows" not in left


def test_links_beside_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    n, dim, pairs = 3000, 64, 400
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = unit(rng.normal(size=(n, dim)))
    rows[: n // 3] = unit(np.sqrt(0.8) * unit(rng.normal(size=dim)) + np.sqrt(0.2) * rows[: n // 3])
    at = rng.permutation(n)[:pairs]
    off = rng.normal(size=(pairs, dim))
    off = unit(off - (off * rows[at]).sum(axis=1, keepdims=True) * rows[at])
    rows = np.vstack([rows, 0.955 * rows[at] + np.sqrt(1 - 0.955**2) * off])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in link_components(df, 0.95, window=8, block=512).collect()}
    assert np.mean([got[int(a)] == got[n + i] for i, a in enumerate(at)]) >= 0.97


def test_links_of_repeated_and_null_ids(spark):
    """Rows are vectors of their own whatever their ids: brute force over row numbers."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 16))
    ids = [1, 2, 2, 2, 3, None, None, 7, 7, None, 12, 5, 5, None]
    which = [0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5]
    rows = [(i, (centres[w] + 0.02 * rng.normal(size=16)).tolist()) for i, w in zip(ids, which, strict=True)] + [(2, None), (None, [0.0] * 16)]
    rows.append(rows[5])
    links = brute_links([(k, v) for k, (_, v) in enumerate(rows)], 0.95)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[links[k][1]] = min(i, least.get(links[k][1], i))
    want = sorted(((i, links[k][0], c := least.get(links[k][1]), c is None or c == i) for k, (i, _) in enumerate(rows)), key=str)
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], "vec_id long, embedding array<double>, row string, first int")
    got = sorted((tuple(r) for r in link_components(df, 0.95, window=8, block=4).collect()), key=str)
    assert got == want


def test_regions_of_space():
    rows = np.random.default_rng(5).normal(size=(4000, 6))
    own = np.bincount(regions_of(rows, cut_space(rows, 8)), minlength=8)
    assert len(own) == 8 and own.min() >= 499
    assert set(regions_of(np.ones((9, 3)), cut_space(np.ones((9, 3)), 4))) == {0} and (regions_of(rows, []) == 0).all()


def test_topk_of_clusters_and_many_equal_vectors(spark):
    """A third of all rows are one vector; clusters let most regions be left out."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-50, 50, (8, 6))
    rows = [(i, (centres[i % 8] + rng.integers(-3, 4, 6)).tolist()) for i in range(400)] + [(400 + i, centres[0].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>").withColumn("region", F.lit(1)).withColumn("least", F.lit("x"))
    got = {tuple(r) for r in exact_topk(df, F.col("vec_id") % 4 == 0, 5, 25).collect()}
    assert got == brute_topk(rows, 5)
