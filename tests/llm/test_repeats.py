import hashlib
import random

import numpy as np
from conftest import WORDS

from skyframe.llm.repeats import ANCHOR, COVER, PERIOD, PIECE, WINDOW, anchor_places, pieces, remove_repeats, word_codes

from pyspark.sql import functions as F


def brute(rows):
    """(doc_id, text) rows to (doc_id, n_words, n_removed, kept text), by looking at every window."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - WINDOW + 1):
                s = tuple(w[k : k + WINDOW])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1) if i is not None else ():
            if least[tuple(w[k : k + WINDOW])] < i:
                gone[k : k + WINDOW] = [True] * WINDOW
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_repeats(df).collect()), key=str)


def test_cover_has_every_difference_and_windows_share_an_aligned_anchor():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD)) and ANCHOR + PERIOD - 1 <= WINDOW
    for a in range(2 * PERIOD):
        for b in range(2 * PERIOD):
            one, two = (set((anchor_places(60) - s).tolist()) for s in (a, b))
            assert {k for k in one & two if 0 <= k <= WINDOW - ANCHOR}


def test_pieces_cut_like_split():
    text = (" ".join(f"w{i}" for i in range(400_000)) + "\t\n x").encode()
    assert len(text) > 2 * PIECE and [w for p in pieces(text) for w in p] == text.split()
    assert len(word_codes(text)) == len(text.split()) and len(word_codes(None)) == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(4))
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(160):
        text = []
        for _ in range(rng.randrange(6)):
            text += [word() for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p if rng.random() < 0.5 else p[a : a + 30]
        rows.append((i * 7 % 160, "  ".join(text) + rng.choice(["", "\n", " "])))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (-3, rows[4][1]), (5, rows[6][1]), (None, rows[5][1]), (None, None), (600, None), (601, ""), (602, " \t"), (603, "a b"), (604, " ".join(["same"] * 40)), (605, " ".join(["same"] * 13)), (606, " ".join(["same"] * 12))]
    want = brute(rows)
    assert any(0 < r[2] < r[1] for r in want) and any(r[2] == r[1] > 0 for r in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df.repartition(5)) == want
    assert got(df.coalesce(1)) == want


def test_a_passage_of_half_of_all_documents(spark):
    common = " ".join(f"c{i}" for i in range(55))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("own "), F.col("id"), F.lit(" words " + common + " end "), F.col("id") + 1)).otherwise(F.concat(F.lit("clean "), F.col("id"))).alias("text"))
    rows = remove_repeats(df.repartition(7)).select("doc_id", "n_removed").collect()
    assert len(rows) == 3000 and all(r.n_removed == (57 if r.doc_id % 2 == 0 and r.doc_id else 0) for r in rows)


def test_awkward(spark, awkward, no_docs):
    rows = remove_repeats(awkward).collect()
    assert len(rows) == awkward.count() and rows[0].__fields__ == [*awkward.columns, "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows), key=str) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    clash = awkward.withColumnsRenamed({"slot": "n_words", "word": "block_of_rows"})
    assert remove_repeats(clash).columns == [c for c in clash.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert remove_repeats(clash).count() == awkward.count()
    assert remove_repeats(no_docs).count() == 0


def test_query_digest(spark, tmp_path):
    from skyframe.llm.repeats import op11_repeats_cover

    rows = [(1, " ".join(map(str, range(30)))), (2, "x  y " + " ".join(map(str, range(5, 25))) + " z"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows)}
    assert {tuple(r) for r in op11_repeats_cover(spark, str(tmp_path)).collect()} == want
    assert np.array([g for _, _, g, _ in want]).max() == 20
