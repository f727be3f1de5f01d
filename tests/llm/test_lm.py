"""The language model: base counts by brute force, chances that sum to 1, gradients, classes."""

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from conftest import AWKWARD

from skyframe.llm import lm
from skyframe.llm.common import save

TEXTS = [f"{a} {b} {a}" for a in ("red", "green", "blue") for b in ("lamp", "boat", "tree") for _ in range(8)]


def code(word):
    return lm.token_code(word.encode())


def tokens(spark, texts):
    return save(lm.coded_texts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")), "test-tokens")


def test_runs_against_a_loop():
    texts = [[code(w) for w in t.split()] + [code("\n")] for t in ("a bb ccc a", "", "dd", "e f g h i j")]
    column = pa.array(texts, pa.list_(pa.int64()))
    got = [np.concatenate(x) for x in zip(*lm._runs(column, 3), strict=True)]
    want = []
    for d, t in enumerate(texts):
        for i, c in enumerate(t):
            want.append((c, t[i - 1] if i else code("\n"), t[i - 2] if i > 1 else code("\n"), d))
    assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == want
    ids = lambda x: x % 1000
    for size in (2, 100):
        pairs = [[np.concatenate([run[j][i] for run in lm._runs(column, size, ids)]) for i in (0, 1)] for j in range(3)]
        assert all((ids(c) == i).all() and c.tolist() == [w[j] for w in want] for j, (c, i) in enumerate(pairs))


def test_gradient_is_the_difference_quotient():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(9, lm.LEAVES))
    rows, target = np.column_stack([np.full(50, 2), rng.integers(0, 9, (50, 3))]), rng.integers(0, lm.LEAVES, 50)
    value = lambda w: lm.log_softmax(w, rows)[np.arange(50), target].sum()
    touched, count, slope = lm.slopes(weights, rows, target)
    assert count.sum() == rows.size
    for i, r in enumerate(touched[:4]):
        for c in (0, 5, lm.LEAVES - 1):
            up, down = weights.copy(), weights.copy()
            up[r, c] += 1e-5
            down[r, c] -= 1e-5
            assert slope[i, c] == pytest.approx((value(up) - value(down)) / 2e-5, rel=1e-3, abs=1e-4)


def test_chances_sum_to_one(spark):
    model, counts = lm.train(tokens(spark, TEXTS))
    known = {r.code: r.n for r in counts.collect()}
    assert known == {code(w): n for w, n in Counter(w for t in TEXTS for w in [*t.split(), "\n"]).items()}
    n = lm.CLASSES * lm.LEAVES
    for before, second in (("red", "\n"), ("lamp", "green"), ("zebra", "zebra")):
        words = np.array(list(known), "i8")
        told = lambda w, k: (np.full(k, code(w)), np.full(k, model.ids(np.array([code(w)]))[0]))
        chance = model.log_chances((words, model.ids(words)), told(before, len(words)), told(second, len(words)))
        total = (10**chance * (np.array([known[w] for w in words.tolist()]) + 1)).sum()
        # One unseen word of each leaf: its share is 1 of the leaf's words.
        cls, leaf = np.repeat(np.arange(lm.CLASSES), lm.LEAVES), np.tile(np.arange(lm.LEAVES), lm.CLASSES)
        one, two = model.features(told(before, n), told(second, n), cls)
        both = lm.log_softmax(model.one, one)[np.arange(n), cls] + lm.log_softmax(model.two, two)[np.arange(n), leaf]
        assert total + (np.exp(both) / 10**model.log_unit).sum() == pytest.approx(1, abs=1e-5)
        # Every word that is counted is one of its leaf's words.
    assert (10**model.log_unit).sum() == pytest.approx(sum(known.values()) + len(known) + n)


def test_classes_go_by_company(spark):
    """Two languages that never mix: frequent words of one share no class with those of the other."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"{k}{i}" for i in range(30)], 40)) for k in ("ar", "zu") for _ in range(60)]
    counts = Counter(w for t in texts for w in t.split())
    words = np.array([code(w) for w, _ in counts.most_common()], "i8")
    cls = lm.learn_classes(tokens(spark, texts), words)
    by = {w: cls[i] for i, (w, _) in enumerate(counts.most_common())}
    assert not {by[w] for w in by if w[0] == "a"} & {by[w] for w in by if w[0] == "z"}


def test_scores(spark, awkward, no_docs):
    training = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    told = [*TEXTS[:3], None, "", "red zebra RED", "lamp lamp"]
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    counts = Counter(w for t in TEXTS for w in [*t.split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    for held in (200_000, 2):
        for r in lm.score_texts(docs, training, held_words=held).collect():
            own = [*(told[r.doc_id] or "").lower().split(), "\n"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in own))
            assert r.score < 0 and (r.doc_id > 2 or r.score > r.base_score)
    assert lm.score_texts(awkward, awkward).count() == len(AWKWARD)
    assert lm.score_texts(no_docs, no_docs).count() == 0
    assert lm.score_texts(awkward, no_docs).where("score > 0 or n_known > 0").count() == 0


def test_texts_are_coded_by_different_word():
    """Against a split word by word; odd white space, no words and bytes that are no UTF-8."""
    texts = [None, b"", b" ", b" a  b\x0b\x0cC\x1c d\x85e\xc2\xa0f ", b"\xff\xfe X\x00y Z", "\u00c9 \u00c0A a".encode(), b"END\n\n", b"a\x1db, a."]
    want = [[lm.token_code(w) for w in [*(t or b"").lower().split(), lm.END]] for t in texts]
    assert lm.coded(pa.array(texts, pa.binary())).to_pylist() == want
    assert lm.coded(pa.array(texts, pa.binary()).slice(3, 2)).to_pylist() == want[3:5] and lm.coded(pa.array([], pa.binary())).to_pylist() == []
    assert lm.token_codes([b"a", b"b"]).tolist() == [lm.token_code(b"a"), lm.token_code(b"b")]


def test_run_sums_and_targets_against_loops():
    rng = np.random.default_rng(4)
    values, source = rng.normal(size=(40, 5)), rng.integers(0, 40, 900)
    starts = np.array([0, 1, 3, 20, 37, 300, 899])
    want = [values[source[a:b]].sum(axis=0) for a, b in zip(starts, [*starts[1:], 900], strict=True)]
    for most in (2, 16, 200):
        assert np.allclose(lm.run_sums(values, source, starts, most), want)
    rows, target = rng.integers(0, 40, (9000, 3)), rng.integers(0, 5, 9000)
    assert np.allclose(lm.log_chance_of(values, rows, target), lm.log_softmax(values, rows)[np.arange(9000), target])
    touched, count, slope = lm.slopes(values, rows[:50] * 0 + 3, target[:50])
    assert touched.tolist() == [3] and count.tolist() == [150] and slope.shape == (1, 5)
