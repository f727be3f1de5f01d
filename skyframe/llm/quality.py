"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 9)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table, with_row_numbers

#: Labelled rows that the trees are fitted on, at most: those of the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
SYMBOLS = b"!#$%&*|.,:;?-_=+/<>(){}[]\"'@~^\\"
FEATURES = (
    "bytes", "words", "lines", "word_bytes", "longest_word", "short_words", "upper", "lower", "digits", "spaces", "newlines", "high",
    "symbols", "symbol_kinds", *(f"symbol_{chr(c)}" for c in SYMBOLS[:8]), "distinct_words", "top_word", "distinct_trigrams", "distinct_lines",
    "repeated_line_bytes", "line_bytes", "symbol_ends", "capital_words", "upper_words",
)


def features(text: bytes | None) -> list[float]:
    """Statistics of a whole UTF-8 text, in the order of FEATURES; zeros for an empty or null one."""
    if not text:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    n, words, lines = len(text), text.split(), [x for x in text.split(b"\n") if x.strip()]
    upper, lower, digits, high = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[192:].sum()
    spaces, symbols = count[32] + count[9:14].sum(), count[list(SYMBOLS)]
    many, k = Counter(words), max(1, len(words))
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2) if len(words) > 2 else 1.0
    by_line = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in by_line.items() if c > 1)
    ends, first, whole = 0, 0, 0
    for w, c in many.items():
        ends += c * (w[-2:-1] in b"!#$%&*|" and w[-1:] in b"!#$%&*|" and len(w) > 1)
        first += c * (65 <= w[0] <= 90)
        whole += c * w.isupper()
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), (n - spaces) / k, np.log1p(max(map(len, words), default=0)), sum(c for w, c in many.items() if len(w) <= 3) / k,
        upper / n, lower / n, digits / n, spaces / n, count[10] / n, high / n, symbols.sum() / n, float((symbols > 0).sum()), *(symbols[:8] / n),
        len(many) / k, max(many.values(), default=0) / k, trigrams, len(by_line) / max(1, len(lines)), repeated / n, np.log1p(n / max(1, len(lines))), ends / k, first / k, whole / k,
    ]


def document_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns ``carry`` and the statistics of every row of ``docs`` (doc_id, text); texts never leave their task."""
    keys = ["doc_id", *carry]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(len(keys))], "f4").reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="i4") * len(FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], names=[*keys, "x"])

    schema = ", ".join(f"`{k}` long" for k in keys)
    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("binary").alias("text")).mapInArrow(rows, f"{schema}, x array<float>")


@dataclass
class Trees:
    """Complete trees of one depth as arrays: inner nodes by (tree, place in level order), leaves by (tree, leaf)."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row: all trees go down a level at a time."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.prior)
        at = np.arange(trees)[None, :]
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            node = np.zeros((len(part), trees), "i4")
            for _ in range((inner + 1).bit_length() - 1):
                right = part[np.arange(len(part))[:, None], self.feature[at, node]] > self.threshold[at, node]
                node = 2 * node + 1 + right
            total[start : start + 4096] += self.leaf[at, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0) -> Trees:
    """Gradient boosting of logistic loss; each level's splits come from histograms of gradients over at most ``bins`` quantile bins.

    Without rows of both labels every score is (label-1 rows + 1) / (rows + 1).
    """
    inner, n, width = 2**depth - 1, len(y), x.shape[1]
    feature, threshold, leaf = np.zeros((trees, inner), "i4"), np.full((trees, inner), np.inf, "f4"), np.zeros((trees, 2**depth))
    share = (y.sum() + 1) / (n + 1)
    if n == 0 or y.min() == y.max():
        return Trees(float(np.log(share / max(1 - share, 1e-9))), feature, threshold, leaf)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    offset = np.arange(width) * bins
    margin = np.full(n, prior := float(np.log(y.mean() / (1 - y.mean()))))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(n, "i8")
        for d in range(depth):
            local = node - (2**d - 1)
            cell = (local[:, None] * (width * bins) + offset + binned).ravel()
            shape = (2**d, width, bins)
            left_g, left_h = (np.bincount(cell, np.repeat(v, width), np.prod(shape)).reshape(shape).cumsum(axis=2) for v in (g, h))
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            best = gain.reshape(2**d, -1).argmax(axis=1)
            split = gain.reshape(2**d, -1)[np.arange(2**d), best] > 1e-6
            f, b = best // bins, best % bins
            at = 2**d - 1 + np.arange(2**d)
            feature[t, at] = f
            threshold[t, at] = [cuts[i][j] if s and j < len(cuts[i]) else np.inf for i, j, s in zip(f, b, split, strict=True)]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        end = node - inner
        leaf[t] = -rate * np.bincount(end, g, 2**depth) / (np.bincount(end, h, 2**depth) + ridge)
        margin += leaf[t][end]
    return Trees(prior, feature, threshold, leaf)


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns ``carry``, score and held_out of every row of ``docs``, learnt from ``labels`` (doc_id, quality) of rows not held out.

    Statistics are computed once for all documents and kept as a table; the trees are fitted on at
    most ``sample_rows`` labelled documents, which alone come to the driver. Null labels are left out.
    """
    stats = save(document_statistics(docs, carry), "quality-statistics").withColumn("held_out", held_out(F.col("doc_id"), 4))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    # The smallest hashes are below about this share of their range, so tasks need not send more than that.
    labelled = stats.where("not held_out").join(known, "doc_id").withColumn("_place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    share = min(1.0, 2 * sample_rows / max(labelled.count(), 1))
    sample = labelled.where(F.col("_place") < int(share * (1 << 30))).orderBy("_place", "doc_id", "y").limit(sample_rows).select("x", "y").toPandas()
    x = np.array(sample["x"].tolist(), "f4").reshape(len(sample), len(FEATURES))
    model = fit_trees(x, sample["y"].to_numpy("f8"))

    keys = ["doc_id", *carry]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = batch.column(len(keys)), batch.column(len(keys) + 1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(model.score(rows)), held], names=[*keys, "score", "held_out"])

    schema = ", ".join(f"`{k}` long" for k in keys)
    return stats.select(*keys, "held_out", "x").mapInArrow(scored, f"{schema}, score double, held_out boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose own score is below the threshold, whatever their doc_id."""
    numbered, row = with_row_numbers(docs, "quality-docs")
    gone = score_quality(numbered, labels, carry=(row,)).where(F.col("score") < threshold).select(row)
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def op9_quality_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
