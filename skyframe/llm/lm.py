"""Language-model scores by a hashed maximum-entropy model with class-factored softmax (operator 10).

A word's chance is a product of three:

- its class given the two words before, by a softmax over CLASSES whose features are the word
  before (n-gram), both words before together (n-gram) and the one two places back (skip);
- its leaf within the class, by a second softmax over LEAVES whose features are the word before
  and the one two places back, each together with the class;
- its share of the leaf, add-one smoothed, one unseen word counted for each leaf.

Classes are learnt: frequent words and, for all others, endings of words are clustered by what
stands to their left and right. The most frequent words of a class have leaves of their own, so
the second softmax gives their chance whole. Features are hashed to rows of weights, whose number
follows from the distinct words of the training texts up to a bound.

Both softmaxes are trained on all training tokens by distributed gradient updates: every task runs
over its own tokens in small steps from the common weights, Spark averages the rows of weights by
how often each task met them, and the next round starts from there (iterative parameter mixing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import log2, log10
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table
from .quality import held_out

#: The end of a text as a word; no word holds white space.
END = b"\n"
#: Classes with that of the end, leaves of a class (as many), and those of them that belong to one frequent word each.
CLASSES, LEAVES, OWN = 32, 32, 24
#: Words that are clustered by themselves; all others go by their ending. Buckets in which neighbours are counted.
FREQUENT, ENDINGS, BUCKETS = 1792, 256, 64
#: Words that scoring tasks hold in memory, a quarter of those that counting tasks do, and the bound of feature rows (a power of 2).
HELD_WORDS, CACHE_WORDS, MOST_ROWS = 150_000, 400_000, 13
#: Bytes of texts that are coded together.
CODED_BYTES = 1 << 21
#: Tokens of a step and, about, of a training task; rounds, each over its own part of the documents.
STEP, TASK_TOKENS, ROUNDS = 32_768, 4_000_000, 2


def token_codes(words: Sequence[bytes]) -> np.ndarray:
    """Words as signed 64-bit numbers: 56 bits of their XXH64 and, lowest, 8 of their last two bytes before any marks."""
    from xxhash import xxh64_intdigest

    high = np.fromiter((xxh64_intdigest(w, 7) for w in words), "u8", len(words))
    low = np.fromiter((crc32(w.rstrip(b".,;:!?")[-2:]) & 255 for w in words), "u8", len(words))
    return (high << np.uint64(8) | low).view("i8")


def token_code(word: bytes) -> int:
    """One word of :func:`token_codes`."""
    return int(token_codes([word])[0])


def coded(texts: pa.Array) -> pa.ListArray:
    """The codes of the words of binary ``texts``, the end last; each different word is coded once."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))  # by bytes, whatever they are
    told = words.flatten().view(pa.binary()).dictionary_encode()
    different = told.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes, place, lengths = token_codes(different), told.indices.to_numpy(), words.value_lengths().to_numpy()
    there = np.fromiter(map(len, different), "i8", len(different))[place] > 0  # white space at an end of a text makes an empty word
    if not there.all():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[there], minlength=len(lengths))
    ends = np.cumsum(lengths)
    flat = np.insert(codes[place[there]], ends, token_code(END))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype("i4")), pa.array(flat))


def coded_texts(docs: DataFrame) -> DataFrame:
    """``row`` (a number of its own), doc_id and ``tokens`` (codes, the end last) of every row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype("i8")
            starts = np.flatnonzero(np.diff(np.cumsum(size) // CODED_BYTES, prepend=-1))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True) if batch.num_rows else ():
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), coded(part.column(2))], names=["row", "doc_id", "tokens"])

    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return told.mapInArrow(rows, "row long, doc_id long, tokens array<long>")


def _runs(column: pa.ListArray, size: int = STEP, ids: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple]:
    """Tokens of an Arrow column of lists in runs of ``size``: code, the one before, the one two places back, and place of the document. Before a text stands its end.

    With ``ids``, which is asked once for each run and then carried on, each of the three is a pair of codes and their ids.
    """
    end = token_code(END)
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy().astype("i8")
    offsets -= offsets[:1]
    if ids is not None:
        end_id, known = int(ids(np.array([end], "i8"))[0]), np.empty(len(flat), "i4")
    for at in range(0, len(flat), size):
        own = slice(at, at + size)
        index = np.arange(at, min(at + size, len(flat)))
        first, last = np.searchsorted(offsets, (at, index[-1]), "right") - 1
        doc = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], at, at + len(index))))
        place = index - offsets[doc]
        back, inside = [np.maximum(index - k, 0) for k in (1, 2)], [place >= k for k in (1, 2)]
        codes = [flat[own], *(np.where(ok, flat[i], end) for ok, i in zip(inside, back, strict=True))]
        if ids is not None:
            known[own] = ids(codes[0])
            codes = list(zip(codes, [known[own], *(np.where(ok, known[i], end_id) for ok, i in zip(inside, back, strict=True))], strict=True))
        yield *codes, doc


def _hashed(x: np.ndarray, rows: int) -> np.ndarray:
    return ((x.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(rows)).astype("i8")


@dataclass
class Model:
    """What scoring needs; all arrays are bounded, whatever the corpus."""

    words: np.ndarray  # codes of held words, most frequent first
    log_count: np.ndarray  # log10(n + 1) of each
    leaf: np.ndarray  # leaf of each inside its class
    unit_class: np.ndarray  # class of each frequent word, then of each ending
    log_unit: np.ndarray  # log10 of the words of each leaf, counted, distinct and unseen
    rows: int
    one: np.ndarray  # weights of the classes
    two: np.ndarray  # weights of the leaves
    trained: int = 0
    distinct: int = 0

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code among the held words, -1 for others."""
        if not hasattr(self, "_index"):
            self._index = pd.Index(self.words)
        return self._index.get_indexer(codes)

    def places(self, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and leaf of each code; every word that could be has one."""
        unit = np.where((ids >= 0) & (ids < FREQUENT), ids, FREQUENT + (codes & 255))
        leaf = OWN + _hashed(codes, LEAVES - OWN)
        held = ids >= 0
        leaf[held] = self.leaf[ids[held]]
        return self.unit_class[unit], leaf

    def _row(self, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Frequent words have feature rows of their own, others share the other half."""
        half = self.rows // 2
        return np.where((ids >= 0) & (ids < half), ids, half + _hashed(codes, half))

    def features(self, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Active weight rows (tokens, features) of the class softmax and of the leaf softmax; words come as codes and ids."""
        n = self.rows
        a, b = self._row(*first), self._row(*second)
        both = _hashed(first[0].astype("u8") * np.uint64(31) + second[0].astype("u8"), n)
        one = np.stack([np.zeros_like(a), 1 + a, 1 + n + b, 1 + 2 * n + both], axis=1)
        two = np.stack([cls, CLASSES + _hashed(a * CLASSES + cls, 2 * n), CLASSES + 2 * n + _hashed(b * CLASSES + cls, n)], axis=1)
        return one, two

    def log_chances(self, word: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of class times leaf over the leaf's words, still without the word's own count; words come as codes and ids."""
        codes, ids = word
        cls, leaf = self.places(codes, ids)
        one, two = self.features(first, second, cls)
        chance = log_chance_of(self.one, one, cls) + log_chance_of(self.two, two, leaf)
        return chance / np.log(10) - self.log_unit[cls * LEAVES + leaf]


def _softmax_parts(weights: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of tokens, which they are, logits (sums of the active rows, less the largest), their exponentials and the sums of those."""
    for at in range(0, len(rows), 4096):  # parts that stay in a processor's cache
        part = rows[at : at + 4096]
        logits = np.take(weights, part[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            logits += np.take(weights, part[:, k], axis=0)
        logits -= logits.max(axis=1, keepdims=True)
        powers = np.exp(logits)
        yield slice(at, at + len(part)), logits, powers, powers.sum(axis=1, keepdims=True)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log chances of the softmax whose logits are sums of the active rows."""
    out = np.empty((len(rows), weights.shape[1]), weights.dtype)
    for own, logits, _, total in _softmax_parts(weights, rows):
        out[own] = logits - np.log(total)
    return out


def log_chance_of(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of :func:`log_softmax` each token's ``target``."""
    out = np.empty(len(rows), weights.dtype)
    for own, logits, _, total in _softmax_parts(weights, rows):
        out[own] = logits[np.arange(len(logits)), target[own]] - np.log(total[:, 0])
    return out


def run_sums(values: np.ndarray, source: np.ndarray, starts: np.ndarray, most: int = 16) -> np.ndarray:
    """Sums of the rows ``source`` of ``values`` over runs of ``source`` that begin at ``starts``: the j-th rows of all runs at once, long runs in pieces."""
    size = np.diff(starts, append=len(source))
    if size.max(initial=0) > most:
        pieces = -(-size // most)
        first = np.cumsum(pieces) - pieces
        place = np.arange(pieces.sum()) - np.repeat(first, pieces)
        parts = run_sums(values, source, np.repeat(starts, pieces) + most * place, most)
        return run_sums(parts, np.arange(len(parts)), first, most)
    order = np.argsort((most - size).astype("u1"), kind="stable")  # longest first
    begin, sums = starts[order], np.empty((len(starts), values.shape[1]), values.dtype)
    for j in range(size.max(initial=0)):
        some = begin[: np.count_nonzero(size > j)]
        if j:
            sums[: len(some)] += np.take(values, source[some + j], axis=0)
        else:
            np.take(values, source[some], axis=0, out=sums, mode="clip")
    out = np.empty_like(sums)
    out[order] = sums
    return out


def slopes(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(touched rows, how often, gradient of the summed log chance of ``target`` by each of them)."""
    n = len(target)
    # A row that is active for all tokens gets the plain sum, a value of its own behind the tokens'.
    common = [k for k in range(rows.shape[1]) if (rows[:, k] == rows[0, k]).all()]
    off = np.empty((n + len(common), weights.shape[1]), weights.dtype)
    for own, _, powers, total in _softmax_parts(weights, rows):
        np.divide(powers, -total, out=off[own])
    off[np.arange(n), target] += 1
    off[n:] = off[:n].sum(axis=0)
    others = [k for k in range(rows.shape[1]) if k not in common]
    flat = np.concatenate([*(rows[:, k] for k in others), rows[0, common]])
    source = np.concatenate([*[np.arange(n)] * len(others), np.arange(n, n + len(common))])
    order = np.argsort(flat.astype(np.min_scalar_type(len(weights))), kind="stable")  # 16 bits are sorted by radix
    flat, source = flat[order], source[order]
    starts = np.flatnonzero(np.diff(flat, prepend=-1))
    touched, count = flat[starts], np.diff(starts, append=len(flat))
    np.add.at(count, np.searchsorted(touched, rows[0, common]), n - 1)
    return touched, count, run_sums(off, source, starts)


def _updated(weights: np.ndarray, power: np.ndarray, met: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    touched, count, slope = slopes(weights, rows, target)
    slope /= np.sqrt(len(target))
    own = np.take(power, touched, axis=0)
    own += slope * slope
    power[touched] = own
    slope *= rate
    slope /= np.sqrt(own, out=own)
    slope += np.take(weights, touched, axis=0)
    weights[touched] = slope
    met[touched] += count


def word_counts(tokens: DataFrame) -> DataFrame:
    """(code, n) of all tokens; tasks add up their own first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        for batch in batches:
            own, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            codes, place = np.unique(np.concatenate([codes, own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(codes)).astype("i8")
            if len(codes) > 4 * CACHE_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])
                codes, counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    return tokens.select("tokens").mapInArrow(rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _summed(df: DataFrame, cells: int) -> np.ndarray:
    """Sums of (cell, n) as one array of ``cells``, a fixed number."""
    found = df.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(cells)
    out[found["cell"].to_numpy("i8")] = found["n"].to_numpy("f8")
    return out


def learn_classes(tokens: DataFrame, words: np.ndarray, seed: int = 7, turns: int = 20) -> np.ndarray:
    """Class of each unit (frequent word or ending): k-means of the square roots of what stands left and right of it, over all tokens. The end of a text is class 0 alone."""
    units, end, width = FREQUENT + ENDINGS, token_code(END), 2 * BUCKETS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = pd.Index(words), np.zeros(units * width, "i8")
        for batch in batches:
            for code, before, _, _ in _runs(batch.column(0), 1 << 18):
                ids = [index.get_indexer(x) for x in (code, before)]
                unit = [np.where((i >= 0) & (i < FREQUENT), i, FREQUENT + (x & 255)) for i, x in zip(ids, (code, before), strict=True)]
                bucket = [np.where(u < BUCKETS // 2, u, BUCKETS // 2 + (x & 255) % (BUCKETS // 2)) for u, x in zip(unit, (code, before), strict=True)]
                seen += np.bincount(unit[0] * width + bucket[1], minlength=len(seen))
                seen += np.bincount(unit[1] * width + BUCKETS + bucket[0], minlength=len(seen))
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], names=["cell", "n"])

    seen = _summed(tokens.select("tokens").mapInArrow(counted, "cell long, n long"), units * width).reshape(units, 2, BUCKETS)
    weight = np.sqrt(seen.sum(axis=(1, 2)))
    x = np.sqrt(seen / np.maximum(seen.sum(axis=2, keepdims=True), 1)).reshape(units, width)
    out = np.ones(units, "i8")
    live = np.flatnonzero(weight > 0)
    live = live[[not (u < len(words) and u < FREQUENT and words[u] == end) for u in live]]
    if len(live):
        rng, own = np.random.default_rng(seed), x[live]
        centres = own[rng.choice(len(live), min(CLASSES - 1, len(live)), replace=False, p=weight[live] / weight[live].sum())]
        for _ in range(turns):
            near = ((own**2).sum(axis=1)[:, None] - 2 * own @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            sums, mass = np.zeros_like(centres), np.zeros(len(centres))
            np.add.at(sums, near, own * weight[live, None])
            np.add.at(mass, near, weight[live])
            centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], centres)
        out[live] = 1 + near
    out[[u for u in range(min(len(words), FREQUENT)) if words[u] == end]] = 0
    return out


def train(tokens: DataFrame, held_words: int = HELD_WORDS, rounds: int = ROUNDS, rate: float = 0.1) -> tuple[Model, DataFrame]:
    """The model of a table of ``tokens`` and the table of counts (code, n). Only bounded arrays reach the driver."""
    counts = save(word_counts(tokens), "lm-counts")
    trained, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Frequent words are those above a quantile of the counts, which a sketch of bounded size gives.
    cut = counts.agg(F.percentile_approx("n", max(0.0, 1 - held_words / max(distinct, 1)), 100_000)).first()[0] or 0
    cut = 0 if distinct <= held_words else cut
    held = counts.where(F.col("n") > cut).toPandas().sort_values(["n", "code"], ascending=[False, True])
    words, n = held["code"].to_numpy("i8"), held["n"].to_numpy("f8")
    unit_class = learn_classes(tokens, words[:FREQUENT])
    rows = 1 << int(min(MOST_ROWS, max(8, np.ceil(log2(max(distinct, 1) / 256)))))
    model = Model(words, np.log10(n + 1), np.zeros(len(words), "i8"), unit_class, np.zeros(CLASSES * LEAVES), rows, np.zeros((1 + 3 * rows, CLASSES), "f4"), np.zeros((CLASSES + 3 * rows, LEAVES), "f4"), int(trained), int(distinct))
    model.leaf = OWN + _hashed(words, LEAVES - OWN)
    cls, _ = model.places(words, np.arange(len(words)))
    # Words come by falling frequency, so the place among those of a class is the rank in it.
    for c in range(CLASSES):
        own = np.flatnonzero(cls == c)[:OWN]
        model.leaf[own] = np.arange(len(own))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CLASSES * LEAVES), "i8")
        for batch in batches:
            codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            c, leaf = model.places(codes, model.ids(codes))
            for k, by in enumerate((n, None)):
                seen[k] += np.bincount(c * LEAVES + leaf, by, seen.shape[1]).astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(seen.size)), pa.array(seen.ravel())], names=["cell", "n"])

    seen = _summed(counts.mapInArrow(leaves, "cell long, n long"), 2 * CLASSES * LEAVES).reshape(2, CLASSES, LEAVES)
    model.log_unit = np.log10(seen.sum(axis=0) + 1).ravel()
    mass = seen[0] + 0.5
    model.one[0] = np.log(mass.sum(axis=1) / mass.sum())
    model.two[:CLASSES] = np.log(mass / mass.sum(axis=1, keepdims=True))
    tasks = max(1, -(-int(trained) // (rounds * TASK_TOKENS)))
    for turn in range(rounds if trained else 0):
        part = tokens.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn).select("tokens")
        shared = tokens.sparkSession.sparkContext.broadcast(model)

        def fitted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value
            weights = [start.one.copy(), start.two.copy()]
            power = [np.full(w.shape, 1e-4, "f4") for w in weights]
            met = [np.zeros(len(w), "i8") for w in weights]
            for batch in batches:
                for word, first, second, _ in _runs(batch.column(0), ids=start.ids):
                    cls, leaf = start.places(*word)
                    for k, (active, target) in enumerate(zip(start.features(first, second, cls), (cls, leaf), strict=True)):
                        _updated(weights[k], power[k], met[k], active, target, rate)
            for k in range(2):
                own = np.flatnonzero(met[k])
                for at in range(0, len(own), 4096):
                    few = own[at : at + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, LEAVES * len(few) + 1, LEAVES, dtype="i4")), pa.array(weights[k][few].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), k, "i4")), pa.array(few), pa.array(met[k][few].astype("f8")), lists], names=["level", "row", "met", "w"])

        mean = [(F.sum(F.get("w", F.lit(i)) * F.col("met")) / F.sum("met")).cast("float").alias(f"w{i}") for i in range(LEAVES)]
        got = part.coalesce(tasks).mapInArrow(fitted, "level int, row long, met double, w array<float>").groupBy("level", "row").agg(*mean).toPandas()
        for k, weights in enumerate((model.one, model.two)):
            own = got[got["level"] == k]
            weights[own["row"].to_numpy("i8")] = own.iloc[:, 2:].to_numpy("f4")
        shared.unpersist()
    return model, counts


def score(tokens: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of a table of ``tokens``.

    Tasks know the counts of held words; other words of a document are joined with the table of
    counts, so the vocabulary may grow without bound.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row, size = batch.column(0).to_numpy(), batch.num_rows
            known, logs, own = (np.zeros(size) for _ in range(3))
            rare = []
            for word, first, second, doc in _runs(batch.column(2), ids=model.ids):
                chance, (code, ids) = model.log_chances(word, first, second), word
                held = ids >= 0
                known += np.bincount(doc[held], minlength=size)
                logs += np.bincount(doc[held], model.log_count[ids[held]], size)
                own += np.bincount(doc, chance, size)
                d, c = doc[~held], code[~held]
                order = np.lexsort((c, d))
                d, c = d[order], c[order]
                first_of = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(d) else np.zeros(0, "i8")
                rare.append((d[first_of], c[first_of], np.diff(np.append(first_of, len(d)))))
            d, c, times = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, "i8"),) * 3
            pad = np.zeros(len(d))
            length = np.diff(batch.column(2).offsets.to_numpy())
            # A document's own row looks up no word: it counts none times.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, row[d]])),
                    pa.array(np.concatenate([row, c])),
                    pa.array(np.concatenate([np.zeros(size, "i8"), times])),
                    pa.concat_arrays([batch.column(1), pa.nulls(len(d), pa.int64())]),
                    pa.array(np.concatenate([length, pad]).astype("i8")),
                    pa.array(np.concatenate([known, pad]).astype("i8")),
                    pa.array(np.concatenate([logs, pad])),
                    pa.array(np.concatenate([own, pad])),
                ],
                names=["row", "code", "times", "doc_id", "n_tokens", "n_known", "logs", "own"],
            )

    told = tokens.select("row", "doc_id", "tokens").mapInArrow(rows, "row long, code long, times long, doc_id long, n_tokens long, n_known long, logs double, own double")
    joined = told.join(counts, "code", "left")
    seen = F.col("n").isNotNull()
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(seen, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.when(seen, F.col("times") * F.log10(F.col("n") + 1)).otherwise(0)).alias("logs"),
        F.sum("own").alias("own"),
    )
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.trained).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(log10(model.trained + model.distinct + 1))).alias("base_score"), (F.col("logs") + F.col("own")).alias("score"),
    )


def score_texts(docs: DataFrame, training: DataFrame, held_words: int = HELD_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text), learnt from the texts of ``training``.

    Counts, classes and weights cover all words of ``training``. Null texts are empty: one token,
    the end. Rows that repeat a document are scored one by one, other columns are left behind, no
    rows give none. Without training texts every word is the one unseen word of its leaf.
    """
    own = training if "doc_id" in training.columns else training.withColumn("doc_id", F.lit(None).cast("long"))
    model, counts = train(save(coded_texts(own), "lm-training"), held_words)
    return score(save(coded_texts(docs), "lm-tokens"), model, counts)


def op10_lm_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those not held out; texts are read once."""
    tokens = save(coded_texts(table(spark, sf_dir, "documents")), "lm-tokens").withColumn("held_out", held_out(F.col("doc_id"), 7))
    model, counts = train(tokens.where("not held_out"))
    return score(tokens, model, counts).withColumn("held_out", held_out(F.col("doc_id"), 7))
