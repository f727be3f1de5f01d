"""Repeated passages removed by difference-cover anchors (operator 11).

Anchors are runs of ANCHOR words hashed only where a word's place modulo PERIOD lies in COVER. The
differences of COVER are all residues, so two equal runs of WINDOW words, wherever they start, have
an anchor at the same place inside both. Anchors that two documents share are found first; they are
extended to the windows around them, and only those windows are compared whole.

Words travel as hashes, packed into arrays: one row for each block of documents and range of
hashes. A block sends a hash at most twice, with its smallest and its largest document, so a
passage that a third of all documents have costs a range two entries a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import unused
from ..spool import discard
from .common import WORD, save, table

#: Words of a window, of an anchor, and the difference cover: each residue of the period is a difference of two members.
WINDOW, ANCHOR, PERIOD, COVER = 13, 7, 7, (1, 2, 4)
#: Documents of a block; a text of so many characters is a block of its own. Text bytes for each range of hashes.
BLOCK, LONG, RANGE_BYTES = 1024, 65_536, 1 << 24
#: Words that a worker keeps hashes of, none longer than so many bytes; bytes that are cut into words at once.
KEPT_WORDS, KEPT_BYTES, PIECE = 400_000, 40, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Codes(dict):
    """XXH64 by word; frequent words are looked up."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        code = xxh64_intdigest(word, 42)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = code
        return code


#: Of this worker.
_codes = _Codes()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, so many bytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


def word_codes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text; null has none."""
    parts = [np.fromiter(map(_codes.__getitem__, words), "u8", len(words)) for words in pieces(text or b"")]
    return np.concatenate(parts) if parts else np.zeros(0, "u8")


def rolled(codes: np.ndarray, at: np.ndarray | slice, n: int, seed: int) -> np.ndarray:
    """Hashes of the ``n`` words from each of the places ``at``, in order; ``seed`` picks one of a family."""
    out = np.full(len(codes) if isinstance(at, slice) else len(at), seed, "u8")
    if isinstance(at, slice):
        out = out[: max(0, len(codes) - n + 1)]
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    for k in range(n):
        out ^= codes[k : k + len(out)] if isinstance(at, slice) else codes[at + k]
        out *= factor
        out ^= out >> np.uint64(29)
    return out


def anchor_places(n: int) -> np.ndarray:
    """Places of the anchors of ``n`` words."""
    if n < WINDOW:  # no window, so no anchor is needed
        return np.zeros(0, "i8")
    cycle = np.arange(0, n, PERIOD)[:, None] + np.array(COVER)
    return cycle.ravel()[cycle.ravel() <= n - ANCHOR]


def _grouped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row that each one is of."""
    lengths = column.value_lengths().to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)


def _joined(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array; one that has no chunks is empty."""
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _by_key(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A sort order by ``key``, where each key begins in it, and the values in that order."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else order
    return order, first, [v[order] for v in values]


def _lists(group: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The different values of ``group`` (in order) and, for each, lists of the values that belong to it."""
    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(group) else order
    ends = pa.array(np.r_[at, len(group)].astype("i4"))
    return group[order][at], [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in values]


def _texts(texts: pa.Array) -> Iterator[bytes | None]:
    for t in texts.cast(pa.binary()):
        yield t.as_py()


def _anchors(docs: DataFrame, doc_id: str, text: str, block: str, ranges: int) -> DataFrame:
    """(range, block, hash list, doc list): the anchors of each block, each with its smallest and its largest document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for at in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1) if len(blocks) else ():
                ids, found, owner = batch.column(1).slice(at[0], len(at)).to_pylist(), [], []
                for i, t in zip(ids, _texts(batch.column(2).slice(at[0], len(at))), strict=True):
                    if i is not None:
                        words = word_codes(t)
                        found.append(rolled(words, anchor_places(len(words)), ANCHOR, 0))
                        owner.append(np.full(len(found[-1]), i, "i8"))
                if not any(map(len, found)):
                    continue
                order, first, (key, doc) = _by_key(np.concatenate(found), np.concatenate(found), np.concatenate(owner))
                low, high, key = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), key[first]
                two = high > low
                key, doc = np.r_[key, key[two]], np.r_[low, high[two]]
                range_, lists = _lists((key % np.uint64(ranges)).astype("i4"), key.view("i8"), doc)
                yield pa.RecordBatch.from_arrays([pa.array(range_), pa.array(np.full(len(range_), blocks[at[0]])), *lists], names=["range", "block", "hash", "doc"])

    return docs.select(block, doc_id, text).mapInArrow(work, "range int, block long, hash array<long>, doc array<long>")


def _shared(rows: pa.Table) -> pa.Table:
    """Of one range: the hashes of each block that two different documents have."""
    key, row = _grouped(_joined(rows["hash"]))
    doc, _ = _grouped(_joined(rows["doc"]))
    block = _joined(rows["block"]).to_numpy()[row]
    order, first, (doc,) = _by_key(key, doc)
    size = np.diff(np.r_[first, len(key)])
    both = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), size) if len(key) else np.zeros(0, bool)
    places, lists = _lists(block[order][both], key[order][both])
    return pa.table([pa.array(places), *lists], names=["block", "hash"])


def _windows(ranges: int):  # noqa: ANN202
    """Work on a block: its windows around shared anchors, each with its smallest document and how far the largest is from it."""

    def work(docs: pa.Table, replies: pa.Table) -> pa.Table:
        shared, found = np.unique(_grouped(_joined(replies["hash"]))[0].view("u8")), []
        for i, t in zip(docs.column(1).to_pylist(), _texts(_joined(docs.column(2))), strict=True) if len(shared) else ():
            words = word_codes(t) if i is not None else np.zeros(0, "u8")
            at = anchor_places(len(words))
            own = rolled(words, at, ANCHOR, 0)
            at = at[shared[np.searchsorted(shared, own).clip(max=len(shared) - 1)] == own]
            if len(at):  # an anchor is inside the windows that start up to PERIOD - 1 places before it
                last = len(words) - WINDOW
                edge = np.zeros(last + 2, "i8")
                np.add.at(edge, np.maximum(at - (WINDOW - ANCHOR), 0).clip(max=last + 1), 1)
                np.add.at(edge, np.minimum(at, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                found.append((rolled(words, starts, WINDOW, 1), rolled(words, starts, WINDOW, 2), np.full(len(starts), i, "i8")))
        names = ["range", "block", "hash", "low", "span"]
        if not found:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3)], names=names)
        one, two, doc = (np.concatenate(a) for a in zip(*found, strict=True))
        range_ = (two % np.uint64(ranges)).astype("i4")
        order = np.lexsort((one, range_))
        one, range_, doc = one[order], range_[order], doc[order]
        first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (range_[1:] != range_[:-1])])
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        at, lists = _lists(range_[first], one[first].view("i8"), low, high - low)  # mostly zeros, which compress
        return pa.table([pa.array(at), pa.array(np.full(len(at), docs.column(0)[0].as_py())), *lists], names=names)

    return work


def _earlier(rows: pa.Table) -> pa.Table:
    """Of one range: the windows of each block that start in a smaller document than some of the block's, with the smallest of all."""
    key, row = _grouped(_joined(rows["hash"]))
    low, span = (_grouped(_joined(rows[c]))[0] for c in ("low", "span"))
    block = _joined(rows["block"]).to_numpy()[row]
    order, first, (low, high) = _by_key(key, low, low + span)
    least = np.repeat(np.minimum.reduceat(low, first), np.diff(np.r_[first, len(key)])) if len(key) else low
    wanted = least < high
    places, lists = _lists(block[order][wanted], key[order][wanted], least[wanted])
    return pa.table([pa.array(places), pa.array(np.full(len(places), rows["range"][0].as_py(), "i4")), *lists], names=["block", "range", "hash", "low"])


def _kept(names: list[str], doc_id: str, text: str, ranges: int):  # noqa: ANN202
    """Work on a block: texts without the words that its verdicts cover."""

    def work(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        key, row = _grouped(_joined(verdicts["hash"]))
        order, _, (least, range_) = _by_key(key.view("u8"), _grouped(_joined(verdicts["low"]))[0], _joined(verdicts["range"]).to_numpy()[row])
        key = key.view("u8")[order]
        texts, counts, gone = [], [], []
        for i, t in zip(docs[doc_id].to_pylist(), _texts(_joined(docs[text])), strict=True):
            cover = np.zeros(0, bool)
            if i is not None and len(key):
                words = word_codes(t)
                own = rolled(words, slice(None), WINDOW, 1)
                at = np.searchsorted(key, own).clip(max=len(key) - 1)
                hit = np.flatnonzero((key[at] == own) & (least[at] < i))
                hit = hit[rolled(words, hit, WINDOW, 2) % np.uint64(ranges) == range_[at[hit]].astype("u8")]
                edge = np.zeros(len(words) + 1, "i8")
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + WINDOW, -1)
                cover = np.cumsum(edge[:-1]) > 0
            kept, n = [], 0
            for words in pieces(t or b""):
                if len(cover):
                    kept += [w for w, c in zip(words, cover[n : n + len(words)].tolist(), strict=True) if not c]
                else:
                    kept += words
                n += len(words)
            texts.append(b" ".join(kept))
            counts.append(n)
            gone.append(int(cover.sum()))
        columns = {c: _joined(docs[c]) for c in docs.column_names} | {text: pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.table([*(columns[c] for c in names), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_words", "n_removed"])

    return work


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, others) with the kept words of each text, joined by one space, and n_words and n_removed.

    A word goes if a window of WINDOW words of one document covers it whose words also start, in
    this order, in a document of smaller doc_id; windows are those of the input. Null ids are
    neither smaller nor larger, so such rows keep all words and take none from others; rows of
    equal ids take none from each other. A null text has no words; texts below WINDOW words keep
    theirs. Columns named n_words or n_removed are replaced. No rows give no rows.
    """
    docs = docs.drop("n_words", "n_removed")
    names, row, block = docs.columns, unused("row_number_of_its_own", docs), unused("block_of_rows", docs)
    number = F.monotonically_increasing_id()
    alone = F.coalesce(F.length("text") >= LONG, F.lit(False))
    numbered = docs.withColumn(row, number).withColumn(block, F.when(alone, 2 * F.col(row) + 1).otherwise(F.expr(f"2 * (`{row}` div {BLOCK})")))
    texts = save(numbered.drop(row), "repeats-texts", "zstd")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)

    anchors = _anchors(texts, "doc_id", "text", block, ranges)
    shared = save(anchors.groupBy("range").applyInArrow(_shared, "block long, hash array<long>"), "repeats-anchors")
    slim = texts.select(block, "doc_id", "text").groupBy(block)
    windows = slim.cogroup(shared.groupBy("block")).applyInArrow(_windows(ranges), "range int, block long, hash array<long>, low array<long>, span array<long>")
    verdicts = save(windows.groupBy("range").applyInArrow(_earlier, "block long, range int, hash array<long>, low array<long>"), "repeats-windows")
    discard(shared)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long"
    return texts.groupBy(block).cogroup(verdicts.groupBy("block")).applyInArrow(_kept(names, "doc_id", "text", ranges), schema)


def op11_repeats_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed, and the digest of what is kept."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{WORD.replace("^", "")}'), lambda x: x != '') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
), low AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
hit AS (
  SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, i FROM g JOIN low USING (s) WHERE least < doc_id), range({WINDOW}) t(k)
), each AS (
  SELECT doc_id, place, words[place] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM w)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM each ANTI JOIN hit USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
