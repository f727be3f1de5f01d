"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups (operator 5)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

END_ID = 2
#: Entries of a worker's word cache, and their bytes; it is emptied beyond either.
CACHE_WORDS, CACHE_BYTES = 600_000, 1 << 25
#: Documents of a packing group on average. A group is packed in one task, so this bounds its memory.
GROUP_ROWS = 4096


#: Marks that, at the end of a word of letters, are a piece of their own for the tokenizer.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordCoder:
    """Token ids of words, kept by word in one flat array; for vocabularies whose pieces hold no white space.

    A word of Latin letters is one piece to the tokenizer, so its model is asked for it directly,
    in the model's spelling of bytes; marks behind it are another piece. Other words go through
    the whole tokenizer. A worker keeps a coder for each tokenizer file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Bytes of printable characters stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.spelling = {b: 256 + k for k, b in enumerate(rest)}
        self.tails: dict[bytes, list[int]] = {}
        self.empty()

    def empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.start, self.length = np.zeros(0, "<u4"), np.zeros(0, "i8"), np.zeros(0, "i8")

    def word(self, word: bytes) -> list[int]:
        letters = word.rstrip(TAIL)
        if letters.isalpha():
            found = self.model.tokenize(letters.decode().lower())
        else:
            lower = letters.decode("utf-8", "replace").lower()
            if not lower.isalpha() or max(lower) >= "\u0250":
                return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            found = self.model.tokenize(lower.encode().decode("latin-1").translate(self.spelling))
        ids = [t.id for t in found]
        if len(letters) < len(word):
            tail = word[len(letters) :]
            if tail not in self.tails:
                self.tails[tail] = self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids
            ids += self.tails[tail]
        return ids

    def encode(self, texts: list[list[bytes]]) -> Iterator[np.ndarray]:
        """Ids of each text, given as its words."""
        words = list(chain.from_iterable(texts))
        if len(self.known) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.empty()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), "i8", len(words))
        ids: list[int] = []
        starts: list[int] = []
        known, first = self.known, len(self.start)
        for i in np.flatnonzero(at < 0).tolist():
            w = words[i]
            if w not in known:
                known[w] = first + len(starts)
                self.bytes += len(w)
                starts.append(len(ids))
                ids += self.word(w)
            at[i] = known[w]
        if starts:
            begin = np.array(starts)
            self.start = np.concatenate([self.start, len(self.ids) + begin])
            self.length = np.concatenate([self.length, np.diff(begin, append=len(ids))])
            self.ids = np.concatenate([self.ids, np.array(ids, "<u4")])
        length = self.length[at]
        ends = length.cumsum()
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - length), length)]
        begin = 0
        for last in np.concatenate([[0], ends])[np.cumsum(list(map(len, texts)))].tolist():
            yield flat[begin:last]
            begin = last


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode(texts: list[bytes | None], path: str) -> Iterator[np.ndarray]:
    """Token ids of each UTF-8 text, without special tokens; texts are cut at ASCII white space."""
    for start in range(0, len(texts), 512):
        # Special tokens are spelled in lower case, so only texts without their mark are lower-cased first.
        yield from coder(path).encode([(t if b"<|" in t else t.lower()).split() for t in (x or b"" for x in texts[start : start + 512])])


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row for each run of at most ``length`` token ids of a document (columns doc_id, text).

    Columns doc_id, start, length, ids_crc32, doc_tokens, and ids where ``keep_ids``. A document
    ends with id 2, so an empty or null text is one piece of one id. Repeated rows give repeated pieces.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for key, ids in zip(keys, encode(texts, tokenizer_path), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), length):
                    run = ids[at : at + length]
                    rows.append((key, at, len(run), zlib.crc32(run.tobytes()), len(ids), *([run.astype("i8").tolist()] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.list_(pa.int64()) if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))] if rows
                else [pa.array([], pa.list_(pa.int64()) if i == 5 else pa.int64()) for i in range(5 + keep_ids)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(pieces, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, largest first, each into the leftmost bin with room.

    The tournament tree holds the free room of the bins at its leaves and at each inner node the
    larger of its two children; one walk from the root finds the leftmost bin with room.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    where, offset = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size, node = int(sizes[i]), 1
        if size > capacity:
            raise ValueError(f"a piece of {size} does not fit into {capacity}")
        while node < leaves:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        where[i], offset[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return where, offset


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS, seed: int = 42) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with the sequence and the offset of each.

    Pieces are dealt to random groups by a hash of all their columns and, of rows that repeat, their
    number, about ``group_rows`` to a group whatever the documents, and each group is packed on its
    own; so the same pieces give the same sequences, however files are split. ``sequence_id`` is
    group * 2**32 + bin. Full pieces are sequences of their own. ``pieces`` is
    read twice. No rows give no rows; a piece longer than ``capacity`` is an error.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // group_rows))
    names = pieces.columns
    order = ["length", *(c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in names)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=[c != "length" for c in order], kind="stable", ignore_index=True)
        where, offset = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows[names].assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    own = F.xxhash64(*names, F.lit(seed))
    keyed = pieces.withColumn("_own", own).withColumn("_copy", F.row_number().over(Window.partitionBy("_own").orderBy(*names)))
    keyed = keyed.withColumn("_group", F.pmod(F.xxhash64("_own", "_copy"), F.lit(groups))).select(*names, "_group")
    return keyed.groupBy("_group").applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text) cut into pieces of token ids and packed; only the pieces' numbers are shuffled."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(save(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op5_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
