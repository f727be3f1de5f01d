"""Personal data by bootstrapped contextual extraction (operator 8).

Seeds are what strict patterns find. The one to three tokens before a seed and the one or two
behind it are lexical patterns; what stands in the same place elsewhere and is loosely of such a
form, or just any token of several digits, is an instance of the pattern. Spark scores the graph of
patterns and instances in rounds: a pattern by how much of what it introduces, of all its
occurrences in the corpus, is believed in, an instance by the patterns that introduce it. Instances
of high-confidence patterns are spans that the strict patterns missed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

KINDS = ("email", "ip", "card", "phone")
#: A pattern's least number of different instances, the confidence that patterns and instances need, and rounds of scoring.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: The form of candidates that look like no kind. Bits of the filter of patterns that tasks hold, whatever their number, and entries of a task's counter before it is emptied.
OTHER, FILTER_BITS, COUNTER = -1, 1 << 23, 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The place before keeps long runs of digits from being tried at each of them; a match never ends inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Loose forms: an address with its signs spelled out, parted or without a dot; groups of hex or digits; card-like digits; phone-like digits.
_LOOSE = {
    0: re.compile(r"(?i)(?<![\w.@%+-])[a-z0-9][a-z0-9._%+-]*(?: ?[(\[{<]at[)\]}>] ?| at |_at_|@)[a-z0-9-]+(?:(?: ?[(\[{<]dot[)\]}>] ?| dot |_dot_|\.)[a-z0-9-]+)*(?![\w@])"),
    1: re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:.])|(?<![\w.])[0-9]{1,3}(?:(?:[.,]|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![\w.])"),
    2: re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ ./_-]?[0-9]{2,7}){2,4}(?![\w@])"),
    3: re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){1,4}(?![\w@])"),
    OTHER: re.compile(r"(?<![\w*#/-])[A-Za-z_*#/-]*+[0-9][\w*#/.-]*(?<=\w)"),
}
#: One of these is in every text with a loose address.
_AT = ("@", "at)", "at]", "at}", "at>", " at ", "_at_")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_DIGITS = str.maketrans("123456789", "000000000")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from each @ outwards, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strict matches in a text, in this order; of each kind leftmost and not overlapping, those that fail a test dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[str]:
    """Words and marks of a text in lower case, digits as 0."""
    return _TOKEN.findall(text.lower().translate(_DIGITS))


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The one to three tokens before a span, marked <, and the one or two behind it, marked >; a glued sign is a token like any other."""
    reach = 64
    while len(before := tokens(text[max(0, start - reach) : start])) < 4 and start > reach:
        reach *= 2
    reach = 64
    while len(behind := tokens(text[end : end + reach])) < 3 and end + reach < len(text):
        reach *= 2
    return ["<" + " ".join(before[-k:]) for k in (1, 2, 3) if len(before) >= k] + [">" + " ".join(behind[:k]) for k in (1, 2) if len(behind) >= k]


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(form, start, end) of candidates beside the strict spans and each other: loose forms of the kinds, then any token of four digits or more."""
    taken = bytearray(len(text))
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    low = text.lower()
    for form, pattern in _LOOSE.items():
        if form == 0 and not any(x in low for x in _AT):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if form == 0 and " at " in m[0].lower() and "." not in m[0] and " dot " not in m[0].lower():
                continue
            if form == 3 and not 7 <= sum(map(str.isdigit, m[0])) <= 15:
                continue
            if form == OTHER and (b - a < 6 or sum(map(str.isdigit, m[0])) < 4):
                continue
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                yield form, a, b


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email .. n_phone, base (the strict spans), and ``seen``: (form, start, end, instance, patterns, seed) of seeds and candidates.

    Texts are whole; null counts as empty. Spans count code points, ends exclusive. ``form`` is the
    number of a kind, or OTHER.
    """
    seen_type = pa.list_(pa.struct([("form", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                counts, bases, seen = [], [], []
                for value in batch.column(1):
                    text = value.as_py() or ""
                    base = base_spans(text)
                    counts.append(np.bincount([k for _, k, _ in base], minlength=4))
                    bases.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                    found = [(k, a, b, True) for a, k, b in base] + [(k, a, b, False) for k, a, b in loose_spans(text, base)]
                    seen.append([{"form": k, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": _patterns(text, a, b), "seed": s} for k, a, b, s in found])
                by_kind = np.array(counts, "i8").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(by_kind[:, k]) for k in range(4)), pa.array(bases, pa.string()), pa.array(seen, seen_type)],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
        "seen array<struct<form:int,start:bigint,end:bigint,instance:string,patterns:array<string>,seed:boolean>>",
    )


def _bits(grams: Iterator[str]) -> np.ndarray:
    return np.fromiter((crc32(g.encode()) % FILTER_BITS for g in grams), "i8")


def occurrences(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, total): how often each sequence of tokens in ``grams`` (distinct) occurs in the texts, in one pass whatever their number.

    Tasks hold a filter of fixed size of the sequences and their beginnings, which lets a few
    others through; the join with ``grams`` leaves them out.
    """
    wanted = np.zeros(FILTER_BITS // 8, "u1")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            begins = {" ".join(g.split(" ")[:k]) for g in own for k in (1, 2)}
            found = np.unique(np.concatenate([_bits(own), _bits(begins)]))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["bit"])

    filled = grams.select("gram").mapInArrow(places, "bit long").groupBy(F.expr("bit div 8 AS byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 AS int))) AS bits"))
    for r in filled.toLocalIterator():
        wanted[r.byte] = r.bits
    kept = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = np.unpackbits(kept.value, bitorder="little"), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                numbers: defaultdict = defaultdict()
                numbers.default_factory = numbers.__len__
                parts = []
                for own in map(tokens, (x or "" for x in batch.column(0).slice(at, 500).to_pylist())):
                    parts += [np.fromiter(map(numbers.__getitem__, own), "i8", len(own)), np.array([-1, -1, -1])]
                ids, words = np.concatenate(parts), list(numbers)
                sequences = words
                # Each step lengthens the sequences that are wanted so far, or begin a wanted one, by a token.
                codes, ends = ids[ids >= 0], np.flatnonzero(ids >= 0)
                for length in (1, 2, 3):
                    n = np.bincount(codes, minlength=len(sequences)).tolist()
                    ok = wanted[_bits(sequences)] == 1
                    for k in np.flatnonzero(ok).tolist():
                        counts[sequences[k]] += n[k]
                    if length < 3:
                        on = ok[codes] & (ids[ends + 1] >= 0)
                        codes, ends = codes[on], ends[on] + 1
                        both, codes = np.unique(codes * len(numbers) + ids[ends], return_inverse=True)
                        sequences = [f"{sequences[i]} {words[j]}" for i, j in zip((both // max(len(numbers), 1)).tolist(), (both % max(len(numbers), 1)).tolist(), strict=True)]
                if len(counts) > COUNTER:
                    yield told()
                    counts.clear()
        yield told()

    found = docs.select("text").mapInArrow(rows, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("total"))
    return found.join(grams.select("gram"), "gram", "left_semi")


def bootstrap(docs: DataFrame, extracted: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(form, instance, kind) of the candidates that high-confidence patterns introduce.

    A pattern of fewer than ``support`` different instances of a kind says nothing. Its confidence
    for the kind is the sum of the belief in its occurrences over all its occurrences in the corpus
    plus one; belief in a seed is 1, in another instance the confidence that not all of its
    patterns are wrong about it (1 - the product of doubts), from 0 at the start. Later rounds so
    learn patterns from instances first found by earlier ones. A candidate of no form belongs to
    the kind that its patterns speak for most.
    """
    each = extracted.select(F.explode("seen").alias("s")).select("s.form", "s.instance", "s.seed", F.explode("s.patterns").alias("pattern"))
    links = save(each.groupBy("form", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-links")
    strong = links.where(F.col("form") != OTHER).groupBy(F.col("form").alias("kind"), "pattern").agg(F.count("*").alias("instances"))
    strong = save(strong.where(F.col("instances") >= support).select("kind", "pattern"), "pii-patterns")
    graph = links.join(strong, "pattern").where((F.col("form") == F.col("kind")) | (F.col("form") == OTHER))
    # Patterns that introduce nothing but seeds need no score.
    open_ = graph.where("not seed").select("kind", "pattern").distinct()
    graph = save(graph.join(open_, ["kind", "pattern"], "left_semi").withColumn("gram", F.expr("substring(pattern, 2)")), "pii-open")
    none = links.select("form", "instance", F.lit(0).alias("kind")).limit(0)
    if not graph.limit(1).count():
        return none
    totals = occurrences(docs, save(graph.select("gram").distinct(), "pii-grams"))
    graph = save(graph.join(totals, "gram"), "pii-graph")
    seeds = graph.where("seed").select("kind", "form", "instance", F.lit(1.0).alias("belief")).distinct()
    belief, found = seeds, none
    for _ in range(rounds):
        believed = graph.join(belief, ["kind", "form", "instance"], "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
        trust = believed.groupBy("kind", "pattern").agg((F.sum(F.col("belief") * F.col("n")) / (F.greatest(F.max("total"), F.sum("n")) + 1)).alias("trust"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        new = graph.where("not seed").join(trust, ["kind", "pattern"]).groupBy("kind", "form", "instance").agg((1 - F.exp(doubt)).alias("belief"), F.max("trust").alias("trust"))
        new = save(new, "pii-belief")
        belief = seeds.union(new.select("kind", "form", "instance", "belief"))
        found = new.where((F.col("trust") >= confidence) & (F.col("belief") >= confidence))
    best = F.max(F.struct("trust", "belief", (-F.col("kind")).alias("kind")))
    return found.groupBy("form", "instance").agg((-best["kind"]).alias("kind"))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the counts of strict spans, ``base`` and ``spans`` of every row of ``docs`` (doc_id, text).

    ``spans`` adds to the strict ones the candidates that bootstrapping accepts; strict spans
    always stay, and candidates never overlap them or each other. Rows that repeat a document
    are found each; null and empty texts have no spans; a null doc_id stays null; other columns are
    left behind; an empty table gives no rows.
    """
    row = extract(docs).withColumn("row", F.monotonically_increasing_id())
    extracted = save(row, "pii-extracted")
    accepted = bootstrap(docs, extracted, support, confidence)
    loose = extracted.select("row", F.explode("seen").alias("s")).where("not s.seed").select("row", "s.form", "s.start", "s.end", "s.instance")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    added = loose.join(accepted, ["form", "instance"]).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))).alias("added")
    )
    strict = F.transform(
        F.filter("seen", lambda s: s["seed"]),
        lambda s: F.struct(
            s["start"].alias("start"), s["form"].alias("kind"),
            F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["form"] + 1), s["start"].cast("string"), s["end"].cast("string")).alias("span"),
        ),
    )
    both = extracted.join(added, "row", "left").withColumn("spans", F.array_sort(F.concat(strict, F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:int,span:string>>")))))
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.array_join(F.col("spans.span"), ",").alias("spans"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
