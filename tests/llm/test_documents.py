"""Operators on documents: awkward rows, empty tables, and brute force on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import AWKWARD, LONG, Components

from skyframe.llm.common import save, word_count
from skyframe.llm.mixing import mix, mix_digest, mix_documents, schedule, source_targets
from skyframe.llm.packing import coder, encode, first_fit_decreasing, pack, pack_documents, token_pieces
from skyframe.llm.quality import FEATURES, features, fit_trees, keep_good, score_quality
from skyframe.llm.sharding import permuted, shard_rows
from skyframe.llm.simhash import RADIUS, covering_masks, fingerprint, keep_first, near_pairs, simhash_components

from pyspark.sql import functions as F
import public_tokenizers

PATH = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_count(spark, awkward):
    for r in awkward.select("text", word_count(F.col("text")).alias("n")).collect():
        assert r.n == len(words(r.text))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40, 97, 5000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n)) and (n < 40 or got != sorted(got))


def test_shards(spark, awkward, no_docs):
    rows = shard_rows(awkward.withColumn("shard", F.lit("own")), ["doc_id", "text"], 4).collect()
    assert sorted(r.position for r in rows) == list(range(len(AWKWARD)))
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    again = shard_rows(awkward.repartition(7), ["doc_id", "text"], 4).collect()
    key = lambda r: (r.doc_id or 0, r.text or "", r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert shard_rows(no_docs, ["doc_id"], 4).count() == 0


def test_mix(spark, awkward, no_docs):
    digest = mix_digest(awkward)
    targets = {r.source: r for r in source_targets(digest).collect()}
    sizes = Counter()
    for d in AWKWARD:
        sizes[d[3]] += len(words(d[1]))
    assert {s: r.source_size for s, r in targets.items()} == dict(sizes)
    assert list(sorted(targets, key=lambda s: targets[s].source_rank)) == ["a", "b", "c", None]
    assert all(r.target <= 2 * r.source_size for r in targets.values())
    assert sum(r.target for r in targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    known = source_targets(digest)
    pieces = mix(digest, known, schedule(known, 64), 64).toPandas()
    assert pieces.row.nunique() == len(AWKWARD)
    taken = pieces.groupby("row").agg(taken=("taken", "sum"), size=("size", "first"))
    assert (taken.taken <= 2 * taken["size"]).all()
    by_source = pieces.groupby("source", dropna=False).taken.sum()
    # Whole blocks: a source ends at most two of them from its target, and below its cap.
    assert all(abs(by_source[s] - r.target) <= 128 and by_source[s] <= 2 * r.source_size for s, r in targets.items() if s is not None)
    empty = source_targets(mix_digest(no_docs))
    assert mix(mix_digest(no_docs), empty, schedule(empty, 64), 64).count() == 0
    assert mix_documents(no_docs).count() == 0 and mix_documents(awkward).columns == awkward.columns


def test_the_schedule_decides_what_is_taken(spark):
    rows = [(i, f"s{i % 3}", 40 + i % 50) for i in range(600)]
    digest = save(spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, source string, size long, row long"), "digest")
    known = source_targets(digest)
    slots = save(schedule(known, 64), "slots")
    whole = mix(digest, known, slots, 64).toPandas()
    targets = {r.source: r.target for r in known.collect()}
    sums = whole.groupby("source").taken.sum()
    assert all(abs(sums[s] - t) <= 128 for s, t in targets.items())
    # Any beginning of the mix is near its weights, as slots are dealt by low discrepancy.
    ranked = slots.join(known, "source_rank").toPandas()
    total = sum(targets.values())
    for n in (10, 50, 200):
        part = ranked[ranked.slot < n].groupby("source").size()
        assert all(abs(part.get(s, 0) - n * t / total) <= 2 for s, t in targets.items()), n
    # Without the schedule nothing is taken; with half of its slots, half; in another order, at other slots.
    none = mix(digest, known, slots.limit(0), 64).toPandas()
    assert len(none) == 600 and none.taken.sum() == 0 and none.first_slot.isna().all()
    some = mix(digest, known, slots.where("block < 20"), 64).toPandas()
    assert (some.groupby("source").taken.sum() == 20 * 64).all()
    other = mix(digest, known, slots.withColumn("slot", F.lit(10**6) - F.col("slot")), 64).toPandas()
    assert (other.first_slot.dropna() > 10**6 - len(ranked) - 1).all()
    # Slots and blocks of every document against a loop over the stream.
    import hashlib

    slot = {(r.source, r.block): r.slot for r in ranked.itertuples()}
    got = {(int(r["row"]), int(r["pass"])): (int(r["taken"]), r["first_slot"], r["last_slot"]) for _, r in whole.iterrows() if r["taken"]}
    want = {}
    for s in targets:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"{r[0]}:42".encode()).hexdigest())
        size, at = sum(r[2] for r in own), 0
        end = min(2 * size, 64 * sum(k[0] == s for k in slot), int(targets[s]))
        for turn in (0, 1):
            for i, _, n in own:
                if taken := max(0, min(at + n, end) - at):
                    want[i, turn] = (taken, slot[s, at // 64], slot[s, (at + taken - 1) // 64])
                at += n
    assert got == want


def test_tiny_sources_end_at_their_targets(spark):
    from skyframe.llm.mixing import scheduled_mix

    rows = [(i, " ".join(["w"] * 20), s) for i, s in enumerate("abc")] + [(None, "x " * (i % 5), "big") for i in range(400)]
    docs = spark.createDataFrame(rows[:3], "doc_id long, text string, source string")
    out = scheduled_mix(mix_digest(docs)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source: r.taken for r in out} == {r.source: int(r.target) for r in out} and [int(r.target) for r in sorted(out)] == [40, 33, 16]
    # Null ids, a hot bucket, are mixed in the same order whatever the partitions.
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((str(r.doc_id), r["size"], r.taken, r["pass"]) for r in scheduled_mix(mix_digest(docs.repartition(n))).select("doc_id", "size", "taken", "pass").collect()) for n in (1, 7))
    assert one == two and sum(t for _, _, t, _ in one) > 0


def test_packing_is_the_same_however_files_are_split(spark):
    from skyframe.llm.packing import pack

    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(3), rng.choice([5, 900, 2000, 4096]), rng.randrange(4), 7) for _ in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    one, two = (sorted(map(str, pack(df.repartition(n), 4096, 50).collect())) for n in (1, 6))
    assert one == two and len(one) == 500


def test_mixed_documents_come_in_slot_order_under_any_names(spark, awkward):
    docs = awkward.withColumnsRenamed({"slot": "mix_row", "row": "mix_slot", "word": "hash", "x": "total_of_bucket"})
    out = mix_documents(docs)
    assert out.columns == docs.columns and {r.mix_row for r in out.collect()} == {"s"}
    assert shard_rows(awkward.withColumnRenamed("x", "one_each").withColumnRenamed("word", "bucket_of_key"), ["doc_id", "text"], 3).where("one_each = 'x' and bucket_of_key = 'w'").count() == len(AWKWARD)


def test_coder_is_the_tokenizer():
    tokenizer = coder(PATH).tokenizer
    texts = [d[1] or "" for d in AWKWARD] + ["don't stop, it's I'LL we've", "İstanbul ΑΣ. Σ, ẍy ≯ a…, …, 12a3 foo_bar a b ﬁ ß. Straße! éa", "naïve|| a.b.c,, ... '' 'tis'", "İ ǅ ŉ <|ENDOFTEXT|>"]
    for text, ids in zip(texts, encode([t.encode() for t in texts], PATH), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def test_first_fit_decreasing_against_a_scan():
    sizes = np.random.default_rng(3).integers(1, 100, 300)
    where, offset = first_fit_decreasing(sizes, 100)
    bins = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
        if b == len(bins):
            bins.append(0)
        assert (where[i], offset[i]) == (b, bins[b])
        bins[b] += sizes[i]


def test_packing(spark, awkward, no_docs):
    rows = pack_documents(awkward, PATH, 256).toPandas()
    assert len(rows.groupby(["doc_id", "start"], dropna=False)) <= len(rows)
    assert rows.length.sum() == sum(len(i) + 1 for i in encode([(d[1] or "").encode() for d in AWKWARD], PATH))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    ids = next(encode([LONG.encode()], PATH)).tolist() + [2]
    piece = rows[(rows.doc_id == 6) & (rows.start == 256)].iloc[0]
    assert piece.ids_crc32 == zlib.crc32(np.array(ids[256:512], "<u4").tobytes()) and piece.doc_tokens == len(ids)
    kept = token_pieces(awkward.where("doc_id = 8"), PATH, keep_ids=True).first()
    assert kept.ids[-1] == 2 and kept.length == len(kept.ids)
    assert pack_documents(no_docs, PATH).count() == 0
    assert pack(token_pieces(awkward, PATH, 64), 64, group_rows=3).count() > 0


def test_fingerprint_is_the_majority():
    for text in (None, "", "A b", LONG):
        w = [x.lower() for x in words(text)]
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert fingerprint(text and text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks_cover():
    masks = covering_masks()
    rng = np.random.default_rng(4)
    for _ in range(3000):
        off = sum(1 << int(b) for b in rng.choice(64, RADIUS, replace=False))
        assert any(m & off == 0 for m in masks)


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype="u8")
    fps = set(map(int, base))
    for b in map(int, base[:12]):
        for _ in range(30):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 7)), replace=False)))
    fps = sorted(fps)
    brute, found = Components(fps), Components(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= RADIUS:
                brute.join(a, b)
    for r in near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), block=16).collect():
        assert (r.u ^ r.v).bit_count() <= RADIUS
        found.join(r.u, r.v)
    assert [brute.find(f) for f in fps] == [found.find(f) for f in fps]


def test_simhash_components(spark, awkward, no_docs):
    rows = simhash_components(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[2] == 1 and by_id[4] == by_id[5] == 3 and by_id[7] == 6
    assert simhash_components(no_docs).count() == 0 and keep_first(no_docs).count() == 0
    kept = keep_first(awkward)
    assert kept.columns == awkward.columns and {1, 3, 6} <= {r.doc_id for r in kept.collect()} and not kept.where("doc_id in (2, 4, 5, 7)").count()


def test_trees_learn_and_go_without_labels():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 5)).astype("f4")
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype("f8")
    model = fit_trees(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert fit_trees(x[:0], y[:0]).score(x[:3]).min() > 0.99
    assert fit_trees(x[:9], np.zeros(9)).score(x[:3]).max() < 0.2


def test_quality(spark, awkward, no_docs):
    assert features(b"") == features(None) == [0.0] * len(FEATURES)
    assert len(features(LONG.encode())) == len(FEATURES)
    labels = spark.createDataFrame([(1, 1), (2, 1), (10, 0), (10, None), (99, 0)], "doc_id long, quality int")
    rows = score_quality(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert keep_good(awkward, none).count() == len(AWKWARD) and keep_good(awkward, none).columns == awkward.columns
    assert score_quality(no_docs, labels).count() == 0


def test_stages_decide_by_row(spark, awkward):
    a, b = " ".join(AWKWARD[0][1].split()[:18]), "quite another text about boats that lie in the harbour of a town far to the north of here"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t), *"swrxk") for i, t in rows], awkward.schema)
    kept = keep_first(make([(3, a), (3, a), (5, a), (5, b), (9, b), (None, a), (None, "no id"), (None, "no id")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "no id"), (3, a), (5, b)]

    good, bad = [f"{a} {i}" for i in range(60)], [f"$$$ !!! ### {i}" for i in range(60)]
    docs = make([(i, t) for i, t in enumerate(good + bad)] + [(500, a), (500, "$$$ !!! ### 7"), (None, "$$$ !!! ### 8"), (None, a)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    left = [(r.doc_id, r.text) for r in keep_good(docs, labels).collect() if r.doc_id is None or r.doc_id == 500]
    assert sorted(left, key=str) == sorted([(500, a), (None, a)], key=str)


def test_shards_of_all_documents_against_python(spark):
    """The query's sizes and checksums, and the permutation by Python's own arithmetic over the row numbers it reports."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from skyframe.llm.sharding import op2_shard_feistel

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op2_shard_feistel(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode())) for r in rows)
    assert sorted(r.row_number for r in rows) == sorted(r.position for r in rows) == list(range(len(rows)))
    assert all((r.shard, r.slot) == (r.position % 40, r.position // 40) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    n, seed = len(rows), 42
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    half = {(x, r): h for x, r, h in spark.range(max(a, b)).select("id", F.explode(F.array(*map(F.lit, range(6)))).alias("r")).select("id", "r", F.xxhash64("id", "r", F.lit(seed))).collect()}

    def walk(x):
        while True:
            left, right = divmod(x, b)
            for r in range(6):
                if r % 2 == 0:
                    left = (left + half[right, r]) % a
                else:
                    right = (right + half[left, r]) % b
            x = left * b + right
            if x < n:
                return x

    assert {r.row_number: r.position for r in rows} == {i: walk(i) for i in range(n)}


def brute_features(text):
    t = text.encode()
    ws, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
    upper = sum(65 <= c <= 90 for c in t)
    return {
        "words": np.log1p(len(ws)), "lines": np.log1p(len(lines)), "upper": upper / len(t), "distinct_words": len(set(ws)) / len(ws), "top_word": max(map(ws.count, ws)) / len(ws),
        "distinct_trigrams": len({tuple(ws[i : i + 3]) for i in range(len(ws) - 2)}) / (len(ws) - 2), "short_words": sum(len(w) <= 3 for w in ws) / len(ws), "distinct_lines": len(set(lines)) / len(lines),
        "repeated_line_bytes": sum(len(x) for i, x in enumerate(lines) if x in lines[:i]) / len(t), "capital_words": sum(65 <= w[0] <= 90 for w in ws) / len(ws), "upper_words": sum(w.isupper() for w in ws) / len(ws),
    }


def test_statistics_and_trees_against_plain_walks():
    for text in (AWKWARD[0][1], "One TWO two\nOne TWO two\n\n a b!! é", LONG[:3000]):
        got = dict(zip(FEATURES, features(text.encode()), strict=True))
        for name, want in brute_features(text).items():
            assert got[name] == pytest.approx(want), name
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 4)).astype("f4")
    model = fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype("f8"), trees=7, depth=3)
    for row, score in zip(x[:100], model.score(x[:100]), strict=True):
        total = model.prior
        for t in range(7):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.leaf[t, node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
