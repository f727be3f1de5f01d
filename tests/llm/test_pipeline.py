import os

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    from skyframe.llm.common import save
    from skyframe.spool import saved_tables, sweep

    sweep(spark)
    before = set(saved_tables(spark))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, DIR), name)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        assert name == "packing" or docs.columns == columns
        ids = left
    run = corpus_pipeline.run(spark, DIR)
    assert run.drop("sequence_id", "offset").exceptAll(docs.drop("sequence_id", "offset")).count() == 0 and run.count() == docs.count()
    # What is left are the two results that are still held.
    sweep(spark)
    assert set(saved_tables(spark)) - before == {docs.saved_path, run.saved_path}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_keep_what_others_still_read(spark):
    """A result outlives later stages, also by way of a frame made from it, and two pipelines in threads agree."""
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, DIR)
    few = corpus_pipeline.near_duplicates(spark, docs, DIR).where("doc_id >= 0")
    corpus_pipeline.secrets(spark, docs, DIR)
    assert good.count() and few.count()
    with ThreadPoolExecutor(2) as pool:
        one, two = (f.result() for f in [pool.submit(corpus_pipeline.run, spark, DIR) for _ in range(2)])
    same = lambda df: df.drop("sequence_id", "offset")
    assert one.count() == two.count() and same(one).exceptAll(same(two)).count() == 0


def test_all_numbered_queries_are_there():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


def test_planted_cases_end_to_end(spark, tmp_path):
    """Junk goes, one of each group of copies stays, secrets are gone from what is packed, the mix decides how often, and null and repeated ids are rows like any other."""
    import random
    import zlib

    import numpy as np
    import public_tokenizers
    from conftest import DOCS, WORDS

    from skyframe.llm.packing import encode

    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(WORDS) + "abcdefgh"[rng.randrange(8)] for _ in range(60)) + "."
    secret = "0641917ea4e9feb9cda83477b57ac2654884f485"
    rows = [(i, prose(), f"src{i % 2}") for i in range(120)]
    rows += [(200 + i, "$$$ !!! ### %%% " * 12 + str(i), "src0") for i in range(40)]
    rows += [(300, rows[0][1], "src0"), (301, rows[0][1], "src1"), (None, rows[1][1], None), (2, prose(), "src1"), (None, prose(), None)]
    rows[5] = (5, f'{prose()} token = "{secret}" {prose()}', "src1")
    schema = DOCS.split(", slot")[0]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _, _ in rows if i is not None and i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # One source may be mixed once or not at all; what is there is clean, single and whole.
    assert not out.doc_id.between(200, 239).any() and not out.doc_id.isin([300, 301]).any()
    assert {0, 1, 5} & set(out.doc_id.dropna()) and out.doc_id.isna().any()
    path = public_tokenizers.path("word_bpe_49k.json")
    crc = lambda t: zlib.crc32(np.append(next(encode([t.encode()], path)), np.uint32(2)).astype("<u4").tobytes())
    redacted = {crc(t.replace(secret, "[SECRET]")): i for i, t, _ in rows}
    assert set(out.ids_crc32) <= set(redacted)
    assert crc(rows[5][1]) not in set(out.ids_crc32)
    times = out.groupby("ids_crc32").size()
    assert times.max() <= 2 and len(times) > 60
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096

    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
