"""What keeps queries growing no faster than their input: no joins by pixel, work over many tasks, bands batch by batch."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyframe import queries as q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", ["gaussian_seeds", "half_flux_radius", "star_moments_planted", "gaussian_fit_planted"])
def test_planted_windows_are_cut_without_a_join(spark, name):
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_planted_frames_are_made_in_many_tasks(spark):
    frames = q.planted_frames(spark, DIR)
    assert frames.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {len(r.stars) for r in frames.select("stars").collect()} <= set(range(1, 10))


def test_windows_of_lists_leaves_out_places_of_other_bands(spark):
    from skyframe.operators.bands import bands_of_arrays, windows_of_lists

    frame = spark.sql("select 1 as frame_id, 4 as width, 6 as height, transform(sequence(0, 23), i -> double(i)) as values, array(struct(0 as y, 1 as x), struct(5 as y, 3 as x)) as places")
    got = windows_of_lists(bands_of_arrays(frame, 1, 4, also=["places"]), "places", 1).collect()
    assert {(r.peak_y, r.peak_x, r.peak): (r.w_y, r.w_x, r.w_rows, r.w_cols, r.samples) for r in got} == {(0, 1, 1.0): (0, 0, 2, 3, [0, 1, 2, 4, 5, 6]), (5, 3, 23.0): (4, 2, 2, 2, [18, 19, 22, 23])} and len(got) == 2


def test_noise_of_many_seeds_is_that_of_each():
    import numpy as np

    from skyframe.sources.synth import noise, noise_of_many

    seeds, counts, starts = np.array([3, 7, 2**40, 3, 5]), np.array([16, 1, 0, 5, 16]), np.array([0, 16, 0, 16, 10**9])
    want = np.concatenate([noise(int(s), int(n), int(k)) for s, n, k in zip(seeds, counts, starts, strict=True)])
    assert (noise_of_many(seeds, counts, starts) == want).all() and len(noise_of_many(seeds[:0], counts[:0], starts[:0])) == 0


def test_small_bands_leave_a_task_together(spark):
    from skyframe.operators.bands import bands_of_arrays, map_bands

    frames = spark.range(1000, numPartitions=1).select(F.col("id").alias("frame_id"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.array_repeat(F.col("id").cast("double"), 4).alias("values"))
    made = map_bands(bands_of_arrays(frames), "total double, own array<double>", lambda band, v: {"total": v.sum(), "own": v.ravel()})

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert [r.n for r in made.mapInArrow(sizes, "n long").collect()] == [1000]
    assert {(r.frame_id, r.total, tuple(r.own)) for r in made.collect()} == {(i, 4.0 * i, (float(i),) * 4) for i in range(1000)}


def test_a_task_reads_its_files_without_a_listing(tmp_path, monkeypatch):
    import numpy as np

    from skyframe.sources import fits_source
    from skyframe.sources.synth import fits_file

    for k in range(5):
        (tmp_path / f"{k}.fits").write_bytes(fits_file(np.full((3, 4), float(k)), -64) if k else b"junk")
    reader = fits_source.FitsReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    monkeypatch.setattr(fits_source, "files_at", lambda path: pytest.fail("listed"))
    (batch,) = reader.read(part)
    rows = batch.to_pylist()
    assert [r["v"] for r in rows] == [None, *[[float(k)] * 12 for k in range(1, 5)]] and [bool(r["message"]) for r in rows] == [True, *[False] * 4]
    assert list(reader.read(fits_source.Bands([]))) == []


def test_whole_frames_are_detected_where_they_are(spark):
    from skyframe.config import DetectorConfig
    from skyframe.operators.bands import bands_of_arrays
    from skyframe.plans.detect import MatchedFilterDetector, estimate_fwhm, response_peaks
    from skyframe.spool import save

    frames = save(q.planted_frames(spark, DIR).where("frame_id < 3"), "frames")
    whole, parts = save(bands_of_arrays(frames), "whole"), save(bands_of_arrays(frames, 24, 1), "parts")
    assert whole.count() == 3 and parts.count() == 9
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(estimate_fwhm(whole)) and "Exchange" not in plan(response_peaks(whole, DetectorConfig()))
    one, other = ({r.frame_id: r.fwhm for r in estimate_fwhm(b).collect()} for b in (whole, parts))
    assert one == pytest.approx(other, abs=1e-9) and len(one) == 3
    both = [{(r.frame_id, r["rank"]): (r.x, r.y, r.flux, r.hfr, r.fwhm, r.eccentricity) for r in MatchedFilterDetector().detect(b).collect()} for b in (whole, parts)]
    assert both[0].keys() == both[1].keys() and len(both[0]) > 20
    for k, star in both[0].items():
        assert star == pytest.approx(both[1][k], rel=1e-3, abs=1e-3)


def test_whole_frames_are_segmented_where_they_are(spark):
    from skyframe.operators.bands import bands_of_arrays
    from skyframe.plans.segment import SegmentConfig, SegmentDetector
    from skyframe.spool import save

    made = q.planted_frames(spark, DIR).where("frame_id < 5")
    flat = spark.sql("select 7 as frame_id, 64 as width, 64 as height, array_repeat(double(200), 4096) as values, cast(null as array<struct<y: int, x: int, peak: double>>) as stars")
    small = spark.sql("select 8 as frame_id, 9 as width, 12 as height, transform(sequence(0, 107), i -> 200d + i % 7 + if(i in (48, 49, 57, 58, 59, 67), 900d + i, 0d)) as values, cast(null as array<struct<y: int, x: int, peak: double>>) as stars")
    frames = save(made.select("frame_id", "width", "height", "values", "stars").unionByName(flat).unionByName(small), "frames")
    whole, parts, mixed = (save(b, "bands") for b in (bands_of_arrays(frames), bands_of_arrays(frames, 16, 1), bands_of_arrays(frames.where("frame_id > 2")).unionByName(bands_of_arrays(frames.where("frame_id <= 2"), 16, 1))))
    plan = SegmentDetector().detect(whole)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # for ranks
    for config in (SegmentConfig(), SegmentConfig(roundness_limit=1.0, edge_margin=0, least_pixels=1)):
        told = [{(r.frame_id, r["rank"]): (r.x, r.y, r.flux, r.hfr, r.fwhm, r.eccentricity) for r in SegmentDetector(config).detect(b).collect()} for b in (whole, parts, mixed)]
        assert told[0].keys() == told[1].keys() == told[2].keys() and len(told[0]) > 40 and 7 not in {k for k, _ in told[0]}
        assert all(star == pytest.approx(t[k], rel=1e-9, abs=1e-9) for t in told[1:] for k, star in told[0].items())
    assert 8 in {k for k, _ in told[0]}
