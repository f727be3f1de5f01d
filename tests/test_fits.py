import numpy as np
import pytest

from skyframe.sources.fits import decode_files, detection_pixels, frames_and_errors, linear_pixels, read_files
from skyframe.streaming.frames import score_frames


def header(**cards):
    text = "".join(f"{k:<8}= {v!s:>20}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def fits(values, bitpix=16, cut=None, **cards):
    values = np.asarray(values)
    data = values.astype({8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix]).tobytes()
    data = data.ljust(-(-len(data) // 2880) * 2880, b"\0")[:cut]
    return header(SIMPLE="T", BITPIX=bitpix, NAXIS=2, NAXIS1=values.shape[1], NAXIS2=values.shape[0], **cards) + data


RAMP = np.arange(12).reshape(3, 4)
FILES = {
    **{f"bits{b}.fits": fits(RAMP, b) for b in (8, 16, 32, 64, -32, -64)},
    "unsigned.fits": fits(RAMP - 32768, 16, BZERO=32768, BSCALE=1),
    "scaled.fits": fits(RAMP, 16, BZERO="'32768'", BSCALE=0.5),
    "second.fits": header(SIMPLE="T", BITPIX=8, NAXIS=0) + fits(RAMP, 16).replace(b"SIMPLE  =", b"XTENSION=", 1),
    "short.fits": fits(RAMP, 16, cut=20),
    "nobits.fits": fits(RAMP).replace(b"BITPIX  ", b"BITPICKS"),
    "empty.fits": header(SIMPLE="T", BITPIX=8, NAXIS=0),
    "flatless.fits": header(SIMPLE="T", BITPIX=16, NAXIS=2, NAXIS1=4, NAXIS2=0) + bytes(2880),
    "gbrg.fits": fits(RAMP, BAYERPAT="'GBRG    '"),
    "colour.fits": fits(np.full((4, 4), 9), BAYERPAT="'RGGB    '"),
    "junk.fits": b"no header at all",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("fits")
    for name, content in FILES.items():
        (path / name).write_bytes(content)
    return str(path)


@pytest.fixture(scope="module")
def decoded(spark, folder):
    return decode_files(read_files(spark, folder)).cache()


def short(path):
    return path.rsplit("/", 1)[1].removesuffix(".fits")


def test_values(decoded):
    found = {}
    for r in linear_pixels(decoded).collect():
        found.setdefault(short(r.frame_id), np.zeros((4, 4)))[r.y, r.x] = r.v
    for name in (*(f"bits{b}" for b in (8, 16, 32, 64, -32, -64)), "unsigned", "second"):
        assert (found[name][:3] == RAMP).all(), name
    assert (found["scaled"][:3] == 0.5 * RAMP).all()


def test_errors(decoded):
    frames, errors = frames_and_errors(decoded)
    found = {short(r.frame_id): r.message for r in errors.collect()}
    assert set(found) == {"short", "nobits", "empty", "flatless", "gbrg", "junk"}
    assert "shorter" in found["short"] and "BITPIX" in found["nobits"] and "no image" in found["empty"] and "geometry" in found["flatless"] and "GBRG" in found["gbrg"]
    shapes = {short(r.frame_id): (r.width, r.height, r.channels, r.bayerpat) for r in frames.collect()}
    assert shapes["bits16"] == (4, 3, 1, None) and shapes["colour"] == (4, 4, 1, "RGGB")


def test_detection_pixels(decoded):
    rows = detection_pixels(decoded).collect()
    assert {r.v for r in rows if short(r.frame_id) == "colour"} == {9.0}
    assert len([r for r in rows if short(r.frame_id) == "bits16"]) == 12


def test_stream_scores_arriving_frames(spark, folder, tmp_path):
    score_frames(spark, folder, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {short(r.frame_id) for r in rows} == {"bits8", "bits16", "bits32", "bits64", "bits-32", "bits-64", "unsigned", "second", "scaled"}
    errors = spark.read.parquet(str(tmp_path / "out-errors")).collect()
    assert {(short(r.frame_id), r.stage) for r in errors} == {(n, "decode") for n in ("short", "nobits", "empty", "flatless", "gbrg", "junk")}


def test_a_batch_that_comes_again_leaves_the_table_as_it_was(spark, folder, tmp_path):
    from skyframe.spool import saved_tables, sweep
    from skyframe.streaming.frames import noise_of_frames, write_batch

    files, out = read_files(spark, folder), str(tmp_path / "out")
    sweep(spark)
    before = saved_tables(spark)
    write_batch(files.where("path like '%bits%'"), 0, noise_of_frames, out)
    write_batch(files.where("path not like '%bits%'"), 1, noise_of_frames, out)
    rows = lambda: sorted(map(str, spark.read.parquet(out).collect()))
    once = rows()
    for _ in range(6):
        write_batch(files.where("path like '%bits%'"), 0, noise_of_frames, out)
    assert rows() == once and len(once) == 9
    # At most the last batch's tables are still there, however many batches there were.
    assert len(saved_tables(spark)) <= len(before) + 2


def bands_of(spark, folder, **options):
    from skyframe.sources.fits_source import read_bands

    return read_bands(spark, folder, **options)


def test_source_reads_what_the_decoder_does(spark, folder, decoded):
    from skyframe.operators.bands import pixels_of

    bands = bands_of(spark, folder)
    want = {(short(r.frame_id), r.y, r.x): r.v for r in linear_pixels(decoded).collect()}
    assert {(short(r.frame_id), r.y, r.x): r.v for r in pixels_of(bands.where("message is null")).collect()} == want
    errors = {short(r.frame_id): r.message for r in bands.where("message is not null").collect()}
    assert errors == {short(r.frame_id): r.message for r in frames_and_errors(decoded)[1].collect()}
    # Narrow bands of one row with rims of one have every pixel once, too.
    narrow = bands_of(spark, folder + "/*bits*.fits", rim=1, band_pixels=1).where("message is null")
    assert narrow.count() == 18 and {(short(r.frame_id), r.y, r.x): r.v for r in pixels_of(narrow).collect()} == {k: v for k, v in want.items() if "bits" in k[0]}
    assert bands_of(spark, folder + "/none*").count() == 0


def test_a_crop_reads_its_bands_only(spark, tmp_path):
    from pyspark.sql import datasource as ds

    from skyframe.operators.bands import crop_bands
    from skyframe.sources.fits_source import FitsReader

    v = np.arange(1000 * 50).reshape(1000, 50)
    for name in ("one", "two"):
        (tmp_path / f"{name}.fits").write_bytes(fits(v, 32))
    bands = bands_of(spark, str(tmp_path), rim=2, band_pixels=50 * 104)
    got = crop_bands(bands, 3, 410, 5, 70)
    assert {(r.y, r.x): r.v for r in got.where("frame_id like '%one.fits'").collect()} == {(y, x): v[y + 410, x + 3] for y in range(70) for x in range(5)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "fits" in plan.lower()
    # What the reader plans for such filters: bytes of one band of each file, of one file where it is named.
    options = {"path": str(tmp_path), "rim": "2", "bandpixels": str(50 * 104)}
    size = lambda r: sum((b.span[1] - b.span[0]) * b.image.row_bytes for p in r.partitions() for b in p.bands)
    whole, some, named = (FitsReader(options) for _ in range(3))
    assert size(whole) > 2 * v.size * 4
    left = list(some.pushFilters([ds.LessThan(("y",), 480), ds.GreaterThan(("y_end",), 410), ds.IsNotNull(("v",))]))
    assert [type(f) for f in left] == [ds.IsNotNull] and size(some) == 2 * 104 * 200
    assert not list(named.pushFilters([ds.In(("frame_id",), (f"{tmp_path}/two.fits",)), ds.EqualTo(("y",), 0)])) and size(named) == 102 * 200


def test_a_sparse_file_above_two_gigabytes_goes_through_many_tasks(spark, tmp_path):
    from skyframe.sources.fits_source import TASK_PIXELS, FitsReader

    width, height = 40_000, 30_000
    head = header(SIMPLE="T", BITPIX=16, NAXIS=2, NAXIS1=width, NAXIS2=height)
    with open(tmp_path / "large.fits", "wb") as f:
        f.write(head)
        f.seek(len(head) + 2 * width * 29_999 + 6)
        f.write(np.array([77], ">i2").tobytes())
        f.truncate(len(head) + -(-2 * width * height // 2880) * 2880)
    reader = FitsReader({"path": str(tmp_path), "rim": "8"})
    parts = reader.partitions()
    assert len(parts) > 250 and max(b.pixels for p in parts for b in p.bands) <= TASK_PIXELS
    last = bands_of(spark, str(tmp_path), rim=8).where("y_end = 30000")
    (row,) = last.select("frame_id", "y", "top", "width", "v").collect()
    assert row.v[(29_999 - row.y + row.top) * width + 3] == 77 and sum(row.v) == 77


def test_headers_of_any_kind_are_rows(spark, tmp_path):
    bad = {
        "inf": fits(RAMP).replace(b"NAXIS1  =                    4", b"NAXIS1  =                1E400"), "bits": fits(RAMP).replace(b"BITPIX  =                   16", b"BITPIX  =                1E400"),
        "axes": fits(RAMP).replace(b"NAXIS   =                    2", b"NAXIS   =          99999999999"), "none": b"", "huge": fits(RAMP).replace(b"NAXIS2  =                    3", b"NAXIS2  =  9999999999999999999"),
        "negative": fits(RAMP).replace(b"NAXIS1  =                    4", b"NAXIS1  =                   -4"), "count": fits(RAMP, PCOUNT="-1E300"),
    }
    for name, content in bad.items():
        (tmp_path / f"{name}.fits").write_bytes(content)
    (tmp_path / "good.fits").write_bytes(fits(RAMP))
    bands = bands_of(spark, str(tmp_path)).collect()
    assert {short(r.frame_id) for r in bands if r.message} == set(bad) - {"axes", "count"} and len(bands) == len(bad) + 1
    files = spark.createDataFrame([("x/null.fits", None), ("x/good.fits", bytearray(fits(RAMP)))], "path string, content binary")
    frames, errors = frames_and_errors(decode_files(files))
    assert frames.count() == 1 and [r.message for r in errors.collect()] == ["FITS file contains no image data"]


def test_files_are_written_whole_and_once(spark, tmp_path):
    from skyframe.sources.fits_source import write_files

    df = spark.createDataFrame([("a.fits", bytearray(fits(RAMP))), ("b.fits", None), ("a.fits", bytearray(fits(RAMP)))], "path string, content binary")
    write_files(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["a.fits", "b.fits"]
    assert (tmp_path / "out" / "a.fits").read_bytes() == fits(RAMP)
