from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import resample as R
from waveloom.operators import signal as S
from waveloom.operators import windows as W
from waveloom.sources import readers, sinks


def values(df, *order):
    return [r["value"] for r in df.orderBy(*order).collect()]


def step(spark):
    return readers.from_arrays(spark, {0: [1.0] * 10 + [0.0] * 10 + [-1.0] * 10})


@pytest.mark.parametrize("hop, n", [(10, 3), (5, 5)])
def test_frames(spark, hop, n):
    rows = W.frames(step(spark), 10, hop).orderBy("frame_idx").collect()
    signal = [1.0] * 10 + [0.0] * 10 + [-1.0] * 10
    assert [list(r["values"]) for r in rows] == [signal[k * hop : k * hop + 10] for k in range(n)]


def test_frames_drop_a_partial_tail(spark):
    assert W.frames(readers.from_arrays(spark, {0: [0.0] * 31, 1: [0.0] * 9}), 10, 10).count() == 3


@pytest.mark.parametrize(
    "kind, size, expected",
    [
        ("Triangle", 4, [0.25, 0.75, 0.75, 0.25]), ("Hann", 5, [0, 0.5, 1, 0.5, 0]), ("HannPeriodic", 6, [0, 0.25, 0.75, 1, 0.75, 0.25]), ("Rectangle", 3, [1, 1, 1]),
    ],
)
def test_windows(kind, size, expected):
    assert np.allclose(W.window_values(kind, size), expected)


def test_window_factor_and_root():
    assert np.allclose(W.WindowConfig("Hann", 5, 2).values(), [0, 1, 2, 1, 0])
    assert np.allclose(W.WindowConfig("Hann", 5, 1, True).values(), np.sqrt([0, 0.5, 1, 0.5, 0]))


def test_overlap_add_of_ones(spark):
    for kind, size, hop in (("Hann", 5, 2), ("HannPeriodic", 6, 3)):
        df = W.frames(readers.from_arrays(spark, {0: [1.0] * 40}), size, hop).withColumn("values", W.WindowConfig(kind, size).apply(F.col("values")))
        out = values(W.overlap_add(df, hop), "idx")
        assert np.allclose(out[size : 4 * size], 1)


def test_overlap_add_reconstructs_a_sine(spark):
    source = readers.sine(spark, 44100, 440, 0.02)
    df = W.frames(source, 32, 16).withColumn("values", W.WindowConfig("HannPeriodic", 32).apply(F.col("values")))
    x, y = np.array(values(source, "idx")), np.array(values(W.overlap_add(df, 16), "idx"))
    assert np.allclose(x[16 : len(y) - 16], y[16:-16], atol=1e-7)


def test_dc_offset_and_clip(spark):
    df = readers.from_arrays(spark, {0: [-1.3, -0.5, 0.0, 0.1, 1.0]})
    assert np.allclose(values(S.dc_offset(df, 0.2), "idx"), [-1.1, -0.3, 0.2, 0.3, 1.2])
    assert values(S.clip(df), "idx") == [-1.0, -0.5, 0.0, 0.1, 1.0]


def test_mono_lengths(spark):
    for n, out in ((2, 1), (4, 1), (4, 2), (1, 1), (1, 2), (1, 4)):
        df = readers.silence(spark, 12 * n).select("track_id", (F.col("idx") % n).alias("channel"), F.expr(f"idx div {n}").alias("idx"), "value")
        assert S.mono(df, n, out).count() == 12 * out


def test_surround_rejects_other_layouts(spark):
    with pytest.raises(ValueError):
        S.surround_downmix(step(spark), 5)


def test_concatenation_checks_formats(spark):
    a = spark.createDataFrame([(1, 44100, 16, "LPCM"), (1, 96000, 16, "LPCM")], "channels int, sample_rate int, bit_depth int, format string")
    with pytest.raises(ValueError):
        S.check_formats(a)


def test_crop_offset_round_trip(spark):
    df = step(spark)
    assert values(S.crop(S.offset(df, 4), 4, 34), "idx") == values(df, "idx")


def test_peak_store_takes_the_last_sample_before(spark):
    rows = S.peak_store(readers.from_arrays(spark, {0: [5.0, 1.0, 9.0, 2.0, 2.0, 2.0]}), 3).orderBy("peak").collect()
    assert [(r["low"], r["high"]) for r in rows] == [(1.0, 9.0), (2.0, 9.0)]


def test_peak_pyramid_first_group_is_wide(spark):
    peaks = spark.range(17).select(F.lit(0).alias("track_id"), F.col("id").alias("peak"), F.col("id").alias("low"), F.col("id").alias("high"))
    rows = S.peak_pyramid(peaks, 1).orderBy("peak").collect()
    assert [(r["low"], r["high"]) for r in rows] == [(0, 8), (9, 16)]
    assert S.pyramid_level(256 * 64) == 2 and S.pyramid_level(100) is None


def test_equal_prefix(spark):
    a, b = readers.from_arrays(spark, {0: [1.0, 2.0, 3.0]}), readers.from_arrays(spark, {0: [1.0, 2.0, 4.0]})
    assert S.equal_prefix(a, b).first()["n_equal"] == 2
    assert S.equal_prefix(a, a).first()["n_equal"] == 3


def test_warp_map(spark):
    warps = spark.createDataFrame([(0, 50, 0), (0, 150, 150)], "track_id long, from_t long, to_t long")
    points = spark.createDataFrame([(0, t) for t in (0, 50, 100, 150, 200)], "track_id long, t long")
    assert [r["t_out"] for r in R.translate(points, warps).orderBy("t").collect()] == [-50, 0, 75, 150, 200]
    identity = spark.createDataFrame([(0, t, t) for t in (-5, 10, 20, 40)], "track_id long, from_t long, to_t long")
    many = spark.range(-10, 51).select(F.lit(0).cast("long").alias("track_id"), F.col("id").alias("t"))
    assert R.translate(many, identity).where("t <> t_out").count() == 0
    assert R.translate(many, identity, inverse=True).where("t <> t_out").count() == 0
    assert R.warp_faults(warps).count() == 0
    assert R.warp_faults(spark.createDataFrame([(0, 0, 5), (0, 10, 1)], "track_id long, from_t long, to_t long")).count() == 1


def test_identity_warp_keeps_the_signal(spark):
    warps = spark.createDataFrame([(0, 0, 0), (0, 20, 20)], "track_id long, from_t long, to_t long")
    assert values(R.warp(step(spark), warps), "idx") == values(step(spark), "idx")


@pytest.mark.parametrize("ratio, n", [(1.0, 12), (2.0, 24), (0.5, 6)])
def test_resampled_lengths(spark, ratio, n):
    df = readers.silence(spark, 12)
    assert R.resample(df, ratio).count() == n
    assert R.resample_sinc(df, ratio).count() == n


def test_sinc_keeps_a_low_tone():
    x = np.sin(np.arange(2000) * 0.05)
    y = R.sinc_kernel(x, 1.5)
    assert np.abs(y[200:-200] - np.sin(np.arange(3000)[200:-200] / 1.5 * 0.05)).max() < 1e-3


@pytest.mark.parametrize("depth", [16, 24, 32])
def test_wav_round_trip(spark, tmp_path, depth):
    x = np.sin(np.arange(300) * 0.1).reshape(-1, 2).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(sinks.wav_bytes(x, 8000, depth))
    df = readers.blocks_to_samples(readers.open_signal(spark, str(tmp_path / "a.wav")))
    got = np.array(values(df, "idx", "channel")).reshape(-1, 2)
    assert np.abs(got - x).max() < {16: 2e-4, 24: 1e-6, 32: 1e-7}[depth]
    assert not readers.is_supported(b"nonsense")


def test_write_wav(spark, tmp_path):
    df = step(spark).withColumn("channel", F.lit(0))
    sinks.write_wav(df, str(tmp_path / "out"), 8000)
    fmt, x = readers.parse_wav((tmp_path / "out" / "0.wav").read_bytes())
    assert fmt["sample_rate"] == 8000 and x[:, 0].tolist() == [1.0] * 10 + [0.0] * 10 + [-1.0] * 10


def test_no_reader(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"123")
    with pytest.raises(ValueError):
        readers.open_signal(spark, str(tmp_path / "x.bin"))


def test_peak_file(spark, tmp_path):
    low, high = np.array([[-1.0], [-2.0]]), np.array([[1.0], [2.0]])
    (tmp_path / "p").write_bytes(sinks.peak_bytes(low, high))
    rows = readers.read_peaks(spark, str(tmp_path / "p"), 1).orderBy("peak").collect()
    assert [(r["low"], r["high"]) for r in rows] == [(-1, 1), (-2, 2)]


def test_project_round_trip(spark, tmp_path):
    """Names to escape, long and negative times, warps, version 1, missing sources."""
    rows = [(4, 'a "<&>', 12_345, -7, True, False, 1.0, -0.5, False, True, "a.wav"), (9, "b", 30 * 86_400 * 10**7 + 1, 36 * 10**9, False, True, 0.0, 0.0, True, False, "b.wav")]
    tracks = spark.createDataFrame(rows, "track_id long, name string, length_ticks long, offset_ticks long, mute boolean, solo boolean, volume double, balance double, inverted_phase boolean, locked boolean, file string")
    matches = spark.createDataFrame([(4, 9, 10, 20, 0.5, "CC")], "track1 long, track2 long, t1 long, t2 long, similarity double, source string")
    warps = spark.createDataFrame([(9, 0, 4), (9, 8, 16)], "track_id long, from_t long, to_t long")
    sinks.write_project(tracks, matches, str(tmp_path / "p"), warps, 0.25)
    t, m, w, settings = readers.read_project(spark, str(tmp_path / "p"))
    got = {r["track_id"]: r for r in t.collect()}
    for k, r in enumerate(rows):
        assert tuple(got[k][c] for c in ("name", "length_ticks", "offset_ticks", "mute", "solo", "volume", "balance", "inverted_phase", "locked", "file")) == r[1:]
    assert tuple(m.first()) == (0, 1, 10, 20, 0.5, "CC") and settings.first()["master_volume"] == 0.25
    assert sorted(map(tuple, w.collect())) == [(1, 0, 4), (1, 8, 16)]
    sources = spark.createDataFrame([("b.wav", 2, 16, 8)], "file string, channels int, bit_depth int, sample_rate int")
    with pytest.raises(FileNotFoundError):
        readers.read_project(spark, str(tmp_path / "p"), sources)
    assert readers.read_project(spark, str(tmp_path / "p"), sources, True)[0].where("name like '(OFFLINE)%'").count() == 1
    sinks.write_project(tracks, matches, str(tmp_path / "old"), warps, version=1)
    assert sorted(r["to_t"] for r in readers.read_project(spark, str(tmp_path / "old"), sources, True)[2].collect()) == [4 * 10**7 // 32, 16 * 10**7 // 32]
    sinks.write_project(tracks, matches, str(tmp_path / "new"), version=3)
    with pytest.raises(ValueError):
        readers.read_project(spark, str(tmp_path / "new"))
    sinks.write_edl(tracks.withColumn("locked", F.lit(False)), str(tmp_path / "edl"))
    assert spark.read.text(str(tmp_path / "edl")).count() == 2
    sinks.write_sync(tracks, matches, str(tmp_path / "sync"))
    sinks.write_matches(matches, tracks, str(tmp_path / "csv"))
    assert len(spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).columns) == 10
