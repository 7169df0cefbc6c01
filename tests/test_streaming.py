from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from waveloom.operators.fingerprints import BAND_PROFILES, KERNELS, BandProfile, ChromaProfile, PeakProfile, haitsma_kalker
from waveloom.plans import registry
from waveloom.scratch import shared_dir
from waveloom.streaming import stateful as S

DATA = "/root/testdata/sf0.001"


def test_ring_keeps_the_last_items():
    r = S.RingBuffer(10)
    r.write(range(1, 16))
    assert r.items == list(range(6, 16)) and r[0] == 6
    r.write([16])
    assert len(r) == 10 and r[9] == 16


def test_fifo_loses_what_is_overwritten():
    f = S.LossyFifo(10)
    f.write([1])
    assert f.read(1) == [1]
    f.write([2, 3])
    assert f.read(1) == [2]
    f.write([4, 5])
    assert f.read(2) == [3, 4]
    f.write(range(6, 12))
    assert f.read(2) == [5, 6]
    f.write(range(12, 18))
    assert f.read(2) == [8, 9] and f.lost == 1
    f.end()
    with pytest.raises(ValueError):
        f.write([1])


def test_a_waiting_reader():
    f = S.BlockingFifo()
    assert f.read(3) is None and len(f) > 1 << 40
    f.write([1, 2])
    assert f.read(5) == [1, 2] and f.read(1) is None
    f.end()
    assert f.read(1) == [] and len(f) == 2
    with pytest.raises(ValueError):
        f.write([3])


def _stream(spark, path, parts, run, schema="track_id long, idx long, value double"):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    name = "s" + str(abs(hash(str(path))))
    q = run(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_frames_across_batches(spark, tmp_path):
    rows = [(0, i, float(i)) for i in range(25)]
    got = _stream(spark, tmp_path, [rows[:7], rows[7:13], rows[10:25]], lambda s: S.hop_frames(s, 6, 4)).orderBy("frame_idx").collect()
    assert [r["values"] for r in got] == [[float(i) for i in range(k, k + 6)] for k in range(0, 20, 4)]
    assert max(r["n_late"] for r in got) == 3


def test_live_hashes_are_those_of_the_whole(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=3000)
    rows = [(0, i, float(v)) for i, v in enumerate(x)]
    got = _stream(spark, tmp_path, [rows[:1000], rows[1000:2500], rows[2500:]], lambda s: S.live_hashes(s, BAND_PROFILES["default"]))
    whole = {(f, h) for f, h, v in haitsma_kalker(x) if not v}
    assert {(r["idx"], r["hash"]) for r in got.collect()} == whole


@pytest.mark.parametrize("kind", ["wang", "chromaprint"])
def test_live_generators_in_uneven_parts(spark, tmp_path, kind):
    x = np.random.default_rng(1).normal(size=4000)
    rows = [(0, i, float(v)) for i, v in enumerate(x)]
    small = {"wang": PeakProfile(size=64, hop=32, drop=5.0, distance=2, length=4), "chromaprint": ChromaProfile(5512, 64, 16, mapping="paper", low=100, high=2500)}[kind]
    live = {"wang": S.live_wang, "chromaprint": S.live_chromaprint}[kind]
    got = {(r["idx"], r["hash"]) for r in _stream(spark, tmp_path, [rows[:10], rows[10:1000], rows[1000:1017], rows[1017:]], lambda s: live(s, small)).collect()}
    whole = {(f, h) for f, h, _ in KERNELS[kind](x, small)}
    assert got <= whole and len(got) > 0.9 * len(whole)


_RUNS = "track_id long, idx long, n long, value double"


def _live_kinds():
    peaks = PeakProfile(size=64, hop=32, drop=5.0, distance=2, length=4)
    small = ChromaProfile(5512, 64, 16, mapping="paper", low=100, high=2500)
    return {"wang": (S.live_wang, peaks, 5), "hk": (S.live_hashes, BandProfile(size=256, hop=96, bands=9, flips=2), 0), "chromaprint": (S.live_chromaprint, small, 0)}


@pytest.mark.parametrize("stretch", [S.STRETCH, 300, 7])
@pytest.mark.parametrize("kind", list(_live_kinds()))
def test_runs_of_held_samples_have_the_hashes_of_the_samples(spark, tmp_path, monkeypatch, kind, stretch):
    """Runs may be cut between parts; what comes again, or late, is left out sample by sample, and the first that came stays."""
    monkeypatch.setattr(S, "STRETCH", stretch)
    live, profile, open_frames = _live_kinds()[kind]
    change = lambda values, idx, track: values / 100 + np.sin(idx * (0.05 + track * 0.001))
    held = np.random.default_rng(3).normal(50, 20, 60).round(2)
    whole = [(i * 50, 50, float(v)) for i, v in enumerate(held)]
    parts = [whole[:7] + [(350, 20, float(held[7]))], [(360, 40, float(held[7])), *whole[8:30], (1490, 5, float(held[29]))], [(340, 30, 1e6), *whole[30:]]]
    got = _stream(spark, tmp_path, [[(k, *r) for k in (3, 4) for r in p] for p in parts], lambda s: live(s, profile, change), _RUNS).collect()
    for k in (3, 4):
        x = change(np.repeat(held, 50), np.arange(3000), k)
        n = (len(x) - profile.size) // profile.hop + 1 - open_frames
        assert sorted((r["idx"], r["hash"]) for r in got if r["track_id"] == k) == sorted((f, h) for f, h, v in KERNELS[kind](x, profile) if f < n and not v)


@pytest.mark.parametrize("name", ["stream_live_wang", "stream_live_hashes", "stream_live_chromaprint"])
def test_held_samples_are_streamed_as_runs(spark, name):
    """No more rows than there are events, and one more a track, whose run the two parts cut."""
    before = set(Path(shared_dir(spark)).glob("live-*"))
    registry.QUERIES[name](spark, DATA)
    (made,) = set(Path(shared_dir(spark)).glob("live-*")) - before
    events = spark.read.parquet(f"{DATA}/events.parquet")
    rows = spark.read.parquet(f"{made}/in")
    assert rows.count() <= events.count() + events.select("user_id").distinct().count()
    assert rows.agg({"n": "sum"}).first()[0] == 128 * events.count()
