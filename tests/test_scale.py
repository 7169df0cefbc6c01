"""Operators whose cost grew faster than their input, against plain forms, and the shape of their plans."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import alignment as A
from waveloom.operators import correlation as K
from waveloom.operators import fingerprints as P
from waveloom.operators import graph as G
from waveloom.operators import index as I
from waveloom.operators import tiles as T
from waveloom.plans import registry
from waveloom.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _tracks(spark):
    """Tracks of several lengths, with gaps, without variation, of one sample, and with what is no number."""
    r = np.random.default_rng(5)
    rows = [(k, i, float(x)) for k in range(70) for i, x in enumerate(r.normal(50, 20, 5 + k % 7).round(2))]
    rows += [(100, i, 7.1) for i in range(9)] + [(101, 3, 1.0)] + [(102, i, 2.2 if i < 4 else 9.0) for i in range(12)]
    rows += [(103, i, float(i * i)) for i in range(1, 40, 3)] + [(104, i, math.nan if i == 7 else float(i % 3)) for i in range(10)] + [(105, 5000, 1.0)]
    return spark.createDataFrame(rows, "track_id long, idx long, value double")


@pytest.mark.parametrize("length", [None, 4])
@pytest.mark.parametrize("mode", ["correlation", "interference"])
def test_blocks_of_tracks_are_scored_as_pairs_in_step(spark, monkeypatch, mode, length):
    monkeypatch.setattr(K, "TRACKS", 30)
    df = _tracks(spark)
    keys = ("track1", "track2") + (("interval",) if length else ())
    pairs = K.pairs_in_step(df)
    pairs = pairs.withColumn("interval", F.floor(F.col("idx") / length)) if length else pairs
    plain = (K.pearson if mode == "correlation" else K.interference)(pairs, *keys)
    expected = {tuple(r[:-1]): r[-1] for r in plain.collect()}
    found = {tuple(r[:-1]): r[-1] for r in K.score_all(df, mode, length).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-9, nan_ok=True) for k, v in expected.items())


def test_pearson_of_what_does_not_vary_is_no_error(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (3, 1.0, None), (3, 2.0, 1.0)], "k long, x double, y double")
    assert {r["k"]: round(r["r"], 9) for r in K.pearson(df, "k").collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("name", ["corr_pearson", "corr_interference", "corr_analyse"])
def test_every_two_tracks_are_not_joined_by_sample(spark, name):
    assert "Join" not in _plan(registry.QUERIES[name](spark, DATA))


def test_a_project_is_written_and_read_in_parts(spark, tmp_path):
    """Tracks keep their places over the parts of a project; a file of one part reads the same."""
    n = 500
    tracks = spark.range(n).select((F.col("id") * 3).alias("track_id"), F.concat(F.lit("<é> \n"), "id").alias("name"), F.concat("id", F.lit(".wav")).alias("file"), F.lit(10).cast("long").alias("length_ticks"), (-F.col("id")).alias("offset_ticks"), *(F.lit(False).alias(c) for c in ("mute", "solo", "inverted_phase", "locked")), *(F.lit(0.5).alias(c) for c in ("volume", "balance")))
    matches = spark.range(n - 1).select((F.col("id") * 3).alias("track1"), (F.col("id") * 3 + 3).alias("track2"), F.col("id").alias("t1"), (F.col("id") * 7).alias("t2"), F.lit(0.25).alias("similarity"), F.lit("CC").alias("source"))
    warps = spark.range(0, n, 2).select((F.col("id") * 3).alias("track_id"), F.col("id").alias("from_t"), (F.col("id") + 1).alias("to_t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_project(tracks, matches, str(tmp_path / "p"), warps, 0.25)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "p").glob("part-*"))
    assert len(parts) > 1
    (tmp_path / "one.xml").write_bytes(b"<?xml version='1.0'?>\n" + b"".join(p.read_bytes() for p in parts).replace(b"\n", b""))
    for path in ("p", "one.xml"):
        t, m, w, settings = readers.read_project(spark, str(tmp_path / path))
        assert sorted(map(tuple, t.select("track_id", "name", "offset_ticks").collect())) == [(k, f"<é> \n{k}", -k) for k in range(n)]
        assert sorted(map(tuple, m.collect())) == [(k, k + 1, k, 7 * k, 0.25, "CC") for k in range(n - 1)]
        assert sorted(map(tuple, w.collect())) == [(k, k, k + 1) for k in range(0, n, 2)] and settings.first()["master_volume"] == 0.25


def test_cross_correlation_holds_few_pairs_at_a_time(spark, monkeypatch):
    """Lists stay in Arrow's arrays, and many pairs of one batch are taken in slices; sparse, empty and constant windows are as by hand."""
    n = 4096
    rows = [(k, i, float((i * (k + 3)) % 7)) for k in range(150) for i in range(k % 2, 20 + k % 5, 1 + k % 3)] + [(200, i, 1.0) for i in range(5)] + [(201, n + 1, 2.0)]
    df = spark.createDataFrame(rows, "pair_id long, idx long, value double").coalesce(1)
    found = {}
    for r in K.cross_correlation(df, df.withColumn("value", F.col("value") * F.col("idx")), n).where("abs(lag) < 3").collect():
        found[r["pair_id"], r["lag"]] = r["r"]
    own = {}
    for k, i, v in rows:
        own.setdefault(k, []).append((i, v))
    assert {k for k, _ in found} == set(own) - {201}
    for k, v in own.items():
        if k < 200:
            i, x = np.array([a for a, _ in v]), np.array([b for _, b in v])
            y = x * i - (x * i).mean()
            x = x - x.mean()
            for lag in range(-2, 3):
                s = sum(x[p] * y[q] for p in range(len(i)) for q in range(len(i)) if i[q] - i[p] == lag)
                low = math.sqrt((x * x).sum() * (y * y).sum())
                assert found[k, lag] == pytest.approx(s / low if low else 0.0, abs=1e-9)
    assert found[200, 0] == 0


def test_late_rows_are_not_written_by_one_task(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "coalesce", lambda *_: pytest.fail("one task for all rows"))
    assert registry.QUERIES["stream_late_rows"](spark, DATA).count() > 0


def _frames(spark, n):
    r = np.random.default_rng(3)
    return spark.createDataFrame([(k, i, [float(v) for v in r.random(4)]) for k in (1, 2) for i in range(n + 5 * k)], "track_id long, frame_idx long, values array<double>")


@pytest.mark.parametrize("kind", list(A.KERNELS))
def test_paths_are_found_with_few_costs_held(kind):
    """Memory is some steps a cell of the band, not its costs; the path is that of the costs."""
    r = np.random.default_rng(1)
    a, b = r.random((1500, 3)), r.random((1480, 3))
    tracemalloc.start()
    path = A.KERNELS[kind](a, b, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert path[0] == (0, 0) and path[-1] in ((1500, 1480), (1499, 1479))
    # 300,000 cells of the band on both sides; a cost alone takes 8 bytes
    assert peak < 1_200_000


def test_alignment_of_tracks_is_that_of_their_frames(spark):
    df = _frames(spark, 30)
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, track1 long, track2 long")
    stack = {k: np.array([r["values"] for r in df.where(F.col("track_id") == k).orderBy("frame_idx").collect()]) for k in (1, 2)}
    for kind, kernel in A.KERNELS.items():
        rows = A.align(pairs, df.orderBy(F.desc("frame_idx")), kind, 10, optimize=False).orderBy("step").collect()
        assert [(r["i1"], r["i2"]) for r in rows] == kernel(stack[1], stack[2], 10)
        assert all(r["pair_id"] == 7 and r["t1"] == round(r["i1"] * A.HOP / A.RATE * 10**7) for r in rows)


@pytest.mark.parametrize("kind", list(P.KERNELS))
def test_held_signals_have_the_hashes_of_their_samples(spark, kind, monkeypatch):
    """Samples are worked out behind the shuffle; blocks of few frames cut them anywhere."""
    profile = {"hk": P.BandProfile(size=256, hop=96, bands=9, flips=2), "chromaprint": P.ChromaProfile(5512, 512, 128)}.get(kind)
    df = spark.createDataFrame([(k, i, float((i * 37 + k * 11) % 91)) for k in (1, 2) for i in range(400)], "track_id long, idx long, value double")
    held = P.Held(150, lambda values, idx, track: values / 100 + np.sin(idx * (0.05 + track * 0.001)))
    long = df.select("track_id", F.explode(F.sequence(F.col("idx") * 150, F.col("idx") * 150 + 149)).alias("idx"), "value")
    long = long.withColumn("value", F.col("value") / 100 + F.sin(F.col("idx") * (F.lit(0.05) + F.col("track_id") * 0.001)))
    plain = sorted(map(tuple, P.hashes(long, kind, profile).collect()))
    found = P.hashes(df, kind, profile, held)
    assert sorted(map(tuple, found.collect())) == plain and plain


@pytest.mark.parametrize("name", ["fp_wang", "fp_haitsma_kalker_small", "fp_chromaprint_small", "spec_onset_frames"])
def test_fingerprints_sort_samples_before_they_are_held(spark, name):
    plan = _plan(registry.QUERIES[name](spark, DATA))
    assert "SIN(" not in plan


def test_logs_are_a_file_a_track_without_folders(spark, tmp_path):
    rows = [(k, b, (k + b) % 2 == 0) for k in range(30) for b in (2, 0, 1)]
    written = sinks.write_music_log(spark.createDataFrame(rows, "track_id long, block long, is_music boolean"), str(tmp_path), 2.5)
    assert {p.name for p in tmp_path.iterdir()} == {f"{k}.txt" for k in range(30)}
    assert (tmp_path / "4.txt").read_text() == "0.000 MUSIC\n2.500 NO_MUSIC\n5.000 MUSIC\n"
    assert readers.read_lines(written, str(tmp_path)).count() == 90


def _copies(spark):
    """Near copies of one text, with gaps and hashes that come often, as rows."""
    r = np.random.default_rng(4)
    base = r.integers(1, 1 << 32, 90)
    rows = []
    for track in range(12):
        own = np.concatenate([r.integers(1, 1 << 32, track), np.where(r.random(90) < 0.15, r.integers(1, 1 << 32, 90), base), [7, 7, 7, 7, 7]])
        rows += [(track, i, int(h)) for i, h in enumerate(own)]
    return rows


@pytest.mark.parametrize("window", [3, 20])
def test_matches_of_tiles_are_those_of_all_pairs(spark, monkeypatch, window):
    monkeypatch.setattr(T, "BLOCKED", 200)
    monkeypatch.setattr(T, "PAIRS", 50)
    tracks: dict = {}
    for t, _, h in _copies(spark):
        tracks.setdefault(t, []).append(h)
    expected = set()
    for a in tracks:
        for b in (b for b in tracks if b > a):
            for i in range(len(tracks[a]) - window + 1):
                for j in range(len(tracks[b]) - window + 1):
                    if tracks[a][i] == tracks[b][j]:
                        errors = sum((x ^ y).bit_count() for x, y in zip(tracks[a][i : i + window], tracks[b][j : j + window]))
                        if errors / (window * 32) < 0.35:
                            expected.add((a, b, i, j, errors))
    lists = spark.createDataFrame(list(tracks.items()), "track_id long, hashes array<long>")
    for df in (lists, spark.createDataFrame(_copies(spark), "track_id long, idx long, hash long")):
        found = [tuple(r)[:5] for r in I.find_all(df, window).select("track1", "track2", "i1", "i2", "bit_errors").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_scans_of_tiles_are_those_of_every_two_frames(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCKED", 200)
    monkeypatch.setattr(T, "PAIRS", 50)
    rows = [(t, i // 4 * (1 + t % 2), h) for t, i, h in _copies(spark)]
    frames: dict = {}
    for t, i, h in rows:
        frames.setdefault(t, {}).setdefault(i, []).append(h)
    expected = set()
    common = lambda a, b: sum(min(a.count(h), b.count(h)) for h in set(a))
    for a in frames:
        for b in (b for b in frames if b > a):
            for i in frames[a]:
                for j in (j for j in frames[b] if common(frames[a][i], frames[b][j])):
                    matched = tried = 0
                    for f in range(min(30, max(frames[a]) + 1 - i, max(frames[b]) + 1 - j)):
                        x, y = frames[a].get(i + f, []), frames[b].get(j + f, [])
                        matched, tried = matched + common(x, y), tried + len(x) + len(y) - common(x, y)
                        rate, bar = matched / tried if tried else 0.0, 0.3 * 0.5 ** (f * 0.25 / 2)
                        if f > 3 and rate > bar:
                            expected.add((a, b, i, j, f, rate))
                        if (f > 3 and rate > bar) or rate < bar / 6:
                            break
    found = [tuple(r) for r in I.frame_scan(spark.createDataFrame(rows, "track_id long, idx long, hash long"), 3, 30, 0.25).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and expected


@pytest.mark.parametrize("name", ["fp_find_all_matches", "fp_named_matches", "fp_find_long_windows", "fp_frame_scan"])
def test_pairs_of_places_are_not_shuffled(spark, name):
    plan = _plan(registry.QUERIES[name](spark, DATA))
    assert "Join" not in plan and "Exchange" not in plan


def test_components_of_chunks(spark, monkeypatch):
    """Chains, a star and a random graph, contracted in chunks and over several levels; a chain takes few rounds."""
    r = np.random.default_rng(9)
    rows = [(k, k + 20) for k in range(600)] + [(5000, k) for k in range(5001, 5100)] + [(int(a) + 9000, int(b) + 9000) for a, b in r.integers(0, 300, (250, 2))] + [(8000, 8000)]
    near: dict = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected: dict = {}
    for node in sorted(near):
        todo = [node] if node not in expected else []
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = node
                todo += near[x]
    df = spark.createDataFrame(rows, "u long, v long")
    for chunk in (1 << 20, 120):
        monkeypatch.setattr(G, "CHUNK", chunk)
        assert {r["node"]: r["root"] for r in G.components(df).collect()} == expected
    monkeypatch.setattr(G, "CHUNK", 1 << 20)
    monkeypatch.setattr(G, "_stars", lambda *_: pytest.fail("a round of joins for a small graph"))
    assert G.components(df).count() == len(expected)
