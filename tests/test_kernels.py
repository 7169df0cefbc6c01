from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions import columns as C
from waveloom.operators import alignment as A
from waveloom.operators import correlation as K
from waveloom.operators import fingerprints as P
from waveloom.operators import graph as G
from waveloom.operators import index as I
from waveloom.operators import matching as M
from waveloom.operators import music
from waveloom.operators import spectral as X
from waveloom.operators import windows as W

MATCH = "track1 long, track2 long, t1 long, t2 long, similarity double, source string"


def test_next_power_of_two(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 22756, 65536)], "n long")
    assert [r[0] for r in df.orderBy("n").select(C.next_power_of_two(F.col("n"))).collect()] == [1, 2, 4, 4, 32768, 65536]


def test_decibel_round_trip(spark):
    df = spark.range(1, 2000).select((F.col("id") * 0.5).alias("x"))
    assert df.where(F.abs(C.from_db(C.to_db(F.col("x"))) - F.col("x")) > 1e-6).count() == 0


def test_dft_agrees_with_fft(spark):
    x = np.random.default_rng(1).normal(size=16)
    df = spark.createDataFrame([(0, 0, x.tolist())], "track_id long, frame_idx long, values array<double>")
    z = np.fft.rfft(x)[:8]
    rows = X.dft(df, 16).orderBy("bin").collect()
    assert np.allclose([r["re"] for r in rows], z.real) and np.allclose([r["im"] for r in rows], z.imag)
    assert np.allclose(X.stft(df, W.WindowConfig("Rectangle", 16), fmt="squared").first()["bins"], np.abs(z) ** 2)


def test_inverse_stft(spark):
    x = np.sin(2 * np.pi * 3 * np.arange(64) / 64)
    df = spark.createDataFrame([(0, 0, x.tolist())], "track_id long, frame_idx long, values array<double>")
    back = X.inverse_stft(X.stft(df, W.WindowConfig("Rectangle", 64), fmt="complex"), 64).first()["values"]
    assert np.allclose(back, x, atol=1e-6)


def test_onset_band_map():
    m = X.onset_band_map()
    assert m[:17] == list(range(17)) and m[580:] == [83] * (1024 - 580) and max(m) == 83


def test_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (3, 2, 1.0), (11, 12, 1.0), (13, 12, 1.0)], "u long, v long, weight double")
    assert {(r["node"], r["root"]) for r in G.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (11, 11), (12, 11), (13, 11)}
    assert not G.is_connected(e) and G.has_path(e, 1, 3) and not G.has_path(e, 1, 11)


def test_spanning_tree_leaves_out_the_heaviest_edge(spark):
    e = spark.createDataFrame([(0, 1, 2, 0.1), (0, 2, 3, 0.2), (0, 1, 3, 0.9)], "group_id long, u long, v long, weight double")
    assert {(r["u"], r["v"]) for r in G.spanning_forest(e).collect()} == {(1, 2), (2, 3)}


def test_coincident_matches_depend_on_what_was_kept(spark):
    rows = [(1, 2, 0, 0, 1.0, "x"), (1, 2, 0, 5, 1.0, "x"), (1, 2, 3, 5, 1.0, "x")]
    kept = {(r["t1"], r["t2"]) for r in M.drop_coincident(spark.createDataFrame(rows, MATCH)).collect()}
    assert kept == {(0, 0), (3, 5)}


def test_window_filter_leaves_out_a_last_match_on_a_window_start(spark):
    df = spark.createDataFrame([(1, 2, t, t, 0.5, "x") for t in (0, 9, 10, 20)], MATCH)
    assert {r["t1"] for r in M.window_filter(df, 10).collect()} == {0, 10}
    assert M.window_filter(df.where("t1 = 0"), 10).count() == 0


@pytest.mark.parametrize("n, mode, t", [(1, "mid", 0), (2, "mid", 1), (3, "mid", 1), (4, "mid", 2), (4, "best", 0), (4, "last", 3)])
def test_pick(spark, n, mode, t):
    df = spark.createDataFrame([(1, 2, k, k, 0.5, "x") for k in range(n)], MATCH)
    assert M.pick(df, mode, "track1", "track2").first()["t1"] == t


def test_duplicates(spark):
    rows = [(1, 2, 5, 7, 0.5, "x"), (2, 1, 7, 5, 0.5, "x"), (1, 2, 7, 5, 0.5, "x"), (1, 2, 5, 7, 0.6, "x")]
    assert M.drop_duplicates(spark.createDataFrame(rows, MATCH)).count() == 3


def test_intervals_jump_only_above_the_threshold(spark):
    df = spark.createDataFrame([(1, 2, 0, 0, 0.5, "x"), (1, 2, 10, 0, 0.5, "x"), (1, 2, 31, 10, 0.5, "x")], MATCH)
    assert M.intervals(df, 11).count() == 1 and M.intervals(df, 10).count() == 2


def test_groups_and_alignment(spark):
    df = spark.createDataFrame([(1, 2, 10, 4, 0.9, "x"), (2, 3, 5, 5, 0.8, "x"), (1, 3, 0, 0, 0.1, "x"), (7, 8, 1, 0, 0.5, "x")], MATCH)
    tree = M.groups(df)
    assert {(r["track1"], r["track2"]) for r in tree.collect()} == {(1, 2), (2, 3), (7, 8)}
    tracks = spark.createDataFrame([(k, 100 * k, k == 1) for k in (1, 2, 3, 7, 8)], "track_id long, offset_ticks long, locked boolean")
    assert {r["track_id"]: r["offset_ticks"] for r in M.align_tracks(tree, tracks).where("kind = 'track'").collect()} == {1: 100, 2: 106, 3: 106, 7: 700, 8: 701}


def test_a_warped_track_moves_the_other_matches(spark):
    """All matches of a pair kept: the second one becomes a control point, and times in other pairs follow it."""
    df = spark.createDataFrame([(1, 2, 0, 0, 0.9, "x"), (1, 2, 100, 50, 0.9, "x"), (2, 3, 25, 10, 0.8, "x"), (2, 3, 70, 10, 0.7, "x")], MATCH)
    tree = M.groups(df, None)
    assert tree.count() == 4 and M.groups(df, "best", 60).where("track1 = 1").count() == 2
    tracks = spark.createDataFrame([(k, 1000 * k, False) for k in (1, 2, 3)], "track_id long, offset_ticks long, locked boolean")
    out = M.align_tracks(tree.where("track1 = 1 or t1 = 25"), tracks)
    assert {r["track_id"]: r["offset_ticks"] for r in out.where("kind = 'track'").collect()} == {1: 1000, 2: 1000, 3: 1040}
    assert sorted((r["track_id"], r["t1"], r["t2"]) for r in out.where("kind = 'warp'").collect()) == [(2, 0, 0), (2, 50, 100)]
    assert sorted((r["track_id"], r["track2"], r["t1"], r["t2"]) for r in out.where("kind = 'match'").collect()) == [(1, 2, 0, 0), (1, 2, 100, 100), (2, 3, 50, 10)]


def test_a_locked_track_leads():
    """Pairs before the one with the locked track follow in reverse."""
    pairs = {(1, 2): [[10, 0]], (2, 3): [[10, 0]], (3, 4): [[10, 0]], (4, 5): [[10, 0]]}
    offset = {k: 0 for k in range(1, 6)}
    M.walk_tree(pairs, M.tree_order([(a, b, 0.1 * a) for a, b in pairs]), offset, {3})
    assert offset == {1: -20, 2: -10, 3: 0, 4: 10, 5: 20}


def test_packed_blocks_find_what_a_plain_scan_finds(spark, monkeypatch):
    """Windows over block ends, variations, long windows, and a hash in very many places."""
    rng = np.random.default_rng(8)
    a = rng.integers(1, 1 << 32, 60).tolist()
    b = [*rng.integers(1, 1 << 32, 7).tolist(), *(h ^ (1 << int(rng.integers(0, 32))) if k % 3 else h for k, h in enumerate(a))]
    tracks = {1: a, 2: b, 3: [7] * 20, 4: [7] * 25}

    def plain(window):
        out = set()
        for x in tracks:
            for y in tracks:
                for i in range(len(tracks[x]) - window + 1) if x < y else ():
                    for j in range(len(tracks[y]) - window + 1):
                        p, q = tracks[x][i : i + window], tracks[y][j : j + window]
                        errors = sum(bin(u ^ v).count("1") for u, v in zip(p, q))
                        if p[0] == q[0] and errors / (window * 32) < 0.35:
                            out.add((x, y, i, j, errors))
        return out

    monkeypatch.setattr(I, "BLOCK", 8)
    monkeypatch.setattr(I, "HOT", 3)
    df = _hashes(spark, tracks)
    for window, carried in ((5, 32), (5, 2), (12, 2)):
        monkeypatch.setattr(I, "CARRIED", carried)
        assert {(r["track1"], r["track2"], r["i1"], r["i2"], r["bit_errors"]) for r in I.find_all(df, window).collect()} == plain(window)
    with_variations = df.withColumn("is_variation", F.lit(False)).unionByName(df.select("track_id", "idx", F.col("hash").bitwiseXOR(F.lit(1).cast("long")).alias("hash"), F.lit(True).alias("is_variation")))
    found = {(r["track1"], r["track2"], r["i1"], r["i2"], r["bit_errors"]) for r in I.find_all(with_variations, 5).collect()}
    assert plain(5) <= found


def _hashes(spark, tracks):
    return spark.createDataFrame([(t, i, h) for t, hs in tracks.items() for i, h in enumerate(hs)], "track_id long, idx long, hash long")


def test_a_window_with_a_zero_hash_is_rejected(spark):
    a = [5, 6, 7, 8, 9, 10]
    assert I.find_all(_hashes(spark, {1: a, 2: a}), 4).count() == 3
    b = [5, 6, 0, 8, 9, 10]
    assert I.find_all(_hashes(spark, {1: b, 2: b}), 4).count() == 0
    assert I.probe(_hashes(spark, {1: b}), _hashes(spark, {2: b}), 4).count() > 0
    assert I.find_all(_hashes(spark, {1: a[:3], 2: a[:3]}), 4).count() == 0


def test_error_rate_is_strict(spark):
    base = [(1 << 32) - 1 - k for k in range(4)]
    flip = [base[0], *(h ^ 0xFFF for h in base[1:])]
    found = I.find_all(_hashes(spark, {1: base, 2: flip}), 4, 36 / 128)
    assert found.count() == 0 and I.find_all(_hashes(spark, {1: base, 2: flip}), 4, 36 / 128 + 1e-9).count() == 1


def test_cross_correlation_finds_a_shift(spark):
    x = np.random.default_rng(0).normal(size=64)
    y = np.roll(x, 5)
    lag, r = K.cross_correlation_kernel(x, y)
    a = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "pair_id long, idx long, value double")
    b = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "pair_id long, idx long, value double")
    best = K.best_lag(K.cross_correlation(a, b, 64)).first()
    assert lag == 5 == best["lag"] and math.isclose(r, best["r"], abs_tol=1e-9)
    assert K.cross_correlation_kernel(np.ones(8), np.ones(8)) == (0, 0.0)


def test_adjust_moves_a_match(spark):
    x = np.random.default_rng(2).normal(size=200)
    rows = [(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, float(v)) for i, v in enumerate(np.concatenate([np.zeros(3), x]))]
    samples = spark.createDataFrame(rows, "track_id long, idx long, value double")
    m = spark.createDataFrame([(1, 2, 20 * 1_000_000, 20 * 1_000_000, 0.1, "x")], MATCH)
    out = K.adjust(m, samples, 10, 5.0).first()
    assert out["t2"] == 23 * 1_000_000 and out["similarity"] > 0.8


def test_spectrum_distance():
    x = np.sin(np.arange(4096) * 0.3)
    assert math.isclose(K.spectrum_distance(x, x), 1)
    with pytest.raises(ValueError):
        K.spectrum_distance(x[:32], x[:32])


@pytest.mark.parametrize("kind", sorted(A.KERNELS))
def test_aligning_a_sequence_with_itself_is_the_diagonal(kind):
    x = np.random.default_rng(3).random((30, 5))
    assert all(i == j for i, j in A.KERNELS[kind](x, x, 10))


def test_dtw_of_a_repeated_frame():
    x = np.random.default_rng(4).random((20, 5))
    path = A.dtw(x, np.vstack([x[:10], x[9:]]), 8)
    assert path[-1] == (20, 21) and (10, 11) in path
    assert A.frame_cost(np.zeros(3), np.zeros(3)) == 0


def test_runs_are_averaged():
    assert A.smooth([(0, 0), (1, 1), (1, 2), (1, 3), (2, 4)]) == [(0, 0), (1, 2), (2, 4)]


@pytest.mark.parametrize("kind", ["hk", "wang", "chromaprint", "echoprint"])
def test_a_crop_has_the_hashes_of_the_whole(kind):
    rng = np.random.default_rng(5)
    hop = {"hk": 64, "wang": 256, "chromaprint": 1365, "echoprint": 10_000}[kind]
    x = np.cumsum(rng.normal(size=120_000)) * 0.01 + rng.normal(size=120_000) * (np.arange(120_000) % 7000 < 500)
    whole, part = P.KERNELS[kind](x), P.KERNELS[kind](x[hop * 4 :])
    assert whole and part
    common = {h for _, h, v in whole if not v} & {h for _, h, v in part if not v}
    assert len(common) > 0.3 * len({h for _, h, v in part if not v})


@pytest.mark.parametrize("kind, profile", [("hk", P.BandProfile(size=64, hop=16, bands=9, flips=1)), ("chromaprint", P.ChromaProfile(5512, 64, 16, mapping="paper", low=100, high=2500))])
def test_blocks_give_the_hashes_of_whole_tracks(spark, monkeypatch, kind, profile):
    x = np.random.default_rng(9).normal(size=1500)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, float(v)) for i, v in enumerate(x[:700])], "track_id long, idx long, value double")
    monkeypatch.setattr(P, "BLOCK_FRAMES", 7)
    got = sorted(map(tuple, P.hashes(df, kind, profile).collect()))
    assert got == sorted((t, *row) for t, v in ((1, x), (2, x[:700])) for row in P.KERNELS[kind](v, profile)) and len(got) > 50


def test_a_dtw_path_is_that_of_plain_filling():
    """Cell by cell along the line between the ends, as published, in wide and narrow bands."""
    rng = np.random.default_rng(10)
    for n, m, width in ((9, 9, 50), (14, 9, 50), (8, 15, 50), (20, 12, 4), (12, 25, 6), (1, 5, 3), (5, 1, 3), (1, 1, 2)):
        a, b = rng.random((n, 4)), rng.random((m, 4))
        dn, dm = (1.0, 1.0) if n == m else (1.0, (m - 1) / (n - 1)) if n > m else ((n - 1) / (m - 1), 1.0)
        total, pn, pm, x, y = {(0, 0): 0.0}, 0.0, 0.0, 0, 0
        get = lambda i, j: total.get((i, j), math.inf)
        while x < n or y < m:
            x, y = min(n, int(pn + 1e-9) + 1), min(m, int(pm + 1e-9) + 1)
            for i, j in [(i, y) for i in range(max(x - width, 1), x + 1)] + [(x, j) for j in range(max(y - width, 1), y + 1)]:
                total[i, j] = A.frame_cost(a[i - 1], b[j - 1]) + min(get(i - 1, j), get(i, j - 1), get(i - 1, j - 1))
            pn, pm = pn + dn, pm + dm
        assert A.dtw(a, b, width) == A.backtrack(get, n, m)


@pytest.mark.parametrize("diagonal, by_length", [(2.0, False), (1.0, True)])
def test_online_warping_by_plain_matrices(diagonal, by_length):
    """The published procedure on whole matrices: the frontier's next side, at most three in a row, cells of the last row and column only."""
    rng = np.random.default_rng(15)
    for n, m, width in ((12, 12, 4), (20, 15, 5), (9, 16, 6), (6, 6, 50), (1, 4, 3)):
        a, b = rng.random((n, 3)), rng.random((m, 3))
        cost = np.array([[A.frame_cost(x, y) for y in b] for x in a])
        total = np.full((n + 1, m + 1), np.inf)  # one row and column of infinity at the end, which -1 reaches
        total[0, 0] = cost[0, 0]
        c, i, j, run, last = max(1, min(width, n, m)), 0, 0, 0, None

        def put(x, y):
            total[x, y] = min(total[x - 1, y - 1] + diagonal * cost[x, y], total[x - 1, y] + cost[x, y], total[x, y - 1] + cost[x, y])

        def weight(x, y):
            return total[x, y] / (1 + x + y) if by_length else total[x, y]

        while (i, j) != (n - 1, m - 1):
            step = "both"
            if i >= c:
                rows = {x: weight(x, j) for x in range(max(0, i - c + 1), i + 1)}
                columns = {y: weight(i, y) for y in range(max(0, j - c + 1), j + 1)}
                x = max(k for k, v in rows.items() if v == min(rows.values()))
                y = max(k for k, v in columns.items() if v == min(columns.values()))
                step = "both" if (x, y) == (i, j) else "row" if rows[x] < columns[y] else "column"
            run = 0 if step == "both" else run + 1 if step == last else run
            if step != "both" and run >= 3:
                step, run = {"row": "column", "column": "row"}[step], 0
            if step == "row" and j == m - 1:
                step = "column"
            elif step == "column" and i == n - 1:
                step = "row"
            if step != "column" and j < m - 1:
                j += 1
                for x in range(max(i - c + 1, 0), i + 1):
                    put(x, j)
            if step != "row" and i < n - 1:
                i += 1
                for y in range(max(j - c + 1, 0), j + 1):
                    put(i, y)
            last = step
        assert A.oltw(a, b, width, 3, diagonal, by_length) == A.backtrack(lambda x, y: float(total[x, y]), n - 1, m - 1)


def test_components_with_hubs(spark, monkeypatch):
    """A star of many edges, chains and loops, with and without hubs by broadcast."""
    rows = [(5, k) for k in range(100, 160)] + [(k, k + 1) for k in range(200, 230)] + [(300, 300), (159, 161), (3, 161), (400, 399)]
    df = spark.createDataFrame(rows, "u long, v long")
    expected = {5: 3, 3: 3, 161: 3, 300: 300, 400: 399, 399: 399} | {k: 3 for k in range(100, 160)} | {k: 200 for k in range(200, 231)}
    for large in (100_000, 10):
        monkeypatch.setattr(G, "LARGE", large)
        assert {r["node"]: r["root"] for r in G.components(df).collect()} == expected
    assert G.components(df.where("false")).collect() == []


def test_a_forest_of_chunks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(1, int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, 30, 300), rng.integers(30, 60, 300), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(sorted(set(rows)), "group_id long, u long, v long, weight double")
    whole = sorted(map(tuple, G.spanning_forest(df).collect()))
    monkeypatch.setattr(G, "EDGES", 100)
    assert sorted(map(tuple, G.spanning_forest(df).collect())) == whole and len(whole) == 59


def test_whitening_is_linear_prediction():
    """Against the normal equations of each block's smoothed autocorrelation."""
    p = P.OnsetProfile(poles=6, block=200)
    x = np.cumsum(np.random.default_rng(12).normal(size=700)) * 0.1
    out, r = P.whiten(x, p), np.array([0.001] + [0.0] * 6)
    for at in range(0, 700, 200):
        v = x[at : at + 200]
        r = r + p.alpha * (np.array([v[k:] @ v[: len(v) - k] for k in range(7)]) - r)
        a = np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(6), np.arange(6)))], r[1:])
        past = np.concatenate([np.zeros(6), x])[at : at + len(v) + 6]
        for t in range(len(v)):
            assert math.isclose(out[at + t], v[t] - sum(a[k] * past[t + 5 - k] for k in range(6)), abs_tol=1e-6)


def test_subbands_by_their_formula():
    x = np.random.default_rng(13).normal(size=160)
    e = P.subband_energies(x)
    for f in range(len(e)):
        for i in range(8):
            re = sum(P.ANALYSIS_WINDOW[k] * x[f * 8 + k] * math.cos((2 * i + 1) * (k % 16 - 4) * math.pi / 16) for k in range(128))
            im = sum(P.ANALYSIS_WINDOW[k] * x[f * 8 + k] * math.sin((2 * i + 1) * (k % 16 - 4) * math.pi / 16) for k in range(128))
            assert math.isclose(e[f, i], re * re + im * im, abs_tol=1e-9)


def test_onsets_step_by_step():
    """The detector fed one value at a time, with its last seven values at hand."""
    p = P.OnsetProfile(least_distance=8, target_distance=20)
    rng = np.random.default_rng(16)
    rms = np.abs(rng.normal(size=(900, 2))) * (1 + 5 * (np.arange(900)[:, None] % 37 < 6))
    for band in range(2):
        recent, onsets, out, total, level, was, since, tau = [], [], [], 0, 0.0, False, 0, 1
        bar = rms[0, band]
        for t, v in enumerate(rms[:, band]):
            recent = [*recent, v][-7:]
            level = 0.98 * level + (sum(c * (recent[-1 - k] - recent[k]) for k, c in enumerate(P.TAPS)) if t >= 6 else 0.0)
            above = level > bar
            bar = level * p.over if above else bar * math.exp(-1 / tau)
            if was and not above:
                near = total > 0 and t - onsets[-1] < p.least_distance
                onsets, total = (onsets[:-1] if near else onsets) + [t], total + (not near)
                onsets, since = onsets[-6:], 0
                if not near and total > 1 and len(onsets) == 6:
                    out += P.onset_hashes(band, onsets, p)
            since += 1
            tau = max(1, tau - 1) if since > p.target_distance else tau + 1
            was = above
        for k in range((len(onsets) + 1) // 2):
            out += P.onset_hashes(band, onsets[k + 1 :], p)
        x = P.rise(rms)
        assert P.band_onsets(band, np.stack([x[:, band], rms[:, band]], 1), p) == out and len(out) > 20


def test_variations_flip_the_weakest_bits():
    rows = P.band_hashes(np.random.default_rng(6).random((3, 33)), 3)
    assert len(rows) == 3 * 8
    for f in range(3):
        own = [h for g, h, _ in rows if g == f]
        assert len(set(own)) == 8 and all(bin(own[0] ^ h).count("1") <= 3 for h in own)


def test_murmur2_known_value():
    assert P.murmur2(b"", 0) == 0
    assert P.murmur2(b"abcd", 0) == P.murmur2(b"abcd", 0) != P.murmur2(b"abce", 0)


def test_music_labels_are_smoothed_in_order():
    t, f = True, False
    assert music.smooth_labels([t, f, t, f, f, t, t]) == [t] * 7
    assert music.smooth_labels([f, t, t, t, f]) == [f, t, t, t, f]
