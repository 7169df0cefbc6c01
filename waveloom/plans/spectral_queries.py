"""Queries of windows, frames, spectra, features and fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import alignment as A
from ..operators import fingerprints as P
from ..operators import music as M
from ..operators import spectral as X
from ..operators import windows as W
from ..sources import readers
from .inputs import FRAMES, SIGNAL, frames, rounded, signal
from .registry import query

SIZE, RATE = 64, 5512
_PI = "pi()"


def _window_sql(kind: str, n: int = 16) -> str:
    base = kind.removesuffix("Periodic")
    d = n if base != kind else n - 1
    if base == "Sine":
        e = f"sin(i * {_PI} / {d})"
    elif base == "Triangle":
        e = f"1 - abs(i - {(n - 1) / 2}::DOUBLE) / {n / 2}::DOUBLE"
    else:
        terms = W.COSINES[base]
        e = " + ".join(f"{(-1) ** k * a}::DOUBLE * cos(2 * {_PI} * {k} * i / {d})" for k, a in enumerate(terms))
    return f"SELECT '{kind}' AS kind, i::INT AS i, round({e}, 9) + 0.0 AS value FROM range({n}) r(i)"


@query(" UNION ALL ".join(_window_sql(k) for k in W.KINDS))
def win_functions(spark, sf):
    rows = [spark.range(1).select(F.lit(k).alias("kind"), F.posexplode(W.WindowConfig(k, 16).column()).alias("i", "value")) for k in W.KINDS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("kind", "i", rounded(F.col("value"), 9).alias("value"))


_FRAMING = (
    f"{SIGNAL}, n AS (SELECT track_id, count(*) AS n FROM sig GROUP BY ALL), fx AS (SELECT track_id, unnest(range(0, (n - 16) // 8 + 1)) AS frame_idx FROM n WHERE n >= 16), "
    "fs AS (SELECT f.track_id, f.frame_idx, s.idx - f.frame_idx * 8 AS i, s.value FROM fx f JOIN sig s ON s.track_id = f.track_id AND s.idx >= f.frame_idx * 8 AND s.idx < f.frame_idx * 8 + 16)"
)


@query(f"WITH {_FRAMING} SELECT track_id, frame_idx, i::INT AS i, round(value, 6) + 0.0 AS value FROM fs")
def win_frames(spark, sf):
    return W.frames(signal(spark, sf), 16, 8).select("track_id", "frame_idx", F.posexplode("values").alias("i", "value")).select("track_id", "frame_idx", "i", rounded(F.col("value")).alias("value"))


@query(f"WITH {_FRAMING} SELECT track_id, frame_idx * 8 + i AS idx, round(sum(value * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 16))), 6) + 0.0 AS value FROM fs GROUP BY ALL")
def win_overlap_add(spark, sf):
    df = W.frames(signal(spark, sf), 16, 8).withColumn("values", W.WindowConfig("HannPeriodic", 16).apply(F.col("values")))
    return W.overlap_add(df, 8).select("track_id", "idx", rounded(F.col("value")).alias("value"))


DFT = (
    f"{FRAMES}, bs AS (SELECT k AS bin, list(cos(2 * pi() * k * i / {SIZE}) ORDER BY i) AS c, list(-sin(2 * pi() * k * i / {SIZE}) ORDER BY i) AS s FROM range({SIZE // 2}) a(k), range({SIZE}) b(i) GROUP BY k), "
    "ft AS (SELECT track_id, frame_idx, bin, list_dot_product(v, c) AS re, list_dot_product(v, s) AS im FROM fr, bs), mg AS (SELECT *, sqrt(re * re + im * im) AS magnitude FROM ft)"
)


def bins(spark, sf):
    df = X.dft(frames(spark, sf), SIZE)
    return df.withColumns({"magnitude": X.magnitude(F.col("re"), F.col("im"))}).withColumn("squared", F.col("magnitude") * F.col("magnitude"))


@query(f"WITH {DFT} SELECT track_id, frame_idx, bin::INT AS bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(magnitude, 6) + 0.0 AS magnitude FROM mg")
def spec_dft(spark, sf):
    return bins(spark, sf).select("track_id", "frame_idx", "bin", *(rounded(F.col(c)).alias(c) for c in ("re", "im", "magnitude")))


@query(f"WITH {DFT} SELECT track_id, frame_idx, round(sum(20 * log10(magnitude / 32 * 2)), 4) AS db, round(sum(20 * log10(magnitude / top)), 4) AS relative FROM (SELECT *, max(magnitude) OVER (PARTITION BY track_id, frame_idx) AS top FROM mg) GROUP BY ALL")
def spec_decibel(spark, sf):
    df = X.normalized_db(bins(spark, sf)).withColumn("level", C.spectrum_db(F.col("magnitude"), SIZE // 2))
    return df.groupBy("track_id", "frame_idx").agg(F.round(F.sum("level"), 4).alias("db"), F.round(F.sum("db"), 4).alias("relative"))


@query(f"WITH {DFT} SELECT track_id, frame_idx, arg_max(bin, magnitude)::INT AS bin FROM mg GROUP BY ALL")
def spec_peak_bin(spark, sf):
    return X.peak_bin(bins(spark, sf)).select("track_id", "frame_idx", "bin")


def _bands_sql(edges):
    return " UNION ALL ".join(
        f"SELECT track_id, frame_idx, {k} AS band, coalesce(sum(magnitude) FILTER (bin >= {a} AND bin < {b}), 0) AS energy FROM mg GROUP BY ALL" for k, a, b in X.band_bins(edges, RATE, SIZE // 2)
    )


_EDGES = X.log_edges(300, 2000, 8)


@query(f"WITH {DFT}, e AS ({_bands_sql(_EDGES)}) SELECT track_id, frame_idx, band, round(energy, 6) + 0.0 AS energy FROM e")
def spec_log_bands(spark, sf):
    return X.bands(bins(spark, sf), _EDGES, RATE, SIZE // 2).select("track_id", "frame_idx", "band", rounded(F.col("energy")).alias("energy"))


@query(
    f"WITH {DFT}, e AS ({_bands_sql(_EDGES)}), d AS (SELECT *, greatest(0.0::DOUBLE, energy - coalesce(lag(energy) OVER (PARTITION BY track_id, band ORDER BY frame_idx), 0)) AS rise, "
    "sum(energy) OVER (PARTITION BY track_id, frame_idx) AS total FROM e) SELECT track_id, frame_idx, band, round(CASE WHEN total > 0 THEN rise / total ELSE rise END, 6) + 0.0 AS rise FROM d"
)
def spec_onset_difference(spark, sf):
    return X.rectified_difference(X.bands(bins(spark, sf), _EDGES, RATE, SIZE // 2)).select("track_id", "frame_idx", "band", rounded(F.col("rise")).alias("rise"))


_LINEAR = X.linear_edges(100, 2500, 7)


@query(f"WITH {DFT}, e AS ({_bands_sql(_LINEAR)}) SELECT track_id, frame_idx, band, round(energy, 6) + 0.0 AS energy FROM e")
def spec_linear_bands(spark, sf):
    return X.bands(bins(spark, sf), _LINEAR, RATE, SIZE // 2).select("track_id", "frame_idx", "band", rounded(F.col("energy")).alias("energy"))


def _chroma_sql(mapping, normalize):
    t = X.chroma_classes(RATE, SIZE, 100, 2500, mapping)
    n = [sum(c == k for _, c in t) for k in range(12)]
    cls = "CASE bin " + " ".join(f"WHEN {b} THEN {c}" for b, c in t) + " END"
    v = f"coalesce(sum(magnitude * magnitude) FILTER ({cls} = k), 0)"
    rows = " UNION ALL ".join(f"SELECT track_id, frame_idx, {k} AS class, {v.replace('= k)', f'= {k})')}{f' / {n[k]}' if normalize and n[k] else ''} AS value FROM mg GROUP BY ALL" for k in range(12))
    out = "value - avg(value) OVER (PARTITION BY track_id, frame_idx)" if normalize else "value"
    return f"WITH {DFT}, c AS ({rows}) SELECT track_id, frame_idx, class, round({out}, 6) + 0.0 AS value FROM c"


for _mapping, _norm in (("paper", True), ("chromaprint", False)):
    query(_chroma_sql(_mapping, _norm), f"spec_chroma_{_mapping}")(
        lambda spark, sf, m=_mapping, z=_norm: X.chroma(bins(spark, sf), RATE, SIZE, 100, 2500, m, z).select("track_id", "frame_idx", "class", rounded(F.col("value")).alias("value"))
    )


@query(f"WITH {FRAMES} SELECT track_id, frame_idx, i::INT AS i, round(v[i + 1] - list_sum(v) / {SIZE}, 6) + 0.0 AS value FROM fr, range({SIZE}) r(i)")
def spec_remove_dc(spark, sf):
    df = frames(spark, sf).withColumn("v", F.transform("values", lambda x: x.cast("double")))
    return df.select("track_id", "frame_idx", F.posexplode(X.remove_dc(F.col("v"))).alias("i", "value")).select("track_id", "frame_idx", "i", rounded(F.col("value")).alias("value"))


@query(
    f"WITH {SIGNAL} SELECT track_id, idx, round(avg(value) OVER (PARTITION BY track_id ORDER BY idx ROWS 4 PRECEDING), 6) + 0.0 AS mean, round(max(value) OVER w, 6) + 0.0 AS high, round(min(value) OVER w, 6) + 0.0 AS low "
    "FROM sig WINDOW w AS (PARTITION BY track_id ORDER BY idx ROWS 4 PRECEDING)"
)
def spec_moving_average(spark, sf):
    w = Window.partitionBy("track_id").orderBy("idx").rowsBetween(-4, 0)
    return signal(spark, sf).select("track_id", "idx", rounded(F.avg("value").over(w)).alias("mean"), rounded(F.max("value").over(w)).alias("high"), rounded(F.min("value").over(w)).alias("low"))


@query(
    f"WITH RECURSIVE {SIGNAL}, e(track_id, idx, a) AS (SELECT track_id, idx, value FROM sig WHERE idx = 0 UNION ALL SELECT s.track_id, s.idx, 0.05::DOUBLE * s.value + 0.95::DOUBLE * e.a FROM e JOIN sig s ON s.track_id = e.track_id AND s.idx = e.idx + 1) "
    "SELECT track_id, round(arg_max(a, idx), 6) + 0.0 AS average FROM e GROUP BY ALL"
)
def spec_exponential_average(spark, sf):
    df = signal(spark, sf).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value")))["value"].alias("v"))
    return df.select("track_id", rounded(C.exponential_average(F.col("v"), 0.05)).alias("average"))


@query(
    f"WITH {DFT}, l AS (SELECT *, CASE WHEN magnitude - avg(magnitude) OVER (PARTITION BY track_id, frame_idx ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) > 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS active, "
    "dense_rank() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS f, FROM mg), n AS (SELECT track_id, max(f) + 1 AS n FROM l GROUP BY ALL), b AS (SELECT track_id, unnest(range(0, greatest(0, (n - 10) // 5 + 1))) AS block FROM n) "
    "SELECT b.track_id, b.block, l.bin::INT AS bin, round(avg(active), 6) AS activation FROM b JOIN l ON l.track_id = b.track_id AND l.f >= b.block * 5 AND l.f < b.block * 5 + 10 GROUP BY ALL"
)
def music_activation(spark, sf):
    order = Window.partitionBy("track_id").orderBy("frame_idx")
    df = M.binarize(M.emphasize(bins(spark, sf), "magnitude")).withColumn("frame_idx", (F.dense_rank().over(order) - 1).cast("long"))
    return M.activation(df, 10, 5).select("track_id", "block", "bin", F.round("activation", 6).alias("activation"))


_ACTIVE = (
    f"{DFT}, l AS (SELECT *, CASE WHEN magnitude - avg(magnitude) OVER (PARTITION BY track_id, frame_idx ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) > 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS active, "
    "dense_rank() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS f, FROM mg), n AS (SELECT track_id, max(f) + 1 AS n FROM l GROUP BY ALL), b AS (SELECT track_id, unnest(range(0, greatest(0, (n - 10) // 5 + 1))) AS block FROM n), "
    "ac AS (SELECT b.track_id, b.block, l.bin, avg(active) AS v FROM b JOIN l ON l.track_id = b.track_id AND l.f >= b.block * 5 AND l.f < b.block * 5 + 10 GROUP BY ALL), "
    "rn AS (SELECT *, sum(CASE WHEN v > p THEN 0 ELSE 1 END) OVER w AS up, sum(CASE WHEN v < p THEN 0 ELSE 1 END) OVER w AS dn, lead(v) OVER w AS nx FROM (SELECT *, lag(v) OVER (PARTITION BY track_id, block ORDER BY bin) AS p FROM ac) WINDOW w AS (PARTITION BY track_id, block ORDER BY bin)), "
    "sd AS (SELECT *, v - min(v) OVER u AS hl, bin - min(bin) OVER u AS wl, v - min(v) OVER d AS hr, max(bin) OVER d - bin AS wr FROM rn WINDOW u AS (PARTITION BY track_id, block, up), d AS (PARTITION BY track_id, block, dn)), "
    "pk AS (SELECT track_id, block, CASE WHEN hl < hr OR hl = hr AND wl <= wr THEN CASE WHEN wl > 0 THEN hl / wl ELSE 0 END ELSE CASE WHEN wr > 0 THEN hr / wr ELSE 0 END END AS s FROM sd WHERE v > p AND v >= nx), "
    "st AS (SELECT b.track_id, b.block, coalesce(list_sum(list_sort(list(s) FILTER (s IS NOT NULL), 'DESC')[1:5]), 0)::DOUBLE AS strength FROM b LEFT JOIN pk USING (track_id, block) GROUP BY ALL)"
)
#: The middle of the strengths of these blocks, so that both labels occur.
_MUSIC_BAR = 1.9


@query(
    f"WITH RECURSIVE {_ACTIVE}, p0 AS (SELECT track_id, list(strength > {_MUSIC_BAR} ORDER BY block) AS l FROM st GROUP BY ALL), "
    "p1(track_id, k, l) AS (SELECT track_id, 2, l FROM p0 UNION ALL SELECT track_id, k + 1, CASE WHEN l[k - 1] = l[k + 1] AND l[k] <> l[k - 1] THEN list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = k THEN l[k - 1] ELSE l[i] END) ELSE l END FROM p1 WHERE k < len(l)), "
    "m1 AS (SELECT track_id, arg_max(l, k) AS l FROM p1 GROUP BY ALL), p2(track_id, k, l) AS (SELECT track_id, 2, l FROM m1 UNION ALL SELECT track_id, k + 1, CASE WHEN l[k - 1] = l[k + 2] AND l[k] <> l[k - 1] AND l[k + 1] <> l[k - 1] "
    "THEN list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = k OR i = k + 1 THEN l[k - 1] ELSE l[i] END) ELSE l END FROM p2 WHERE k + 1 < len(l)), "
    "m2 AS (SELECT track_id, arg_max(l, k) AS l FROM p2 GROUP BY ALL) SELECT st.track_id, block, round(strength, 6) AS strength, l[block + 1] AS is_music FROM st JOIN m2 USING (track_id)"
)
def music_labels(spark, sf):
    order = Window.partitionBy("track_id").orderBy("frame_idx")
    df = M.binarize(M.emphasize(bins(spark, sf), "magnitude")).withColumn("frame_idx", (F.dense_rank().over(order) - 1).cast("long"))
    return M.label(M.quantify(M.activation(df, 10, 5)), _MUSIC_BAR).withColumn("strength", F.round("strength", 6))


@query(f"WITH {DFT} SELECT track_id, frame_idx, round(sum(magnitude), 4) AS total FROM mg GROUP BY ALL")
def spec_stft(spark, sf):
    df = X.stft(frames(spark, sf), W.WindowConfig("Rectangle", SIZE))
    return df.select("track_id", "frame_idx", F.round(F.aggregate("bins", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def windowed_sql(source: str, kind: str, size: int, bins: int | None = None) -> str:
    """Spectra of windowed frames v of a table: mg (track_id, frame_idx, bin, magnitude)."""
    return (
        f"wv AS (SELECT track_id, frame_idx, list_transform(list_zip(v, {_list(W.window_values(kind, size))}), lambda x: x[1] * x[2]) AS v FROM {source}), "
        f"bs AS (SELECT k AS bin, list(cos(2 * pi() * k * i / {size}) ORDER BY i) AS c, list(-sin(2 * pi() * k * i / {size}) ORDER BY i) AS s FROM range({bins or size // 2}) a(k), range({size}) b(i) GROUP BY k), "
        "mg AS (SELECT track_id, frame_idx, bin, sqrt(list_dot_product(v, c) ** 2 + list_dot_product(v, s) ** 2) AS magnitude FROM wv, bs)"
    )


@query(f"WITH {FRAMES}, {windowed_sql('fr', 'Hann', SIZE)} SELECT track_id, frame_idx, bin::INT AS bin, round(20 * log10(magnitude / 32 * 2) + {X.analyzer_offset(W.WindowConfig('Hann', SIZE))!r}, 4) + 0.0 AS db FROM mg")
def spec_analyzer(spark, sf):
    df = X.analyse_blocks(frames(spark, sf), W.WindowConfig("Hann", SIZE))
    return df.select("track_id", "frame_idx", F.posexplode("bins").alias("bin", "db")).withColumn("db", rounded(F.col("db"), 4))


@query(
    f"WITH {FRAMES}, e AS (SELECT track_id, frame_idx, i, v[i + 1] AS x FROM fr, range({SIZE}) r(i)), q AS (SELECT *, sum(CASE WHEN i % 2 = 0 THEN x ELSE -x END) OVER (PARTITION BY track_id, frame_idx) AS n FROM e) "
    f"SELECT track_id, frame_idx, i::INT AS i, round(x - CASE WHEN i % 2 = 0 THEN n ELSE -n END / {SIZE}, 6) + 0.0 AS value FROM q"
)
def spec_inverse_stft(spark, sf):
    """There and back; what is lost is the last bin, which spectra leave out."""
    df = X.inverse_stft(X.stft(frames(spark, sf), W.WindowConfig("Rectangle", SIZE), fmt="complex"), SIZE)
    return df.select("track_id", "frame_idx", F.posexplode("values").alias("i", "value")).withColumn("value", rounded(F.col("value")))


@query(f"WITH {DFT} SELECT track_id, frame_idx, bin::INT AS bin, round(atan2(im, re), 5) + 0.0 AS phase, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM mg WHERE bin > 0")
def spec_polar(spark, sf):
    """Phases, and the way back from magnitude and phase."""
    df = bins(spark, sf).where("bin > 0").withColumn("phase", X.phase(F.col("re"), F.col("im")))
    back = X.from_polar(F.col("magnitude"), F.col("phase"))
    return df.select("track_id", "frame_idx", "bin", rounded(F.col("phase"), 5).alias("phase"), rounded(back["re"], 5).alias("re"), rounded(back["im"], 5).alias("im"))


for _fmt, _per in (("complex", 2), ("squared", 1), ("polar", 2), ("decibel", 1)):
    _expr = {"complex": "re + im", "squared": "re * re + im * im", "polar": "magnitude + atan2(im, re)", "decibel": "20 * log10(magnitude / 32 * 2)"}[_fmt]
    query(f"WITH {DFT} SELECT track_id, frame_idx, bin::INT AS bin, round({_expr}, 4) + 0.0 AS value FROM mg WHERE bin > 0", f"spec_stft_{_fmt}")(
        lambda spark, sf, fmt=_fmt, per=_per: X.stft(frames(spark, sf), W.WindowConfig("Rectangle", SIZE), fmt=fmt)
        .select("track_id", "frame_idx", F.posexplode("bins").alias("i", "v")).groupBy("track_id", "frame_idx", F.expr(f"int(i div {per})").alias("bin"))
        .agg(rounded(F.sum("v"), 4).alias("value")).where("bin > 0")
    )


@query(f"SELECT k AS track_id, least(round_even(k * 3.7::DOUBLE / ({RATE} / 2.0::DOUBLE / {SIZE // 2}), 0), {SIZE // 2 - 1})::INT AS bin, pow(2::DOUBLE, ceil(log2(k + 1)))::BIGINT AS size FROM range(1, 800) r(k)")
def spec_bin_of(spark, sf):
    """The bin of a frequency, and the next power of two."""
    rows = spark.createDataFrame([(k, X.bin_of(k * 3.7, RATE, SIZE // 2)) for k in range(1, 800)], "track_id long, bin int")
    return rows.withColumn("size", C.next_power_of_two(F.col("track_id") + 1))


_SIGN = " | ".join(f"(CASE WHEN p{m} - p{m + 1} - (e{m} - e{m + 1}) > 0 THEN {1 << m} ELSE 0 END)" for m in range(7))


@query(
    f"WITH {DFT}, b AS ({_bands_sql(_EDGES)}), e AS (SELECT track_id, frame_idx, " + ", ".join(f"sum(energy) FILTER (band = {k}) AS e{k}" for k in range(8)) + " FROM b GROUP BY ALL), "
    "q AS (SELECT *, " + ", ".join(f"coalesce(lag(e{k}) OVER (PARTITION BY track_id ORDER BY frame_idx), 0) AS p{k}" for k in range(8)) + f" FROM e) SELECT track_id, frame_idx, ({_SIGN})::BIGINT AS hash FROM q"
)
def fp_band_hashes(spark, sf):
    """Hashes of 8 bands by DataFrame operations: signs of double differences in time and band."""
    before = Window.partitionBy("track_id", "band").orderBy("frame_idx")
    df = X.bands(bins(spark, sf), _EDGES, RATE, SIZE // 2)
    df = df.withColumn("d", F.coalesce(F.lag("energy").over(before), F.lit(0.0))).groupBy("track_id", "frame_idx")
    df = df.agg(F.sort_array(F.collect_list(F.struct("band", "d", "energy"))).alias("b"))
    bits = [F.when(F.col("b")[m]["d"] - F.col("b")[m + 1]["d"] - (F.col("b")[m]["energy"] - F.col("b")[m + 1]["energy"]) > 0, 1 << m).otherwise(0) for m in range(7)]
    word = bits[0]
    for x in bits[1:]:
        word = word.bitwiseOR(x)
    return df.select("track_id", "frame_idx", word.cast("long").alias("hash"))


HOLD = 128


def _held(hold=HOLD):
    """Signals long enough for fingerprints: every track's values held for many samples, under a tone of its own; worked out where a kernel needs them."""
    return P.Held(hold, lambda values, idx, track: values / 100 + np.sin(idx * (0.05 + track * 0.001)))


LONG = f"{SIGNAL}, lo AS (SELECT track_id, idx * {HOLD} + j AS idx, value / 100 + sin((idx * {HOLD} + j) * (0.05::DOUBLE + track_id * 0.001::DOUBLE)) AS value FROM sig, range({HOLD}) r(j))"


def long_frames_sql(size: int, hop: int) -> str:
    """Frames of the long signals: fr (track_id, frame_idx, v)."""
    return (
        f"{LONG}, ar AS (SELECT track_id, list(value ORDER BY idx) AS a FROM lo GROUP BY ALL), "
        f"fr AS (SELECT track_id, f AS frame_idx, a[f * {hop} + 1 : f * {hop} + {size}] AS v FROM (SELECT track_id, a, unnest(range(0, (len(a) - {size}) // {hop} + 1)) AS f FROM ar WHERE len(a) >= {size}))"
    )


@query()
def fp_haitsma_kalker(spark, sf):
    return P.hashes(signal(spark, sf), "hk", held=_held())


@query()
def fp_wang(spark, sf):
    return P.hashes(signal(spark, sf), "wang", held=_held())


@query()
def fp_chromaprint(spark, sf):
    return P.hashes(signal(spark, sf), "chromaprint", P.CHROMA_PROFILES["sync"], held=_held())


@query()
def fp_echoprint(spark, sf):
    return P.hashes(signal(spark, sf), "echoprint", held=_held(300))


#: Small profiles of the generators, whose hashes SQL can work out from the samples.
BAND = P.BandProfile(size=256, hop=128, bands=9, flips=2)
PEAK = P.PeakProfile(size=256, hop=128, drop=20.0, peaks=3, fanout=4, distance=2, length=6, width=31)
CHROMA = P.ChromaProfile(5512, 512, 128, "Hamming", 100, 2500, "paper", classifiers=tuple(((k, y, h, min(w, 8)), bars) for (k, y, h, w), bars in P.CLASSIFIERS))


def _hk_sql() -> str:
    edges = X.band_bins(X.log_edges(BAND.low, BAND.high, BAND.bands), BAND.rate, BAND.size // 2)
    n = BAND.bands - 1
    energy = ", ".join(f"coalesce(sum(db) FILTER (bin >= {a} AND bin < {b}), 0) AS e{k}" for k, a, b in edges)
    lags = ", ".join(f"coalesce(lag(e{k}) OVER (PARTITION BY track_id ORDER BY frame_idx), 0) AS p{k}" for k in range(BAND.bands))
    diffs = ", ".join(f"(p{k} - p{k + 1}) - (e{k} - e{k + 1})" for k in range(n))
    return (
        f"WITH {long_frames_sql(BAND.size, BAND.hop)}, {windowed_sql('fr', 'Hann', BAND.size, edges[-1][2])}, db AS (SELECT track_id, frame_idx, bin, 20 * log10(magnitude / {BAND.size // 2} * 2) AS db FROM mg), "
        f"en AS (SELECT track_id, frame_idx, {energy} FROM db GROUP BY ALL), lg AS (SELECT *, {lags} FROM en), df AS (SELECT track_id, frame_idx, [{diffs}] AS d FROM lg), "
        f"bt AS (SELECT track_id, frame_idx, d, list_sum(list_transform(range({n}), lambda m: CASE WHEN d[m + 1] > 0 THEN 1 << m ELSE 0 END))::BIGINT AS h, list_grade_up(list_transform(d, lambda x: abs(x))) AS g FROM df) "
        "SELECT track_id, frame_idx AS idx, xor(h, (CASE WHEN f & 1 = 1 THEN 1 << (g[1] - 1) ELSE 0 END + CASE WHEN f & 2 = 2 THEN 1 << (g[2] - 1) ELSE 0 END)::BIGINT) AS hash, f > 0 AS is_variation FROM bt, range(4) r(f)"
    )


@query(_hk_sql())
def fp_haitsma_kalker_small(spark, sf):
    return P.hashes(signal(spark, sf), "hk", BAND, held=_held())


def _wang_sql() -> str:
    p = PEAK
    return (
        f"WITH RECURSIVE {long_frames_sql(p.size, p.hop)}, {windowed_sql('fr', 'Hann', p.size)}, sp AS MATERIALIZED (SELECT track_id, frame_idx, list(20 * log10(magnitude / {p.size // 2} * 2) ORDER BY bin) AS row FROM mg GROUP BY ALL), "
        "em(track_id, f, a) AS (SELECT track_id, frame_idx, row FROM sp WHERE frame_idx = 0 UNION ALL "
        f"SELECT s.track_id, s.frame_idx, list_transform(list_zip(s.row, e.a), lambda x: {p.alpha}::DOUBLE * x[1] + {1 - p.alpha}::DOUBLE * x[2]) FROM em e JOIN sp s ON s.track_id = e.track_id AND s.frame_idx = e.f + 1), "
        f"rs AS (SELECT s.track_id, s.frame_idx, row, list_transform(list_zip(row, a), lambda x: x[1] - x[2] - {p.drop}) AS r FROM sp s JOIN em e ON e.track_id = s.track_id AND e.f = s.frame_idx), "
        f"pk AS (SELECT track_id, frame_idx, k AS bin, r[k + 1] AS rest, row[k + 1] AS energy FROM rs, range({p.size // 2 - 1}) b(k) WHERE (k = 0 OR r[k + 1] > r[k]) AND r[k + 2] < r[k + 1]), "
        f"tp AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY rest DESC, bin) <= {p.peaks}), mx AS (SELECT track_id, max(frame_idx) + 1 AS n FROM sp GROUP BY ALL), "
        f"pr AS (SELECT a.track_id, a.frame_idx, a.bin AS b1, b.bin AS b2, b.frame_idx - a.frame_idx AS d, (a.energy + b.energy) / 2 AS e FROM tp a JOIN mx USING (track_id) JOIN tp b ON b.track_id = a.track_id AND b.frame_idx BETWEEN a.frame_idx + {p.distance} AND a.frame_idx + {p.distance + p.length - 1} "
        f"AND abs(a.bin - b.bin) <= {p.width / 2} WHERE a.frame_idx < n - {p.distance}), kp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY e DESC, b1, b2, d) <= {p.fanout}) "
        "SELECT track_id, frame_idx AS idx, (((b1 & 255) << 16) | ((b2 & 255) << 8) | (d & 255))::BIGINT AS hash, false AS is_variation FROM kp"
    )


@query(_wang_sql())
def fp_wang_small(spark, sf):
    return P.hashes(signal(spark, sf), "wang", PEAK, held=_held())


def _chromaprint_sql() -> str:
    p = CHROMA
    classes = X.chroma_classes(p.rate, p.size, p.low, p.high, p.mapping)
    table = ", ".join(f"({k}, {c})" for k, c in classes)
    width = max(w for (_, _, _, w), _ in p.classifiers)
    smooth = " + ".join(f"{w}::DOUBLE * lead(v, {k}) OVER o" for k, w in enumerate(P.SMOOTHING))

    def area(y, h, x, w):
        return f"coalesce(sum(v) FILTER (c >= {y} AND c < {y + h} AND x >= {x} AND x < {x + w}), 0)" if h > 0 and w > 0 else "0.0"

    def sides(kind, y, h, w):
        t, u = h // 3, w // 3
        if kind == 0:
            return area(y, h, 0, w), "0.0"
        if kind == 1:
            return area(y + h // 2, h - h // 2, 0, w), area(y, h // 2, 0, w)
        if kind == 2:
            return area(y, h, w // 2, w - w // 2), area(y, h, 0, w // 2)
        if kind == 3:
            return f"({area(y + h // 2, h - h // 2, 0, w // 2)} + {area(y, h // 2, w // 2, w - w // 2)})", f"({area(y, h // 2, 0, w // 2)} + {area(y + h // 2, h - h // 2, w // 2, w - w // 2)})"
        if kind == 4:
            return area(y + t, t, 0, w), f"({area(y, t, 0, w)} + {area(y + 2 * t, h - 2 * t, 0, w)})"
        return area(y, h, u, u), f"({area(y, h, 0, u)} + {area(y, h, 2 * u, w - 2 * u)})"

    values = ", ".join("ln(1 + {}) - ln(1 + {}) AS q{}".format(*sides(*box), k) for k, (box, _) in enumerate(p.classifiers))
    gray = "CASE " + " ".join(f"WHEN {{0}} < {{{k + 1}}} THEN {g}" for k, g in enumerate(P.GRAY[:3])) + f" ELSE {P.GRAY[3]} END"
    word = " | ".join(f"(({gray.format(f'q{k}', *bars)})::BIGINT << {2 * (15 - k)})" for k, (_, bars) in enumerate(p.classifiers))
    return (
        f"WITH {long_frames_sql(p.size, p.hop)}, {windowed_sql('fr', p.window, p.size, classes[-1][0] + 1)}, cl(bin, c) AS (VALUES {table}), ch AS (SELECT f.track_id, f.frame_idx, k.c, coalesce(any_value(e.v), 0) AS v FROM fr f CROSS JOIN range(12) k(c) "
        "LEFT JOIN (SELECT track_id, frame_idx, c, sum(magnitude * magnitude) AS v FROM mg JOIN cl USING (bin) GROUP BY ALL) e ON e.track_id = f.track_id AND e.frame_idx = f.frame_idx AND e.c = k.c GROUP BY ALL), "
        f"sm AS (SELECT track_id, frame_idx, c, {smooth} AS v FROM ch WINDOW o AS (PARTITION BY track_id, c ORDER BY frame_idx)), nm AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY track_id, frame_idx)) AS n FROM sm WHERE v IS NOT NULL), "
        f"im AS (SELECT track_id, frame_idx, c, CASE WHEN n < {p.least_norm} THEN 0.0::DOUBLE ELSE v / n END AS v FROM nm), mx AS (SELECT track_id, max(frame_idx) + 1 AS n FROM im GROUP BY ALL), "
        f"st AS (SELECT track_id, unnest(range(0, n - {width} + 1)) AS f FROM mx WHERE n >= {width}), bx AS (SELECT s.track_id, s.f, i.c, i.frame_idx - s.f AS x, i.v FROM st s JOIN im i ON i.track_id = s.track_id AND i.frame_idx >= s.f AND i.frame_idx < s.f + {width}), "
        f"qs AS (SELECT track_id, f, {values} FROM bx GROUP BY ALL) SELECT track_id, f AS idx, {word} AS hash, false AS is_variation FROM qs"
    )


@query(_chromaprint_sql())
def fp_chromaprint_small(spark, sf):
    return P.hashes(signal(spark, sf), "chromaprint", CHROMA, held=_held())


@query(
    f"WITH {DFT}, tp AS (SELECT * FROM mg QUALIFY row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY magnitude DESC, bin) <= 4), "
    f"pr AS (SELECT a.track_id, a.frame_idx AS idx, a.bin AS b1, b.bin AS b2, b.frame_idx - a.frame_idx AS d, a.magnitude + b.magnitude AS e FROM tp a JOIN tp b ON b.track_id = a.track_id AND b.frame_idx BETWEEN a.frame_idx + {PEAK.distance} AND a.frame_idx + {PEAK.distance + PEAK.length - 1} AND abs(a.bin - b.bin) <= {PEAK.width / 2}), "
    f"kp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY track_id, idx ORDER BY e DESC, b1, b2, d) <= {PEAK.fanout}) SELECT track_id, idx, (((b1 & 255) << 16) | ((b2 & 255) << 8) | (d & 255))::BIGINT AS hash FROM kp"
)
def fp_zone_pairs(spark, sf):
    """Pairs of the four loudest bins of frames with those of a zone ahead, as a join."""
    order = Window.partitionBy("track_id", "frame_idx").orderBy(F.desc("magnitude"), "bin")
    peaks = bins(spark, sf).withColumn("rn", F.row_number().over(order)).where("rn <= 4").select("track_id", "frame_idx", "bin", F.col("magnitude").alias("energy"))
    return P.pair_peaks(peaks, PEAK)


def _onset_sql() -> str:
    table = ", ".join(f"({k}, {b})" for k, b in enumerate(X.onset_band_map()))
    return (
        f"WITH {long_frames_sql(2048, 882)}, {windowed_sql('fr', 'Hamming', 2048)}, cl(bin, band) AS (VALUES {table}), si AS (SELECT track_id, frame_idx, sqrt(list_sum(list_transform(v, lambda x: x * x)) / 2048) <= 0.0004 AS silent FROM wv), "
        "en AS (SELECT track_id, frame_idx, band, sum(magnitude * magnitude) AS e FROM mg JOIN cl USING (bin) GROUP BY ALL), "
        "al AS (SELECT si.track_id, si.frame_idx, b.band, silent, coalesce(e, 0) AS e FROM si CROSS JOIN range(84) b(band) LEFT JOIN en ON en.track_id = si.track_id AND en.frame_idx = si.frame_idx AND en.band = b.band), "
        "df AS (SELECT *, CASE WHEN silent THEN 0.0 ELSE greatest(0.0::DOUBLE, e - coalesce(lag(e) OVER (PARTITION BY track_id, band ORDER BY frame_idx), 0)) END AS rise, sum(e) OVER (PARTITION BY track_id, frame_idx) AS total FROM al) "
        "SELECT track_id, frame_idx, band::INT AS band, round(CASE WHEN total > 0 THEN rise / total ELSE rise END, 6) + 0.0 AS rise FROM df"
    )


@query(_onset_sql())
def spec_onset_frames(spark, sf):
    """The 84-band onset spectra of the long signals."""
    return X.onset_spectra(signal(spark, sf), held=_held()).withColumn("rise", rounded(F.col("rise")))


_DTW = (
    f"WITH RECURSIVE {FRAMES}, sq AS MATERIALIZED (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) AS i, list_transform(v, lambda x: abs(x)) AS v, list_sum(list_transform(v, lambda x: abs(x))) AS s FROM fr), "
    "ce AS (SELECT a.track_id AS pair, a.i, b.i AS j, a.s + b.s AS t, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS d FROM sq a JOIN sq b ON b.track_id = a.track_id + 1), "
    "cs AS MATERIALIZED (SELECT pair, i, list(90 * d / t * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (8 + ln(t)) / 10)) ORDER BY j) AS c FROM ce GROUP BY ALL), "
    "rw(pair, i, t) AS (SELECT pair, 0::BIGINT, [0.0::DOUBLE] || list_transform(c, lambda x: 'inf'::DOUBLE) FROM cs WHERE i = 1 UNION ALL "
    "SELECT pair, i, ['inf'::DOUBLE] || list_transform(range(1, len(c) + 1), lambda j: cum[j] + list_min(g[1:j])) FROM ("
    "SELECT pair, i, c, cum, list_transform(range(1, len(c) + 1), lambda j: least(t[j], t[j + 1]) - cum[j] + c[j]) AS g FROM ("
    "SELECT r.pair, k.i, k.c, r.t, list_transform(range(1, len(k.c) + 1), lambda j: list_sum(k.c[1:j])) AS cum FROM rw r JOIN cs k ON k.pair = r.pair AND k.i = r.i + 1))), "
    "tt AS MATERIALIZED (SELECT * FROM rw), bt(pair, i, j, s) AS (SELECT pair, max(i), (SELECT max(j) FROM ce WHERE ce.pair = tt.pair), 0 FROM tt GROUP BY pair UNION ALL "
    "SELECT pair, CASE WHEN i = 0 THEN i WHEN j = 0 OR d = lo OR u = lo THEN i - 1 ELSE i END, CASE WHEN i = 0 THEN j - 1 WHEN j = 0 THEN j WHEN d = lo THEN j - 1 WHEN u = lo THEN j ELSE j - 1 END, s + 1 FROM ("
    "SELECT bt.pair, bt.i, bt.j, bt.s, p.t[bt.j] AS d, p.t[bt.j + 1] AS u, least(p.t[bt.j], p.t[bt.j + 1], q.t[bt.j]) AS lo FROM bt JOIN tt q ON q.pair = bt.pair AND q.i = bt.i LEFT JOIN tt p ON p.pair = bt.pair AND p.i = bt.i - 1 WHERE bt.i > 0 OR bt.j > 0)) "
    "SELECT pair AS pair_id, (row_number() OVER (PARTITION BY pair ORDER BY s DESC) - 1)::INT AS step, i AS i1, j AS i2, i * 200000 AS t1, j * 200000 AS t2 FROM bt"
)


@query(_DTW)
def align_dtw_path(spark, sf):
    """The cheapest paths between neighbouring tracks, every cell of them."""
    return _align("dtw", False)(spark, sf)


def _align(kind, optimize=True):
    def run(spark, sf):
        df = frames(spark, sf).withColumn("values", F.transform("values", lambda x: F.abs(x)))
        next_ = df.select((F.col("track_id") - 1).alias("track_id")).distinct()
        pairs = df.select("track_id").distinct().join(next_, "track_id").select(F.col("track_id").alias("pair_id"), F.col("track_id").alias("track1"), (F.col("track_id") + 1).alias("track2"))
        order = Window.partitionBy("track_id").orderBy("frame_idx")
        return A.align(pairs, df.withColumn("frame_idx", F.row_number().over(order)), kind, optimize=optimize)

    return run


for _kind in A.KERNELS:
    query(None, f"align_{_kind}")(_align(_kind))


@query("SELECT 0::BIGINT AS track_id, i AS idx, round(sin(i * (2 * pi() / (44100 / 440.0::DOUBLE))), 6) + 0.0 AS value FROM range(4410) r(i)")
def src_sine(spark, sf):
    return readers.sine(spark, 44100, 440, 0.1).select("track_id", "idx", rounded(F.col("value")).alias("value"))


@query("SELECT 0::BIGINT AS track_id, i AS idx, 0.0::DOUBLE AS value FROM range(1000) r(i)")
def src_silence(spark, sf):
    return readers.silence(spark, 1000)
