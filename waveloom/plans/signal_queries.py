"""Queries of sample-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import resample as R
from ..operators import signal as S
from .inputs import SIGNAL, TRACKS, channels, channels_sql, rounded, signal, table, tracks
from .registry import query

V = "round({}, 6) + 0.0 AS value"


def _out(df, *keys):
    return df.select(*keys, rounded(F.col("value")).alias("value"))


@query(f"WITH {SIGNAL} SELECT track_id, idx, round(round(value * 100) / 32767.0::DOUBLE, 6) + 0.0 AS value FROM sig")
def sig_pcm16(spark, sf):
    return _out(S.pcm16(signal(spark, sf).withColumn("value", F.round(F.col("value") * 100))), "track_id", "idx")


@query(f"WITH {SIGNAL} SELECT track_id, idx, round(round(value * 1000) * 256 / 2147483648.0::DOUBLE, 9) + 0.0 AS value FROM sig")
def sig_pcm24(spark, sf):
    df = S.pcm24(signal(spark, sf).withColumn("value", F.round(F.col("value") * 1000)))
    return df.select("track_id", "idx", rounded(F.col("value"), 9).alias("value"))


@query(f"WITH {channels_sql()}, mo AS (SELECT track_id, idx, sum(value / 2) AS v FROM ch GROUP BY ALL) SELECT track_id, c::INT AS channel, idx, {V.format('v')} FROM mo, range(3) r(c)")
def sig_mono(spark, sf):
    return _out(S.mono(channels(spark, sf), 2, 3), "track_id", "channel", "idx")


def _surround_sql(n):
    pick = lambda side: " + ".join(f"coalesce(sum(value) FILTER (channel = {c}), 0) * {float(f[side])}::DOUBLE" for c, f in S.SURROUND[n].items() if f[side])
    return (
        f"WITH {channels_sql(n)}, lr AS (SELECT track_id, idx, {pick(0)} AS l, {pick(1)} AS r FROM ch WHERE channel <> {3 if n > 4 else 99} GROUP BY ALL) "
        f"SELECT track_id, 0 AS channel, idx, {V.format('l')} FROM lr UNION ALL SELECT track_id, 1, idx, {V.format('r')} FROM lr"
    )


for _n in S.SURROUND:
    query(_surround_sql(_n), f"sig_surround_{_n}")(lambda spark, sf, n=_n: _out(S.surround_downmix(channels(spark, sf, n), n), "track_id", "channel", "idx"))


@query(f"WITH {SIGNAL} SELECT track_id % 8 AS mix_id, idx, {V.format('sum(value)')} FROM sig GROUP BY 1, 2")
def sig_mix(spark, sf):
    return _out(S.mix(signal(spark, sf), F.col("track_id") % 8), "mix_id", "idx")


@query(
    f"WITH {SIGNAL}, n AS (SELECT track_id % 8 AS mix_id, track_id, max(idx) + 1 AS n FROM sig GROUP BY ALL), "
    "st AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY mix_id ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n) "
    "SELECT mix_id, idx + start AS idx, round(value, 6) + 0.0 AS value FROM sig JOIN st USING (track_id)"
)
def sig_concat(spark, sf):
    return _out(S.concatenate(signal(spark, sf), F.col("track_id") % 8), "mix_id", "idx")


@query(f"WITH {SIGNAL} SELECT track_id, idx - 10 AS idx, {V.format('value')} FROM sig WHERE idx >= 10 AND idx < 40")
def sig_crop(spark, sf):
    return _out(S.crop(signal(spark, sf), 10, 40), "track_id", "idx")


@query(f"WITH {SIGNAL} SELECT track_id, idx + 5 AS idx, {V.format('value')} FROM sig UNION ALL SELECT track_id, z, 0.0 FROM (SELECT DISTINCT track_id FROM sig), range(5) r(z)")
def sig_offset(spark, sf):
    return _out(S.offset(signal(spark, sf), 5), "track_id", "idx")


@query(f"WITH {SIGNAL} SELECT track_id, idx, {V.format('value + 0.2::DOUBLE')} FROM sig")
def sig_dc_offset(spark, sf):
    return _out(S.dc_offset(signal(spark, sf), 0.2), "track_id", "idx")


@query(f"WITH {SIGNAL} SELECT track_id, idx, {V.format('-value')} FROM sig")
def sig_invert(spark, sf):
    return _out(S.invert(signal(spark, sf)), "track_id", "idx")


@query(f"WITH {SIGNAL} SELECT track_id, idx, {V.format('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 100))')} FROM sig")
def sig_clip(spark, sf):
    return _out(S.clip(signal(spark, sf).withColumn("value", F.col("value") / 100)), "track_id", "idx")


@query(f"WITH {channels_sql()} SELECT track_id, channel, idx, {V.format('value * CASE WHEN channel = 0 THEN 0.75 * 0.5 ELSE 0.5 END::DOUBLE')} FROM ch")
def sig_volume_balance(spark, sf):
    return _out(S.volume(channels(spark, sf), 0.5, 0.25), "track_id", "channel", "idx")


@query(f"WITH {channels_sql()} SELECT track_id, channel, floor(idx * 2 / 16.0)::BIGINT AS run, round(max(abs(value)), 6) AS peak FROM ch GROUP BY ALL")
def sig_meter(spark, sf):
    return S.meter(channels(spark, sf), 16, 2).select("track_id", "channel", F.col("run").cast("long").alias("run"), F.round("peak", 6).alias("peak"))


@query(f"WITH {SIGNAL} SELECT track_id, round(sqrt(avg(value * value)), 6) AS rms FROM sig GROUP BY ALL")
def sig_rms(spark, sf):
    return S.rms(signal(spark, sf), "track_id").select("track_id", F.round("rms", 6).alias("rms"))


@query(f"WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM sig) SELECT track_id, idx * 10 // n AS bucket, min(value) AS low, max(value) AS high FROM n GROUP BY ALL")
def sig_display_peaks(spark, sf):
    return S.display_peaks(signal(spark, sf), 10)


PEAKS_SQL = (
    f"{SIGNAL}, own AS (SELECT track_id, idx // 8 AS peak, value FROM sig UNION ALL SELECT s.track_id, s.idx // 8 + 1, s.value FROM sig s "
    "WHERE s.idx % 8 = 7 AND EXISTS (SELECT 1 FROM sig t WHERE t.track_id = s.track_id AND t.idx = s.idx + 1)), pk AS (SELECT track_id, peak, min(value) AS low, max(value) AS high FROM own GROUP BY ALL)"
)


@query(f"WITH {PEAKS_SQL} SELECT * FROM pk")
def sig_peak_store(spark, sf):
    return S.peak_store(signal(spark, sf), 8)


@query(f"WITH {PEAKS_SQL} SELECT track_id, greatest(0, ceil(peak / 4.0) - 1)::BIGINT AS peak, min(low) AS low, max(high) AS high FROM pk GROUP BY ALL")
def sig_peak_pyramid(spark, sf):
    return S.peak_pyramid(S.peak_store(signal(spark, sf), 8), 1, 4)


@query(f"WITH {SIGNAL} SELECT track_id, least(count(*), 20) AS n_equal FROM sig GROUP BY ALL")
def sig_equal_prefix(spark, sf):
    df = signal(spark, sf)
    return S.equal_prefix(df, df.withColumn("value", F.when(F.col("idx") >= 20, F.col("value") + 1).otherwise(F.col("value"))))


@query(f"WITH {TRACKS} SELECT t, track_id FROM tr, (SELECT i * 5000000 AS t FROM range(20) r(i)) WHERE offset_ticks <= t AND t <= offset_ticks + length_ticks")
def sig_at_position(spark, sf):
    return S.at_position(tracks(spark, sf), spark.range(20).select((F.col("id") * 5_000_000).alias("t"))).select("t", "track_id")


@query(f'WITH {TRACKS} SELECT min(offset_ticks) AS start, max(offset_ticks + length_ticks) AS "end", sum(length_ticks)::BIGINT AS total FROM tr')
def sig_timeline(spark, sf):
    return S.timeline(tracks(spark, sf))


@query(
    f"WITH {channels_sql()}, {TRACKS}, heard AS (SELECT * FROM tr WHERE NOT mute AND (solo OR NOT (SELECT bool_or(solo) FROM tr))), "
    "g AS (SELECT channel, idx + offset_ticks // 1000000 AS idx, value * (volume * CASE WHEN inverted_phase THEN -1.0 ELSE 1.0 END) * CASE WHEN channel = 0 AND balance > 0 THEN 1 - balance "
    "WHEN channel = 1 AND balance < 0 THEN 1 + balance ELSE 1.0 END AS v FROM ch JOIN heard USING (track_id)) "
    "SELECT channel, idx, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(v))), 6) + 0.0 AS value FROM g GROUP BY ALL"
)
def sig_multitrack(spark, sf):
    t = tracks(spark, sf).withColumn("offset", F.expr("offset_ticks div 1000000"))
    return _out(S.multitrack(channels(spark, sf), t), "channel", "idx")


@query(
    f"WITH {SIGNAL}, p AS (SELECT DISTINCT track_id, unnest([10 + track_id % 5, 30 + track_id % 7]) AS at FROM sig) "
    "SELECT s.track_id, count(p.at)::INT AS slice, s.idx - coalesce(max(p.at), 0) AS idx, round(any_value(s.value), 6) + 0.0 AS value FROM sig s LEFT JOIN p ON p.track_id = s.track_id AND p.at <= s.idx GROUP BY s.track_id, s.idx"
)
def sig_cut(spark, sf):
    df = signal(spark, sf)
    cuts = df.select("track_id").distinct().select("track_id", F.explode(F.array(10 + F.col("track_id") % 5, 30 + F.col("track_id") % 7)).alias("at"))
    return _out(S.cut(df, cuts), "track_id", "slice", "idx")


@query(
    f"WITH {TRACKS}, iv AS (SELECT track_id, offset_ticks AS a, offset_ticks + length_ticks AS b, track_id * 3000000 % 90000000 AS c FROM tr) "
    "SELECT track_id, (a < c + 5000000 AND c < b) AS touches, (a <= c AND c <= b) AS holds, CASE WHEN a < c + 5000000 AND c < b THEN greatest(a, c) END AS cut_from, "
    "CASE WHEN a < c + 5000000 AND c < b THEN least(b, c + 5000000) END AS cut_to, CASE WHEN a < c AND c < b THEN 2 ELSE 1 END AS parts FROM iv"
)
def sig_intervals(spark, sf):
    rows = tracks(spark, sf).select("track_id", F.col("offset_ticks").alias("a"), (F.col("offset_ticks") + F.col("length_ticks")).alias("b"), (F.col("track_id") * 3_000_000 % 90_000_000).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    common = C.intersection(a, b, c, c + 5_000_000)
    return rows.select(
        "track_id", C.intersects(a, b, c, c + 5_000_000).alias("touches"), C.contains(a, b, c).alias("holds"), common["from"].alias("cut_from"), common["to"].alias("cut_to"), F.size(C.divide(a, b, c)).alias("parts")
    )


@query(f"WITH {TRACKS} SELECT track_id, round_even(offset_ticks / (10000000 / 44100.0::DOUBLE), 0)::BIGINT AS samples, round_even(track_id * (64 / 5512.0::DOUBLE) * 10000000, 0)::BIGINT AS ticks, bit_count(xor(track_id, 12345))::INT AS distance, (((track_id & 255) << 16) | (((track_id * 3) & 255) << 8) | ((track_id * 7) & 255)) AS packed FROM tr")
def sig_times_and_bits(spark, sf):
    t = F.col("track_id")
    return tracks(spark, sf).select(
        "track_id", C.ticks_to_samples(F.col("offset_ticks"), 44100).alias("samples"), C.index_to_ticks(t, 64 / 5512).alias("ticks"), C.hamming(t, F.lit(12345).cast("long")).cast("int").alias("distance"),
        C.pack_peaks(t, t * 3, t * 7).alias("packed"),
    )


_LINE = f"{SIGNAL}, ln AS (SELECT *, lead(value) OVER (PARTITION BY track_id ORDER BY idx) AS nx, count(*) OVER (PARTITION BY track_id) AS n FROM sig)"


@query(
    f"WITH {_LINE} SELECT track_id, o AS idx, round(value + (coalesce(nx, value) - value) * (o / 1.5::DOUBLE - idx), 6) + 0.0 AS value FROM "
    "(SELECT *, unnest(range(ceil(idx * 1.5)::BIGINT, least(ceil((idx + 1) * 1.5), ceil(n * 1.5))::BIGINT)) AS o FROM ln)"
)
def sig_resample_linear(spark, sf):
    return _out(R.resample(signal(spark, sf), 1.5), "track_id", "idx")


@query(f"WITH {_LINE} SELECT track_id, o AS idx, round(value, 6) + 0.0 AS value FROM (SELECT *, unnest(range(ceil(idx * 0.5)::BIGINT, least(ceil((idx + 1) * 0.5), ceil(n * 0.5))::BIGINT)) AS o FROM ln)")
def sig_resample_hold(spark, sf):
    return _out(R.resample(signal(spark, sf), 0.5, "hold"), "track_id", "idx")


_SINC = (
    f"{SIGNAL}, n AS (SELECT track_id, count(*) AS n FROM sig GROUP BY ALL), o AS (SELECT track_id, unnest(range(0, ceil(n * 0.75 - 1e-9)::BIGINT)) AS o FROM n), "
    "x AS (SELECT o.track_id, o, (o / 0.75::DOUBLE - s.idx) * 0.75::DOUBLE AS x, value FROM o JOIN sig s ON s.track_id = o.track_id AND s.idx BETWEEN floor(o / 0.75::DOUBLE) - 22 AND floor(o / 0.75::DOUBLE) + 22)"
)


@query(
    f"WITH {_SINC} SELECT track_id, o AS idx, round(sum(CASE WHEN abs(x) < 16 THEN value * 0.75::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * x / 16)) * CASE WHEN abs(x) < 1e-12 THEN 1.0::DOUBLE ELSE sin(pi() * x) / (pi() * x) END ELSE 0.0::DOUBLE END), 6) + 0.0 AS value FROM x GROUP BY ALL"
)
def sig_resample_sinc(spark, sf):
    return _out(R.resample_sinc(signal(spark, sf), 0.75, grade="medium"), "track_id", "idx")


WARPS_SQL = "wp AS (SELECT user_id AS track_id, (k * 20)::BIGINT AS from_t, (k * (15 + user_id % 11))::BIGINT + 3 AS to_t FROM (SELECT DISTINCT user_id FROM events), range(1, 4) r(k))"
_SEG = f"{WARPS_SQL}, sg AS (SELECT *, lead(from_t) OVER w AS nf, lead(to_t) OVER w AS nt, row_number() OVER w AS n FROM wp WINDOW w AS (PARTITION BY track_id ORDER BY from_t, to_t))"


def warps(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("track_id")).distinct()
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))
    return ids.withColumn("k", k).select("track_id", (F.col("k") * 20).alias("from_t"), (F.col("k") * (15 + F.col("track_id") % 11) + 3).alias("to_t"))


@query(
    f"WITH {SIGNAL}, {_SEG} SELECT s.track_id, s.idx AS t, CASE WHEN t.from_t <= s.idx AND nf IS NOT NULL THEN to_t + trunc((s.idx - from_t) * ((nt - to_t)::DOUBLE / (nf - from_t)))::BIGINT ELSE s.idx + to_t - from_t END AS t_out "
    "FROM sig s JOIN sg t ON s.track_id = t.track_id AND (s.idx >= t.from_t OR n = 1) AND (nf IS NULL OR s.idx < nf)"
)
def sig_warp_translate(spark, sf):
    return R.translate(signal(spark, sf).select("track_id", F.col("idx").alias("t")), warps(spark, sf))


@query(f"WITH {_SEG} SELECT track_id, from_t, to_t FROM sg WHERE nf IS NOT NULL AND (nt < to_t OR (nt - to_t)::DOUBLE / (nf - from_t) > 1.2 OR (nt - to_t)::DOUBLE / (nf - from_t) < 1 / 1.2::DOUBLE)")
def sig_warp_faults(spark, sf):
    return R.warp_faults(warps(spark, sf), 1.2).select("track_id", "from_t", "to_t")


_MOVED = (
    "mv AS (SELECT p.track_id, p.t, CASE WHEN g.from_t <= p.t AND nf IS NOT NULL THEN to_t + trunc((p.t - from_t) * ((nt - to_t)::DOUBLE / (nf - from_t)))::BIGINT ELSE p.t + to_t - from_t END AS o "
    "FROM (SELECT track_id, idx AS t FROM sig UNION SELECT track_id, max(idx) + 1 FROM sig GROUP BY ALL) p JOIN sg g ON g.track_id = p.track_id AND (p.t >= g.from_t OR n = 1) AND (nf IS NULL OR p.t < nf))"
)


@query(
    f"WITH {SIGNAL}, {_SEG}, {_MOVED}, b AS (SELECT s.track_id, s.value, lead(s.value) OVER (PARTITION BY s.track_id ORDER BY s.idx) AS nx, a.o AS o1, c.o AS o2 FROM sig s JOIN mv a ON a.track_id = s.track_id AND a.t = s.idx JOIN mv c ON c.track_id = s.track_id AND c.t = s.idx + 1) "
    "SELECT track_id, o AS idx, round(value + (coalesce(nx, value) - value) * ((o - o1) / (o2 - o1)::DOUBLE), 6) + 0.0 AS value FROM (SELECT *, unnest(range(o1, o2)) AS o FROM b WHERE o2 > o1)"
)
def sig_warp(spark, sf):
    return _out(R.warp(signal(spark, sf), warps(spark, sf)), "track_id", "idx")


@query(
    f"WITH {SIGNAL}, z AS (SELECT track_id, count(*) AS n FROM sig GROUP BY ALL), mv AS (SELECT s.track_id, t, CASE WHEN t < 20 THEN t * 2 WHEN t = n THEN rint_ ELSE 40 + trunc((t - 20) * ((rint_ - 40)::DOUBLE / (n - 20)))::BIGINT END AS o, value, nx FROM "
    "(SELECT s.track_id, s.idx AS t, value, lead(value) OVER (PARTITION BY s.track_id ORDER BY idx) AS nx, n, round_even(40 + (n - 20) * 0.5::DOUBLE, 0)::BIGINT AS rint_ FROM (SELECT track_id, idx, value FROM sig UNION ALL SELECT track_id, n, NULL FROM z) s JOIN z USING (track_id)) s), "
    "b AS (SELECT *, lead(o) OVER (PARTITION BY track_id ORDER BY t) AS o2 FROM mv) SELECT track_id, i AS idx, round(value + (coalesce(nx, value) - value) * ((i - o) / (o2 - o)::DOUBLE), 6) + 0.0 AS value FROM (SELECT *, unnest(range(o, o2)) AS i FROM b WHERE o2 > o)"
)
def sig_resample_variable(spark, sf):
    """Twice the rate for 20 samples, half of it from there on."""
    steps = signal(spark, sf).select("track_id").distinct().select("track_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("idx"), F.lit(2.0).alias("ratio")), F.struct(F.lit(20).cast("long").alias("idx"), F.lit(0.5).alias("ratio")))).alias("s"))
    return _out(R.resample_variable(signal(spark, sf), steps.select("track_id", "s.idx", "s.ratio")), "track_id", "idx")


_STEP = "(10000000 / 44100.0::DOUBLE)"


@query(f"WITH {TRACKS} SELECT track_id, trunc(floor(offset_ticks / {_STEP}) * {_STEP})::BIGINT AS a, trunc(ceil((offset_ticks + length_ticks) / {_STEP}) * {_STEP})::BIGINT AS b FROM tr")
def sig_align_to_samples(spark, sf):
    a, b = C.align_to_samples(F.col("offset_ticks"), F.col("offset_ticks") + F.col("length_ticks"), 44100)
    return tracks(spark, sf).select("track_id", a.alias("a"), b.alias("b"))


@query(
    f"WITH {SIGNAL}, p AS (SELECT track_id, idx, abs(value) / 100 + 0.001 AS v FROM sig) SELECT track_id, idx, round(20 * log10(v), 6) + 0.0 AS db, round(pow(10.0::DOUBLE, v / 20), 6) AS lin, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (20 * log10(v) + 60) / 60)), 6) + 0.0 AS share FROM p"
)
def sig_decibel(spark, sf):
    v = F.abs("value") / 100 + 0.001
    return signal(spark, sf).select("track_id", "idx", rounded(C.to_db(v)).alias("db"), F.round(C.from_db(v), 6).alias("lin"), rounded(C.db_percent(C.to_db(v))).alias("share"))


@query(f"WITH {SIGNAL} SELECT track_id, min(idx * 3 % 17) AS low, max(idx * 3 % 17) AS high, (sum(idx * 3 % 17) // count(*))::BIGINT AS mean FROM sig GROUP BY ALL")
def sig_min_max_mean(spark, sf):
    df = signal(spark, sf).groupBy("track_id").agg(F.collect_list(F.col("idx") * 3 % 17).alias("v"))
    return df.select("track_id", C.min_max_mean(F.col("v")).alias("m")).select("track_id", F.col("m.min").alias("low"), F.col("m.max").alias("high"), F.col("m.mean").alias("mean"))


@query(f"WITH {channels_sql()}, mo AS (SELECT track_id, idx, sum(value / 2) AS value FROM ch GROUP BY ALL), ln AS (SELECT *, lead(value) OVER (PARTITION BY track_id ORDER BY idx) AS nx, count(*) OVER (PARTITION BY track_id) AS n FROM mo) "
    "SELECT track_id, o AS idx, round(value + (coalesce(nx, value) - value) * (o / 0.75::DOUBLE - idx), 6) + 0.0 AS value FROM (SELECT *, unnest(range(ceil(idx * 0.75)::BIGINT, least(ceil((idx + 1) * 0.75), ceil(n * 0.75))::BIGINT)) AS o FROM ln)")
def corr_prepare(spark, sf):
    """Stereo signals made mono and brought to another rate, as correlation asks for."""
    from ..operators.correlation import prepare

    return _out(prepare(channels(spark, sf), 2, 8000, 6000), "track_id", "idx")


@query(
    f"WITH {TRACKS} SELECT track_id, round_even(44100 * 1.5, 0)::INT AS sample_rate, round_even(length_ticks * 44100 / 66150.0::DOUBLE, 0)::BIGINT AS length_ticks FROM tr"
)
def sig_relabel_rate(spark, sf):
    return S.relabel_rate(tracks(spark, sf).withColumn("sample_rate", F.lit(44100)), 1.5).select("track_id", "sample_rate", "length_ticks")


@query(
    f"WITH {SIGNAL}, p AS (SELECT track_id, idx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS p FROM sig), c AS (SELECT *, CASE WHEN p <= 0.5 THEN p / 0.5 * 255 ELSE 255.0 END AS r, CASE WHEN p <= 0.5 THEN 0.0 ELSE (p - 0.5) / 0.5 * 255 END AS g FROM p) "
    "SELECT track_id, idx, trunc(r)::INT * 65536 + trunc(g)::INT * 256 AS colour FROM c"
)
def sig_colours(spark, sf):
    position = C.unit_clamp(F.col("value"), 0.0, 100.0)
    return signal(spark, sf).select("track_id", "idx", C.gradient(position, [(0.0, (0, 0, 0)), (0.5, (255, 0, 0)), (1.0, (255, 255, 0))]).alias("colour"))
