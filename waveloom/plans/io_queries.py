"""Queries of sources and sinks: what is written is read back and compared with the tables it came from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import signal as S
from ..scratch import scratch
from ..sources import readers, sinks
from .inputs import MATCHES, SIGNAL, TRACKS, channels, channels_sql, matches, signal, table, tracks
from .registry import query
from .signal_queries import PEAKS_SQL

def _track():
    """The track that a file is named after."""
    return F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long")


# a track with an odd number of samples lacks the last one of its second channel, which a file holds as silence
_STEREO = f"{channels_sql()}, st AS (SELECT * FROM ch UNION ALL SELECT track_id, 1, max(idx), 0.0 FROM ch GROUP BY track_id HAVING count(*) % 2 = 1)"


def _stereo(spark, sf):
    return channels(spark, sf).withColumn("value", F.col("value") / 100)


def _as_int(df):
    return df.select("track_id", F.col("channel").cast("int").alias("channel"), "idx", F.rint(F.col("value").cast("double") * 32767).cast("long").alias("value"))


@query(f"WITH {_STEREO} SELECT track_id, channel, idx, round_even(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, value / 100)) * 32767, 0)::BIGINT AS value FROM st")
def src_wav(spark, sf):
    """Signals as 16-bit WAV files, opened through the registry of readers."""
    folder = scratch(spark, "wav")
    sinks.write_wav(_stereo(spark, sf), folder, 8000, 16)
    return _as_int(readers.blocks_to_samples(readers.open_signal(spark, folder), _track()))


@query(f"WITH {_STEREO} SELECT track_id, count(*) AS n, round(sum((value / 100)::FLOAT::DOUBLE), 3) + 0.0 AS total FROM st GROUP BY ALL")
def sink_wav_float(spark, sf):
    folder = scratch(spark, "wav")
    sinks.write_wav(_stereo(spark, sf), folder, 8000)
    df = readers.blocks_to_samples(readers.read_wav(spark, folder), _track())
    return df.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("value").cast("double")), 3) + 0.0).alias("total"))


@query("SELECT * FROM (VALUES ('float', true), ('int16', true), ('int24', true), ('empty', false), ('text', false), ('cut', false)) v(name, supported)")
def src_supported(spark, sf):
    v = np.linspace(-1, 1, 7)[:, None]
    files = {"float": sinks.wav_bytes(v, 8000), "int16": sinks.wav_bytes(v, 8000, 16), "int24": sinks.wav_bytes(v, 8000, 24), "empty": b"", "text": b"not a file of sounds", "cut": sinks.wav_bytes(v, 8000)[:30]}
    return spark.createDataFrame([(k, readers.is_supported(x)) for k, x in files.items()], "name string, supported boolean")


@query("SELECT k AS track_id, i AS idx, (i * i - 3.0 * k)::DOUBLE AS value FROM range(1, 4) a(k), range(5) b(i)")
def src_memory(spark, sf):
    return readers.from_arrays(spark, {k: [i * i - 3.0 * k for i in range(5)] for k in range(1, 4)})


@query("SELECT 7::BIGINT AS track_id, i AS idx, 0.0::DOUBLE AS value FROM range(800) r(i)")
def src_dummy(spark, sf):
    """A track without sound of a given length."""
    return readers.sine(spark, 8000, 0, 0.1, 7)


@query(f"WITH {SIGNAL} SELECT track_id, idx::INT AS i, value FROM sig")
def sink_memory(spark, sf):
    return readers.to_arrays(signal(spark, sf)).select("track_id", F.posexplode("values").alias("i", "value"))


_FILES = "fl AS (SELECT n_nationkey AS k, repeat(n_name, 9) AS t FROM nation), ps AS (SELECT *, sum(length(t)) OVER (ORDER BY k) - length(t) AS s FROM fl), ck AS (SELECT s + a AS pos, substr(t, a::INT + 1, 64) AS x FROM (SELECT *, unnest(range(0, length(t), 64)) AS a FROM ps))"


@query(f"WITH {_FILES} SELECT greatest(pos, 100)::BIGINT AS pos, substr(x, greatest(0, 100 - pos)::INT + 1, (least(pos + length(x), 1100) - greatest(pos, 100))::INT) AS content FROM ck WHERE pos < 1100 AND pos + length(x) > 100")
def src_joined_files(spark, sf):
    """A stretch of several files read as one."""
    folder = scratch(spark, "files")
    nation = table(spark, sf, "nation")
    sinks.write_files(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.repeat("n_name", 9).cast("binary").alias("content")), folder)
    paths = [f"{folder}/n{r[0]}" for r in nation.select("n_nationkey").orderBy("n_nationkey").collect()]
    return readers.read_span(readers.join_files(spark, paths, 64), 100, 1000).withColumn("content", F.col("content").cast("string"))


_PLACED = f"{TRACKS}, pl AS (SELECT *, row_number() OVER (ORDER BY track_id) - 1 AS place FROM tr)"


def _project(spark, sf, version=2):
    path = scratch(spark, "project")
    t = tracks(spark, sf).withColumn("file", F.concat("name", F.lit(".wav")))
    warps = t.where("track_id % 3 = 0").select("track_id", F.explode(F.array(F.struct(F.lit(0).alias("f"), F.lit(40).alias("t")), F.struct(F.lit(44100).alias("f"), F.lit(88200).alias("t")))).alias("w"))
    warps = warps.select("track_id", F.col("w.f").cast("long").alias("from_t"), F.col("w.t").cast("long").alias("to_t"))
    sinks.write_project(t, matches(spark, sf).distinct(), path, warps, 0.5, version)
    return path, t


@query(
    f"WITH {_PLACED} SELECT place AS track_id, CASE WHEN track_id % 6 = 0 THEN '(OFFLINE) ' || name ELSE name END AS name, name || '.wav' AS file, length_ticks, offset_ticks, mute, solo, volume, balance, inverted_phase, locked, 0.5::DOUBLE AS master_volume FROM pl"
)
def src_project(spark, sf):
    """A project file written and loaded; sources of some tracks are missing."""
    path, t = _project(spark, sf)
    sources = t.where("track_id % 6 <> 0").select("file")
    found, _, _, settings = readers.read_project(spark, path, sources, allow_offline=True)
    return found.drop("color").crossJoin(settings.select("master_volume"))


@query(f"WITH {MATCHES}, {_PLACED} SELECT DISTINCT a.place AS track1, b.place AS track2, t1, t2, similarity, source FROM m JOIN pl a ON a.track_id = track1 JOIN pl b ON b.track_id = track2")
def sink_project_matches(spark, sf):
    return readers.read_project(spark, _project(spark, sf)[0])[1]


@query(f"WITH {_PLACED} SELECT place AS track_id, round_even(f / 176400.0::DOUBLE * 10000000, 0)::BIGINT AS from_t, round_even(t / 176400.0::DOUBLE * 10000000, 0)::BIGINT AS to_t FROM pl, (VALUES (0, 40), (44100, 88200)) w(f, t) WHERE track_id % 3 = 0")
def src_project_upgrade(spark, sf):
    """Time warps of a project of version 1, in bytes of the sources."""
    path, t = _project(spark, sf, 1)
    sources = t.select("file", F.lit(2).alias("channels"), F.lit(16).alias("bit_depth"), F.lit(44100).alias("sample_rate"))
    return readers.read_project(spark, path, sources)[2]


@query(f"WITH {PEAKS_SQL} SELECT track_id, 0::BIGINT AS channel, peak, low::FLOAT::DOUBLE AS low, high::FLOAT::DOUBLE AS high FROM pk")
def src_peaks(spark, sf):
    folder = scratch(spark, "peaks")
    sinks.write_peaks(S.peak_store(signal(spark, sf), 8).withColumn("channel", F.lit(0)), folder, 77)
    return readers.read_peaks(spark, folder, 1, 77).select(_track().alias("track_id"), "channel", "peak", "low", "high")


@query("SELECT n_name || '*' AS pattern, n_nationkey / 4.0::DOUBLE AS factor FROM nation")
def src_batch_config(spark, sf):
    path = scratch(spark, "config")
    table(spark, sf, "nation").select(F.concat("n_name", F.lit("*;"), (F.col("n_nationkey") / 4.0).cast("string"))).write.text(path)
    return readers.read_batch_config(spark, path)


@query("SELECT c_custkey::INT AS track_id, printf('%.3f %s', c_nationkey * 2.5::DOUBLE, CASE WHEN c_nationkey % 2 = 0 THEN 'MUSIC' ELSE 'NO_MUSIC' END) AS line FROM customer")
def sink_music_log(spark, sf):
    path = scratch(spark, "music")
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").alias("block"), (F.col("c_nationkey") % 2 == 0).alias("is_music"))
    written = sinks.write_music_log(labels, path, 2.5)
    return readers.read_lines(written, path).select(F.substring_index("name", ".", 1).cast("int").alias("track_id"), "line")


@query(f"WITH {TRACKS}, {MATCHES}, h AS (SELECT * FROM tr WHERE volume <> 0) SELECT 'recording' AS kind, track_id AS a, NULL::BIGINT AS b, offset_ticks AS t1, length_ticks AS t2 FROM h UNION ALL SELECT 'point', track1, track2, t1, t2 FROM m JOIN h a ON a.track_id = track1 JOIN h b ON b.track_id = track2")
def sink_sync(spark, sf):
    path = scratch(spark, "sync")
    sinks.write_sync(tracks(spark, sf), matches(spark, sf), path)
    read = lambda tag, folder, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(f"{path}/{folder}")
    a = read("recording", "recordings", "track_id long, offset_ticks long, length_ticks long").select(F.lit("recording").alias("kind"), F.col("track_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("offset_ticks").alias("t1"), F.col("length_ticks").alias("t2"))
    b = read("syncpoint", "syncpoints", "track1 long, track2 long, t1 long, t2 long").select(F.lit("point").alias("kind"), F.col("track1").alias("a"), F.col("track2").alias("b"), "t1", "t2")
    return a.unionByName(b)


@query(
    f"WITH {channels_sql()}, {TRACKS}, heard AS (SELECT * FROM tr WHERE NOT mute AND (solo OR NOT (SELECT bool_or(solo) FROM tr))), "
    "g AS (SELECT channel, idx + offset_ticks // 1000000 AS idx, value / 100 * (volume * CASE WHEN inverted_phase THEN -1.0 ELSE 1.0 END) * CASE WHEN channel = 0 AND balance > 0 THEN 1 - balance "
    "WHEN channel = 1 AND balance < 0 THEN 1 + balance ELSE 1.0 END AS v FROM ch JOIN heard USING (track_id)), mx AS (SELECT channel, idx, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(v))) AS v FROM g GROUP BY ALL), "
    "ix AS (SELECT DISTINCT idx FROM mx), nr AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS i FROM ix) "
    "SELECT c::INT AS channel, i AS idx, round(coalesce(v, 0) * 1009) + 0.0 AS level FROM nr CROSS JOIN range(2) r(c) LEFT JOIN mx ON mx.idx = nr.idx AND mx.channel = c"
)
def sink_render(spark, sf):
    """The mix of a project as a file; a file starts with the first sound and holds no gaps."""
    folder = scratch(spark, "mix")
    t = tracks(spark, sf).withColumn("offset", F.expr("offset_ticks div 1000000"))
    sinks.render(_stereo(spark, sf), t, folder, 8000)
    df = readers.blocks_to_samples(readers.read_wav(spark, folder), _track())
    return df.select(F.col("channel").cast("int").alias("channel"), "idx", (F.round(F.col("value").cast("double") * 1009) + 0.0).alias("level"))


@query("SELECT DISTINCT user_id AS track_id, user_id % 2 = 0 AS made_first, user_id % 2 <> 0 AS made_second, 68 AS name_length FROM events")
def sink_proxies(spark, sf):
    """Copies of half the sources, then of all: only those that are missing are made."""
    folder = scratch(spark, "proxies")
    df = signal(spark, sf).withColumn("channel", F.lit(0))
    files = df.select("track_id").distinct().select("track_id", F.concat(F.lit("/in/"), F.col("track_id").cast("string")).alias("path"), F.lit(1).alias("size"), F.lit(2).alias("modified"))
    first = sinks.proxies(df, files.where("track_id % 2 = 0"), folder, 8000)
    second = sinks.proxies(df, files, folder, 8000)
    both = second.join(first.select("track_id", F.col("made").alias("made_first")), "track_id", "left")
    return both.select("track_id", F.coalesce("made_first", F.lit(False)).alias("made_first"), F.col("made").alias("made_second"), F.length("name").alias("name_length"))


@query("SELECT c_custkey AS track_id, true AS ok FROM customer")
def sink_proxy_name(spark, sf):
    """Names are 64 digits and differ with path, size and time."""
    c = table(spark, sf, "customer").select("c_custkey", *(sinks.proxy_name(F.col("c_name"), s, t).alias(n) for n, s, t in (("a", F.lit("1"), F.lit("2")), ("b", F.lit("1"), F.lit("3")), ("c", F.lit("12"), F.lit("")))))
    return c.select(F.col("c_custkey").alias("track_id"), (F.col("a").rlike("^[0-9a-f]{64}.wav$") & (F.col("a") != F.col("b")) & (F.col("a") != F.col("c"))).alias("ok"))


_EDL = "; ".join(["{}"] * 30)


@query(
    f"WITH {TRACKS}, h AS (SELECT *, row_number() OVER (ORDER BY track_id) AS n FROM tr WHERE volume <> 0), ms AS (SELECT *, printf('%.4f', offset_ticks / 10000.0::DOUBLE) AS o, printf('%.4f', length_ticks / 10000.0::DOUBLE) AS l FROM h) "
    f"SELECT track_id, format('{_EDL}', n, n - 1, o, l, '1.000000', upper(locked::VARCHAR), 'FALSE', '0', 'FALSE', 'FALSE', 'AUDIO', '\"' || name || '\"', '0', '0.0000', l, '0.0000', '0.0000', printf('%.6f', volume), "
    "'2', '0.000000', '-2', '0.000000', '0', '-1', '4', '4', '0.000000', 'FALSE', '0', '0') AS line FROM ms"
)
def sink_edl(spark, sf):
    return sinks.edl_lines(tracks(spark, sf))


@query(f"WITH {SIGNAL} SELECT track_id, idx - 10 AS idx, round(value, 6) + 0.0 AS value, true AS has_source, false AS has_gain FROM sig WHERE idx >= 10 AND idx < 40")
def sig_find_stage(spark, sf):
    """The result of one operator of a chain, found again behind others."""
    chain = S.Chain(signal(spark, sf)).then(S.crop, 10, 40).then(S.invert).then(S.offset, 5)
    found = chain.find("crop")
    return found.select("track_id", "idx", (F.round("value", 6) + 0.0).alias("value"), F.lit(chain.source() is not None).alias("has_source"), F.lit(chain.find("volume") is not None).alias("has_gain"))


@query(f"WITH {SIGNAL} SELECT count(*) AS n, max(abs(value)) AS peak, sum(idx)::BIGINT AS passed FROM sig")
def sig_monitor(spark, sf):
    """What a tap saw while the signal went by."""
    seen = Observation("tap")
    passed = S.monitor(signal(spark, sf), seen).agg(F.sum("idx").alias("passed")).first()[0]
    return spark.createDataFrame([(seen.get["n"], seen.get["peak"], passed)], "n long, peak double, passed long")
