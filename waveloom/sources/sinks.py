"""Sinks: WAV, peak files, projects and edit lists."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import TICKS_PER_SECOND
from ..operators.signal import multitrack
from ..scratch import materialize
from .readers import PEAK_MAGIC, PEAK_VERSION


def wav_bytes(values: np.ndarray, rate: int, bit_depth: int = 32) -> bytes:
    """A WAV file of rows of channels: 32-bit floats, or integers of 16 or 24 bits."""
    channels = values.shape[1] if values.ndim == 2 else 1
    if bit_depth == 32:
        kind, body = 3, values.astype("<f4").tobytes()
    elif bit_depth == 16:
        kind, body = 1, np.rint(np.clip(values, -1, 1) * 32767).astype("<i2").tobytes()
    elif bit_depth == 24:
        raw = np.rint(np.clip(values, -1, 1) * 8388607).astype("<i4")
        kind, body = 1, raw.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    else:
        raise ValueError("bit depth must be 16, 24 or 32")
    block = channels * bit_depth // 8
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, rate, rate * block, block, bit_depth)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(body), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(body)) + body


def encode_wav(df: DataFrame, rate: int, bit_depth: int = 32) -> DataFrame:
    """(track_id, channel, idx, value) -> (track_id, content): a WAV file per track, for any binary sink."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot(index="idx", columns="channel", values="value").sort_index().fillna(0.0)
        return pd.DataFrame({"track_id": [part["track_id"].iloc[0]], "content": [wav_bytes(wide.to_numpy(), rate, bit_depth)]})

    return df.groupBy("track_id").applyInPandas(run, "track_id long, content binary")


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """(name, content) -> files in a folder, written by the tasks that hold them: each first under a name of its own, then renamed, so a
    task that is run again leaves the same files. Any store that Arrow's file systems reach will do. Returns (name, size), once all are written."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        store.create_dir(base)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1)):
                data = content.as_buffer()
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, f"{base}/{name}")
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    out = df.select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "name string, size long")
    return materialize(out, "written")


def write_wav(df: DataFrame, folder: str, rate: int, bit_depth: int = 32) -> DataFrame:
    """A file per track, `<track_id>.wav`."""
    return write_files(encode_wav(df, rate, bit_depth).select(F.concat(F.col("track_id").cast("string"), F.lit(".wav")).alias("name"), "content"), folder)


def write_peaks(peaks: DataFrame, folder: str, modified: int = 0) -> DataFrame:
    """(track_id, channel, peak, low, high) -> a peak file per track, `<track_id>.peaks`."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        low, high = (part.pivot(index="peak", columns="channel", values=c).sort_index().to_numpy() for c in ("low", "high"))
        return pd.DataFrame({"name": [f"{part['track_id'].iloc[0]}.peaks"], "content": [peak_bytes(low, high, modified)]})

    return write_files(peaks.groupBy("track_id").applyInPandas(run, "name string, content binary"), folder)


def proxies(df: DataFrame, files: DataFrame, folder: str, rate: int) -> DataFrame:
    """Decoded copies of sources, made once: files (track_id, path, size, modified) and their samples -> (track_id, name, made). A copy that the
    folder holds already, under the name that the source's path, size and time give, is not made again."""
    spark = df.sparkSession
    named = files.select("track_id", proxy_name(F.col("path"), F.col("size").cast("string"), F.col("modified").cast("string")).alias("name"))
    try:
        known = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    except AnalysisException:  # no copy was ever made
        known = spark.createDataFrame([], "name string")
    # the listing is taken before copies are added to it
    known = materialize(known, "proxies")
    missing = named.join(known, "name", "left_anti")
    contents = encode_wav(df.join(missing.select("track_id"), "track_id", "left_semi"), rate).join(missing, "track_id")
    made = write_files(contents.select("name", "content"), folder)
    return named.join(made.select("name", F.lit(True).alias("made")), "name", "left").select("track_id", "name", F.coalesce("made", F.lit(False)).alias("made"))


def render(df: DataFrame, tracks: DataFrame, folder: str, rate: int, bit_depth: int = 32) -> DataFrame:
    """The mix of a project as one file, `0.wav`."""
    return write_wav(multitrack(df, tracks).withColumn("track_id", F.lit(0).cast("long")), folder, rate, bit_depth)


def proxy_name(path: Column, size: Column, modified: Column) -> Column:
    """Name of a decoded copy: a hash of path, size and time. The text is hashed as UTF-16LE."""
    return F.concat(F.sha2(F.encode(F.concat_ws("|", path, size, modified), "UTF-16LE"), 256), F.lit(".wav"))


def peak_bytes(low: np.ndarray, high: np.ndarray, modified: int = 0) -> bytes:
    """Peaks x channels of minima and maxima as a peak file."""
    return PEAK_MAGIC + struct.pack("<iq", PEAK_VERSION, modified) + np.stack([low, high], 2).astype("<f4").tobytes()


def match_rows(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """Matches as ten columns, with times also in milliseconds."""
    name = lambda k: tracks.select(F.col("track_id").alias(f"track{k}"), F.col("name").alias(f"name{k}"))
    rows = matches.join(name(1), "track1").join(name(2), "track2")
    ms = lambda c: (F.col(c) / (TICKS_PER_SECOND // 1000)).cast("long")
    return rows.select(
        "name1", F.col("t1").alias("time1"), ms("t1").alias("time1_ms"), "name2", F.col("t2").alias("time2"), ms("t2").alias("time2_ms"),
        (F.col("t1") - F.col("t2")).alias("shift"), ((F.col("t1") - F.col("t2")) / (TICKS_PER_SECOND // 1000)).cast("long").alias("shift_ms"), "similarity", "source",
    )


def write_matches(matches: DataFrame, tracks: DataFrame, path: str) -> None:
    match_rows(matches, tracks).write.csv(path, sep=";", header=True)


def span_of_ticks(ticks: Column) -> Column:
    """Ticks as `[-][d.]hh:mm:ss[.fffffff]`."""
    t = F.abs(ticks)
    whole, fraction = (t / TICKS_PER_SECOND).cast("long"), t % TICKS_PER_SECOND
    part = lambda by, of: F.lpad(((whole / by).cast("long") % of).cast("string"), 2, "0")
    days = (whole / 86_400).cast("long")
    clock = F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))
    return F.concat(
        F.when(ticks < 0, "-").otherwise(""), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""), clock,
        F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 7, "0"))).otherwise(""),
    )


def _attribute(name: str, value: Column) -> Column:
    text = value.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.coalesce(F.concat(F.lit(f' {name}="'), text, F.lit('"')), F.lit(""))


def write_project(tracks: DataFrame, matches: DataFrame, path: str, warps: DataFrame | None = None, master_volume: float = 1.0, version: int = 2) -> None:
    """A project: tracks in the order of their ids, with time warps, matches by the tracks' places, and the master volume. An element is a line,
    and lines are sorted over all tasks, so the parts of the folder, in the order of their names, make up the file; none is held as a whole."""
    spark = tracks.sparkSession
    warps = spark.createDataFrame([], "track_id long, from_t long, to_t long") if warps is None else warps
    warp = F.concat(F.lit("<timewarp"), _attribute("from", F.col("from_t")), _attribute("to", F.col("to_t")), F.lit("/>"))
    inner = warps.groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from_t", "to_t", warp.alias("x")))), lambda x: x["x"]), "").alias("w"))
    column = lambda name, other: F.col(name) if name in tracks.columns else other
    attributes = {
        "file": column("file", F.col("name")), "name": F.col("name"), "color": column("color", F.lit(None).cast("string")), "length": span_of_ticks(F.col("length_ticks")), "offset": span_of_ticks(F.col("offset_ticks")),
        "mute": F.col("mute"), "solo": F.col("solo"), "volume": F.col("volume"), "balance": F.col("balance"), "invertedphase": F.col("inverted_phase"), "locked": F.col("locked"),
    }
    track = F.concat(F.lit("<track"), *(_attribute(k, v) for k, v in attributes.items()), F.lit("><timewarps>"), F.coalesce("w", F.lit("")), F.lit("</timewarps></track>"))
    listed = tracks.join(inner, "track_id", "left")
    place = tracks.select("track_id", (F.row_number().over(Window.orderBy("track_id")) - 1).alias("place"))
    at = lambda k: place.select(F.col("track_id").alias(f"track{k}"), F.col("place").alias(f"place{k}"))
    attributes = {"track1": F.col("place1"), "track1time": span_of_ticks(F.col("t1")), "track2": F.col("place2"), "track2time": span_of_ticks(F.col("t2")), "similarity": F.col("similarity"), "source": F.col("source")}
    match = F.concat(F.lit("<match"), *(_attribute(k, v) for k, v in attributes.items()), F.lit("/>"))
    found = matches.join(at(1), "track1").join(at(2), "track2")
    keys = ("a", "b", "t1", "t2")
    none = {c: F.lit(None).cast("long").alias(c) for c in keys}
    line = lambda section, df, value, **own: df.select(F.lit(section).alias("section"), *(own.get(c, none[c]).alias(c) for c in keys), value.alias("value"))
    frame = ((0, f"<project><format>{version}</format><audiotracks>"), (2, "</audiotracks><matches>"), (4, f"</matches><mastervolume>{master_volume}</mastervolume></project>"))
    lines = line(1, listed, track, a=F.col("track_id").cast("long")).unionByName(line(3, found, match, a=F.col("place1").cast("long"), b=F.col("place2").cast("long"), t1=F.col("t1"), t2=F.col("t2")))
    for section, text in frame:
        lines = lines.unionByName(line(section, spark.range(1), F.lit(text)))
    lines.orderBy("section", *keys, "value").select("value").write.text(path)


def write_sync(tracks: DataFrame, matches: DataFrame, path: str) -> None:
    """Recordings that can be heard, and their sync points."""
    heard = tracks.where("volume <> 0")
    heard.select("track_id", "name", "offset_ticks", "length_ticks").write.format("xml").option("rootTag", "recordings").option("rowTag", "recording").save(f"{path}/recordings")
    points = matches.join(heard.select(F.col("track_id").alias("track1")), "track1", "left_semi").join(heard.select(F.col("track_id").alias("track2")), "track2", "left_semi")
    points.write.format("xml").option("rootTag", "syncpoints").option("rowTag", "syncpoint").save(f"{path}/syncpoints")


#: Fixed names: columns of an edit list, in order.
EDL_COLUMNS = (
    "ID", "Track", "StartTime", "Length", "PlayRate", "Locked", "Normalized", "StretchMethod", "Looped", "OnRuler", "MediaType", "FileName", "Stream", "StreamStart",
    "StreamLength", "FadeTimeIn", "FadeTimeOut", "SustainGain", "CurveIn", "GainIn", "CurveOut", "GainOut", "Layer", "Color", "CurveInR", "CurveOutR", "PlayPitch", "LockPitch", "FirstChannel", "Channels",
)


def edl_lines(tracks: DataFrame) -> DataFrame:
    """One line per audible track of 30 fields; times in milliseconds."""
    ms = lambda c: F.format_string("%.4f", F.col(c) / (TICKS_PER_SECOND / 1000))
    n = F.row_number().over(Window.orderBy("track_id"))
    fields = {
        "ID": n, "Track": n - 1, "StartTime": ms("offset_ticks"), "Length": ms("length_ticks"), "PlayRate": F.lit("1.000000"), "Locked": F.upper(F.col("locked").cast("string")),
        "Normalized": F.lit("FALSE"), "StretchMethod": F.lit("0"), "Looped": F.lit("FALSE"), "OnRuler": F.lit("FALSE"), "MediaType": F.lit("AUDIO"), "FileName": F.format_string('"%s"', "name"),
        "Stream": F.lit("0"), "StreamStart": F.lit("0.0000"), "StreamLength": ms("length_ticks"), "FadeTimeIn": F.lit("0.0000"), "FadeTimeOut": F.lit("0.0000"),
        "SustainGain": F.format_string("%.6f", F.col("volume").cast("double")), "CurveIn": F.lit("2"), "GainIn": F.lit("0.000000"), "CurveOut": F.lit("-2"), "GainOut": F.lit("0.000000"),
        "Layer": F.lit("0"), "Color": F.lit("-1"), "CurveInR": F.lit("4"), "CurveOutR": F.lit("4"), "PlayPitch": F.lit("0.000000"), "LockPitch": F.lit("FALSE"), "FirstChannel": F.lit("0"), "Channels": F.lit("0"),
    }
    return tracks.where("volume <> 0").select("track_id", F.concat_ws("; ", *(fields[c].cast("string") for c in EDL_COLUMNS)).alias("line"))


def write_edl(tracks: DataFrame, path: str) -> None:
    header = tracks.sparkSession.createDataFrame([(None, ";".join(f'"{c}"' for c in EDL_COLUMNS))], "track_id long, line string")
    header.unionByName(edl_lines(tracks)).coalesce(1).sortWithinPartitions(F.col("track_id").asc_nulls_first()).select(F.col("line").alias("value")).write.text(path)


def write_music_log(labels: DataFrame, path: str, seconds_per_block: float) -> DataFrame:
    """A log per track, `<track_id>.txt`, of a line per block in order, written by the tasks that hold them: (name, size), which readers.read_lines() takes."""
    line = F.format_string("%.3f %s\n", F.col("block") * seconds_per_block, F.when(F.col("is_music"), "MUSIC").otherwise("NO_MUSIC"))
    logs = labels.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("block", line.alias("x")))).alias("v"))
    return write_files(logs.select(F.concat(F.col("track_id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.array_join("v.x", ""), "UTF-8").alias("content")), path)
