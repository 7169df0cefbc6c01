"""Spectra of frames (track_id, frame_idx, values).

dft() is a join with a small basis table and a sum: plain SQL, for short frames. stft() uses numpy's FFT on Arrow batches
for long ones. Both give bins 0 .. N/2 - 1 of the real transform; the Nyquist bin is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SILENCE, spectrum_db
from .windows import WindowConfig, frames

FORMATS = ("complex", "magnitude", "squared", "polar", "decibel")


def dft(df: DataFrame, size: int) -> DataFrame:
    """Frames -> (track_id, frame_idx, bin, re, im), one row a bin. Frames shorter than `size` count as padded with zeros."""
    basis = [(k, [math.cos(2 * math.pi * k * i / size) for i in range(size)], [-math.sin(2 * math.pi * k * i / size) for i in range(size)]) for k in range(size // 2)]
    table = F.array(*(F.struct(F.lit(k).alias("bin"), F.array(*map(F.lit, c)).alias("c"), F.array(*map(F.lit, s)).alias("s")) for k, c, s in basis))
    dot = lambda v, b: F.aggregate(F.zip_with(v, b, lambda x, y: x.cast("double") * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    rows = df.select("track_id", "frame_idx", "values", F.explode(table).alias("b"))
    return rows.select("track_id", "frame_idx", F.col("b.bin").alias("bin"), dot(F.col("values"), F.col("b.c")).alias("re"), dot(F.col("values"), F.col("b.s")).alias("im"))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def from_polar(r: Column, angle: Column) -> Column:
    return F.struct((r * F.cos(angle)).alias("re"), (r * F.sin(angle)).alias("im"))


def stft(df: DataFrame, config: WindowConfig, fft_size: int | None = None, fmt: str = "magnitude") -> DataFrame:
    """Frames -> spectra (track_id, frame_idx, bins), windowed and padded on the right to fft_size.

    complex and polar spectra interleave (re, im) and (magnitude, phase).
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    size = fft_size or config.size
    window = np.array(config.values())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.array(batch.column(2).to_pylist(), float) * window
            z = np.fft.rfft(values, size, axis=1)[:, : size // 2]
            out = spectrum(z, fmt, size // 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out.astype(float)))], ["track_id", "frame_idx", "bins"])

    return df.select(F.col("track_id").cast("long"), F.col("frame_idx").cast("long"), "values").mapInArrow(run, "track_id long, frame_idx long, bins array<double>")


def spectrum(z: np.ndarray, fmt: str, n_bins: int) -> np.ndarray:
    if fmt == "complex":
        return np.stack([z.real, z.imag], 2).reshape(len(z), -1)
    m = np.abs(z)
    if fmt == "polar":
        return np.stack([m, np.angle(z)], 2).reshape(len(z), -1)
    if fmt == "squared":
        return m * m
    if fmt == "decibel":
        return np.where(m > 0, 20 * np.log10(np.maximum(m, 1e-300) / n_bins * 2), SILENCE)
    return m


def inverse_stft(df: DataFrame, size: int, synthesis: WindowConfig | None = None) -> DataFrame:
    """Complex spectra (without Nyquist) -> frames, scaled by 1/N, times the synthesis window."""
    window = np.array(synthesis.values()) if synthesis else np.ones(size)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, -1, 2)
            z = np.concatenate([flat[..., 0] + 1j * flat[..., 1], np.zeros((batch.num_rows, 1))], 1)
            values = np.fft.irfft(z, size, axis=1)[:, : len(window)] * window
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(values))], ["track_id", "frame_idx", "values"])

    return df.select("track_id", "frame_idx", "bins").mapInArrow(run, "track_id long, frame_idx long, values array<double>")


def remove_dc(frame: Column) -> Column:
    mean = F.aggregate(frame, F.lit(0.0), lambda a, x: a + x) / F.size(frame)
    return F.transform(F.array(mean), lambda m: F.transform(frame, lambda x: x - m))[0]


def normalized_db(df: DataFrame) -> DataFrame:
    """Bin rows with `magnitude` -> also db, relative to the frame's largest; silence for 0."""
    top = F.max("magnitude").over(Window.partitionBy("track_id", "frame_idx"))
    return df.withColumn("db", F.when(F.col("magnitude") <= 0, F.lit(SILENCE)).otherwise(20 * F.log10(F.col("magnitude") / top)))


def peak_bin(df: DataFrame) -> DataFrame:
    """The loudest bin of each frame; the first of ties."""
    order = F.struct(F.col("magnitude"), -F.col("bin"))
    return df.groupBy("track_id", "frame_idx").agg(F.max_by("bin", order).alias("bin"), F.max(spectrum_db(F.col("magnitude"), 1)).alias("level"))


def log_edges(low: float, high: float, n: int) -> list[float]:
    """n + 1 band edges in a constant ratio."""
    ratio, out = math.exp(math.log(high / low) / n), [low]
    for _ in range(n):
        out.append(out[-1] * ratio)
    return out


def linear_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) / n * k for k in range(n + 1)]


def bin_of(frequency: float, rate: float, n_bins: int) -> int:
    """The nearest bin, half to even, at most the last."""
    return min(round(frequency / (rate / 2 / n_bins)), n_bins - 1)


def band_bins(edges: list[float], rate: float, n_bins: int) -> list[tuple[int, int, int]]:
    """(band, first bin, bin after the last) for each pair of edges, truncated to bins."""
    width = rate / 2 / n_bins
    return [(k, int(a / width), int(b / width)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def bands(df: DataFrame, edges: list[float], rate: float, n_bins: int, column: str = "magnitude") -> DataFrame:
    """Bin rows -> (track_id, frame_idx, band, energy); empty bands have 0."""
    ranges = F.array(*(F.struct(F.lit(k).alias("band"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in band_bins(edges, rate, n_bins)))
    rows = df.select("track_id", "frame_idx", "bin", F.col(column).alias("v"), F.explode(ranges).alias("r"))
    energy = F.sum(F.when((F.col("bin") >= F.col("r.a")) & (F.col("bin") < F.col("r.b")), F.col("v")).otherwise(0.0))
    return rows.groupBy("track_id", "frame_idx", F.col("r.band").alias("band")).agg(energy.alias("energy"))


def chroma_classes(rate: float, size: int, low: float, high: float, mapping: str = "paper") -> list[tuple[int, int]]:
    """(bin, pitch class) of the bins from floor(low) to ceil(high), without bin 0."""
    step = rate / size
    first, after = max(int(math.floor(low / step)), 1), min(int(math.ceil(high / step)), size // 2 - 1)
    out = []
    for k in range(first, after):
        c = math.log2(k * step if mapping == "paper" else k * step / 27.5)
        c -= math.floor(c)
        out.append((k, round(c * 12) % 12 if mapping == "paper" else int(c * 12)))
    return out


def chroma(df: DataFrame, rate: float, size: int, low: float, high: float, mapping: str = "paper", normalize: bool = False) -> DataFrame:
    """Bin rows with `squared` -> (track_id, frame_idx, class, value), 12 rows a frame. Normalised: mean per bin, then minus the mean of the 12."""
    table = chroma_classes(rate, size, low, high, mapping)
    if not table:
        raise ValueError("no bin between the frequencies")
    counts = [sum(c == k for _, c in table) for k in range(12)]
    of = F.create_map(*[F.lit(x) for pair in table for x in pair])
    count = F.element_at(F.array(*map(F.lit, counts)), F.col("class") + 1)
    own = df.withColumn("own", of[F.col("bin").cast("int")])
    sums = own.groupBy("track_id", "frame_idx").agg(F.array(*(F.sum(F.when(F.col("own") == k, F.col("squared")).otherwise(0.0)) for k in range(12))).alias("v"))
    rows = sums.select("track_id", "frame_idx", F.posexplode("v").alias("class", "value"))
    if normalize:
        rows = rows.withColumn("value", F.when(count > 0, F.col("value") / count).otherwise(0.0))
        rows = rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("track_id", "frame_idx")))
    return rows


def rectified_difference(df: DataFrame, column: str = "energy", silent: Column | None = None) -> DataFrame:
    """(track_id, frame_idx, band, energy) -> rise since the frame before, over the frame's sum. Silent frames are 0."""
    before = Window.partitionBy("track_id", "band").orderBy("frame_idx")
    rise = F.greatest(F.lit(0.0), F.col(column) - F.coalesce(F.lag(column).over(before), F.lit(0.0)))
    total = F.sum(column).over(Window.partitionBy("track_id", "frame_idx"))
    rise = rise if silent is None else F.when(silent, 0.0).otherwise(rise)
    return df.withColumns({"rise": rise, "total": total}).withColumn("rise", F.when(F.col("total") > 0, F.col("rise") / F.col("total")).otherwise(F.col("rise"))).drop("total")


def onset_band_map(rate: int = 44100, size: int = 2048) -> list[int]:
    """Band of each bin for 84-band onset spectra: 17 linear ones, 66 from 370 to 12500 Hz, and all from bin 580 on."""
    out = [0] * (size // 2)
    for k in range(17):
        out[k] = k
    for k, a, b in band_bins(log_edges(370, 12500, 66), rate, size // 2):
        for y in range(a, b):
            out[y] = 17 + k
    for k in range(580, size // 2):
        out[k] = 83
    return out


def onset_frames(values: np.ndarray, rate: int = 44100, size: int = 2048, hop: int = 882, silence: float = 0.0004) -> np.ndarray:
    """The 84-band onset spectra of a mono signal."""
    n = max(0, (len(values) - size) // hop + 1)
    place = np.arange(size) + hop * np.arange(n)[:, None]
    raw = values[place] * np.array(WindowConfig("Hamming", size).values())
    power = np.abs(np.fft.rfft(raw, axis=1)[:, : size // 2]) ** 2
    total = np.zeros((n, 84))
    np.add.at(total.T, onset_band_map(rate, size), power.T)
    rise = np.maximum(np.diff(total, axis=0, prepend=np.zeros((1, 84))), 0)
    rise[np.sqrt((raw**2).mean(1)) <= silence] = 0
    s = total.sum(1, keepdims=True)
    return np.divide(rise, s, out=rise, where=s > 0)


def onset_spectra(df: DataFrame, rate: int = 44100, size: int = 2048, hop: int = 882, silence: float = 0.0004, held=None) -> DataFrame:
    """onset_frames() of signals (track_id, idx, value) of any length: (track_id, frame_idx, band, rise). Tracks are dealt in blocks with the frame
    before, so only samples are shuffled; idx are dense."""
    from .fingerprints import in_blocks

    def run(values: np.ndarray) -> pd.DataFrame:
        rise = onset_frames(values, rate, size, hop, silence)
        n = len(rise)
        return pd.DataFrame({"idx": np.repeat(np.arange(n), 84), "band": np.tile(np.arange(84, dtype=np.int32), n), "rise": rise.ravel()})

    out = in_blocks(df, run, "band int, rise double", size, hop, (1, 0), held)
    return out.withColumnRenamed("idx", "frame_idx")


def analyzer_offset(config: WindowConfig) -> float:
    """Decibels that bring a full-scale tone of 16 cycles in 1024 samples to 1 under a window: what its gain takes away."""
    tone = np.sin(2 * np.pi * 16 * np.arange(1024) / 1024)
    window = np.array(WindowConfig(config.kind, 1024, config.factor, config.root).values())
    return 1 - float(spectrum(np.fft.rfft(tone * window)[None, :512], "decibel", 512).max())


def analyse_blocks(df: DataFrame, config: WindowConfig) -> DataFrame:
    """Frames that do not overlap -> decibel spectra, with the window's gain made up."""
    offset = analyzer_offset(config)
    out = stft(df, config, fmt="decibel")
    return out.withColumn("bins", F.transform("bins", lambda x: F.when(x <= SILENCE, F.lit(SILENCE)).otherwise(x + offset)))
