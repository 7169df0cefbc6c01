"""Resampling and time warping of mono signals (track_id, idx, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resample(df: DataFrame, ratio: float, kind: str = "linear") -> DataFrame:
    """Zero-order hold or linear interpolation to ceil(n * ratio) samples; equal rates pass.

    Every source sample makes the output samples between it and the next one, so no output needs a search.
    """
    if ratio == 1:
        return df
    if ratio <= 0 or kind not in ("hold", "linear"):
        raise ValueError("ratio must be positive and kind 'hold' or 'linear'")
    order = Window.partitionBy("track_id").orderBy("idx")
    size = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    rows = df.select("track_id", "idx", "value", F.coalesce(F.lead("value").over(order), F.col("value")).alias("next"), size.alias("n"))
    first, after = F.ceil(F.col("idx") * ratio), F.least(F.ceil((F.col("idx") + 1) * ratio), F.ceil(F.col("n") * ratio))
    rows = rows.withColumns({"first": first, "after": after}).where("after > first")
    rows = rows.withColumn("o", F.explode(F.sequence("first", F.col("after") - 1)))
    part = F.col("o") / ratio - F.col("idx")
    value = F.col("value") if kind == "hold" else F.col("value") + (F.col("next") - F.col("value")) * part
    return rows.select("track_id", F.col("o").alias("idx"), value.alias("value"))


def sinc_at(values: np.ndarray, at: np.ndarray, cutoff: float, zeros: int) -> np.ndarray:
    """A windowed sinc, cut off at a part of the Nyquist rate, at some places; what lies outside counts as silence."""
    half = int(np.ceil(zeros / cutoff))
    taps = np.arange(-half, half + 1)
    out = np.zeros(len(at))
    for k in range(0, len(at) if len(values) else 0, 8192):
        own = at[k : k + 8192]
        place = np.floor(own).astype(int)[:, None] + taps
        x = (own[:, None] - place) * cutoff
        weight = np.sinc(x) * np.where(np.abs(x) < zeros, 0.5 + 0.5 * np.cos(np.pi * x / zeros), 0) * cutoff
        inside = (place >= 0) & (place < len(values))
        out[k : k + 8192] = (weight * np.where(inside, values[np.clip(place, 0, len(values) - 1)], 0)).sum(1)
    return out


def sinc_kernel(values: np.ndarray, ratio: float, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc resampling, cut off at the lower of both Nyquist rates."""
    return sinc_at(values, np.arange(int(np.ceil(len(values) * ratio - 1e-9))) / ratio, min(1.0, ratio), zeros)


#: Zero crossings of the kernel on either side, by grade.
GRADES = {"quick": 4, "low": 8, "medium": 16, "high": 32, "very high": 64}


def resample_sinc(df: DataFrame, ratio: float, zeros: int = 16, grade: str | None = None) -> DataFrame:
    """Windowed-sinc resampling. Output places are dealt in blocks, each with the samples its kernel reaches, so tracks may be of any length.
    A grade stands for a number of zero crossings."""
    if ratio == 1:
        return df
    zeros = GRADES[grade] if grade else zeros
    cutoff = min(1.0, ratio)
    half, block = int(np.ceil(zeros / cutoff)), 1 << 16
    size = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    rows = df.select("track_id", "idx", F.col("value").cast("double").alias("value"), size.alias("n"))
    near = lambda c: F.floor(F.greatest(F.lit(0.0), c * ratio) / block)
    rows = rows.withColumn("block", F.explode(F.sequence(near(F.col("idx") - half - 1), near(F.col("idx") + half + 1))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        k, n = int(part["block"].iloc[0]), int(part["n"].iloc[0])
        o = np.arange(k * block, min((k + 1) * block, int(np.ceil(n * ratio - 1e-9))))
        first = int(part["idx"].iloc[0])
        held = np.zeros(int(part["idx"].iloc[-1]) - first + 1)
        held[part["idx"].to_numpy() - first] = part["value"].to_numpy()
        return pd.DataFrame({"track_id": part["track_id"].iloc[0], "idx": o, "value": sinc_at(held, o / ratio - first, cutoff, zeros)})

    return rows.groupBy("track_id", "block").applyInPandas(run, "track_id long, idx long, value double")


def resample_variable(df: DataFrame, steps: DataFrame) -> DataFrame:
    """A rate that changes on the way: steps (track_id, idx, ratio) hold from their sample on. Steps become control points, and the signal
    is warped by them. Tracks without steps stay as they are."""
    order = Window.partitionBy("track_id").orderBy("idx")
    ends = df.groupBy("track_id").agg((F.max("idx") + 1).alias("end"))
    s = steps.join(ends, "track_id").where("idx < end").withColumn("to", F.coalesce(F.lead("idx").over(order), F.col("end")))
    length = (F.col("to") - F.col("idx")) * F.col("ratio")
    s = s.withColumn("until", F.rint(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.first("idx").over(order)).cast("long"))
    before = F.coalesce(F.lag("until").over(order), F.col("idx"))
    points = s.select("track_id", F.col("idx").alias("from_t"), before.alias("to_t"))
    last = s.withColumn("__n", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("idx")))).where("__n = 1").select("track_id", F.col("to").alias("from_t"), F.col("until").alias("to_t"))
    return warp(df, points.unionByName(last))


def segments(warps: DataFrame) -> DataFrame:
    """Control points (track_id, from_t, to_t) as segments with the next point."""
    order = Window.partitionBy("track_id").orderBy("from_t", "to_t")
    return warps.select("track_id", "from_t", "to_t", F.lead("from_t").over(order).alias("next_from"), F.lead("to_t").over(order).alias("next_to"), F.row_number().over(order).alias("n"))


def translate(points: DataFrame, warps: DataFrame, inverse: bool = False) -> DataFrame:
    """points (track_id, t) -> also t_out by the piecewise linear map. Outside the control points the nearest one's offset is
    added; inside, the product is truncated. Tracks without control points keep their times.

    One pass over each track's points and control points in order of time: every point takes the last control point up to it, or else the first.
    """
    a, b, na, nb = ("to_t", "from_t", "next_to", "next_from") if inverse else ("from_t", "to_t", "next_from", "next_to")
    s = segments(warps)
    seg = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(na).alias("na"), F.col(nb).alias("nb"))
    firsts = s.where("n = 1").select("track_id", seg.alias("__first"))
    mine = points.select("track_id", F.col("t").alias("__t"), F.lit(None).cast("int").alias("__n"), F.struct(*points.columns).alias("__row"))
    theirs = s.select("track_id", F.col(a).alias("__t"), F.col("n").alias("__n"), seg.alias("__seg"))
    order = Window.partitionBy("track_id").orderBy("__t", F.col("__n").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = mine.unionByName(theirs, allowMissingColumns=True).withColumn("__seg", F.last("__seg", ignorenulls=True).over(order)).where("__row is not null")
    rows = rows.join(firsts, "track_id", "left").withColumn("__seg", F.coalesce("__seg", "__first"))
    t, g = F.col("__row.t"), F.col("__seg")
    scaled = g["b"] + ((t - g["a"]) * ((g["nb"] - g["b"]) / (g["na"] - g["a"]))).cast("long")
    moved = F.when(g.isNull(), t).when((t >= g["a"]) & g["na"].isNotNull(), scaled).otherwise(t + g["b"] - g["a"])
    return rows.select(*(F.col(f"__row.{c}").alias(c) for c in points.columns), moved.cast("long").alias("t_out"))


def warp_faults(warps: DataFrame, max_ratio: float = 255.0) -> DataFrame:
    """Control points that a valid map cannot have: times that run back, or a ratio no resampler takes."""
    s = segments(warps).where("next_from is not null")
    ratio = (F.col("next_to") - F.col("to_t")) / (F.col("next_from") - F.col("from_t"))
    bad = (F.col("next_to") < F.col("to_t")) | (F.col("next_from") <= F.col("from_t")) | (ratio > max_ratio) | (ratio < 1 / max_ratio)
    return s.where(bad).drop("n")


def warp(df: DataFrame, warps: DataFrame) -> DataFrame:
    """A signal under a time map in samples: between control points it is resampled linearly, outside it is shifted. idx are dense."""
    end = df.groupBy("track_id").agg((F.max("idx") + 1).alias("t")).withColumn("value", F.lit(None).cast("double"))
    points = df.select("track_id", F.col("idx").alias("t"), F.col("value").cast("double").alias("value")).unionByName(end)
    order = Window.partitionBy("track_id").orderBy("t")
    rows = translate(points, warps).withColumns({"o2": F.lead("t_out").over(order), "next": F.lead("value").over(order)}).where("o2 > t_out")
    rows = rows.withColumn("o", F.explode(F.sequence("t_out", F.col("o2") - 1)))
    part = (F.col("o") - F.col("t_out")) / (F.col("o2") - F.col("t_out"))
    return rows.select("track_id", F.col("o").alias("idx"), (F.col("value") + (F.coalesce("next", "value") - F.col("value")) * part).alias("value"))
