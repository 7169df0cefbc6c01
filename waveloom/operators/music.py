"""Music detection by continuous frequency activation (Seyerlehner et al., 2007)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MEAN_WIDTH, LEAST, BLOCK, BLOCK_HOP, PEAKS, BAR = 21, 0.1, 100, 50, 5, 1.24


def emphasize(df: DataFrame, column: str = "db", width: int = MEAN_WIDTH) -> DataFrame:
    """Bins minus the mean of the bins around them; the window is cut at the edges."""
    near = Window.partitionBy("track_id", "frame_idx").orderBy("bin").rowsBetween(-(width // 2), width // 2)
    return df.withColumn("local", F.col(column) - F.avg(column).over(near))


def binarize(df: DataFrame, least: float = LEAST) -> DataFrame:
    return df.withColumn("active", F.when(F.col("local") > least, 1.0).otherwise(0.0))


def activation(df: DataFrame, block: int = BLOCK, hop: int = BLOCK_HOP) -> DataFrame:
    """Mean activity of each bin over blocks of frames, hop by hop; partial blocks are dropped."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame_idx") - block + 1) / hop))
    last = F.floor(F.col("frame_idx") / hop)
    rows = df.where(last >= first).withColumn("block", F.explode(F.sequence(first, last)))
    out = rows.groupBy("track_id", "block", "bin").agg(F.avg("active").alias("activation"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") == block).drop("n")


def peak_strengths(values: np.ndarray) -> list[float]:
    """For each local maximum, the least side's height over that side's width, where a side runs down to its next minimum."""
    out, n = [], len(values)
    for k in range(1, n - 1):
        if values[k] > values[k - 1] and values[k] >= values[k + 1]:
            left, right = k, k
            while left > 0 and values[left - 1] < values[left]:
                left -= 1
            while right < n - 1 and values[right + 1] < values[right]:
                right += 1
            sides = [(values[k] - values[left], k - left), (values[k] - values[right], right - k)]
            height, width = min(sides)
            out.append(float(height / width) if width else 0.0)
    return out


def quantify(df: DataFrame, peaks: int = PEAKS) -> DataFrame:
    """Activation rows -> (track_id, block, strength): the sum of each block's strongest peaks."""
    rows = df.groupBy("track_id", "block").agg(F.sort_array(F.collect_list(F.struct("bin", "activation")))["activation"].alias("v"))

    def run(parts):
        for part in parts:
            part["strength"] = [sum(sorted(peak_strengths(np.asarray(v, float)), reverse=True)[:peaks]) for v in part["v"]]
            yield part[["track_id", "block", "strength"]]

    return rows.mapInPandas(run, "track_id long, block long, strength double")


def smooth_labels(labels: list[bool]) -> list[bool]:
    """In place and in order: a label between two equal others joins them; then so does a run of two."""
    out = list(labels)
    for k in range(1, len(out) - 1):
        if out[k - 1] == out[k + 1] != out[k]:
            out[k] = out[k - 1]
    for k in range(1, len(out) - 2):
        if out[k - 1] == out[k + 2] and out[k] != out[k - 1] and out[k + 1] != out[k - 1]:
            out[k] = out[k + 1] = out[k - 1]
    return out


def label(df: DataFrame, bar: float = BAR) -> DataFrame:
    """Strength rows -> also is_music, smoothed along each track."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        part["is_music"] = smooth_labels((part["strength"] > bar).tolist())
        return part

    return df.groupBy("track_id").applyInPandas(run, "track_id long, block long, strength double, is_music boolean")


def music_ratio(df: DataFrame) -> DataFrame:
    return df.groupBy("track_id").agg(F.avg(F.col("is_music").cast("double")).alias("ratio"))
