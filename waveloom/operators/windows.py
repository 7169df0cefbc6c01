"""Window functions and framing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cosine coefficients a0, a1, ... of published windows, sum of (-1)**k * a_k * cos(2 pi k n / N).
COSINES = {
    "Rectangle": (1.0,),
    "Hann": (0.5, 0.5),
    "Hamming": (0.54, 0.46),
    "Blackman": (0.42, 0.5, 0.08),
    "Nuttall": (0.355768, 0.487396, 0.144232, 0.012604),
    "BlackmanHarris": (0.35875, 0.48829, 0.14128, 0.01168),
    "BlackmanNuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
}
KINDS = (*COSINES, "HannPeriodic", "HammingPeriodic", "Triangle", "Sine", "SinePeriodic")


def window_values(kind: str, size: int) -> list[float]:
    """The window as Python floats. Periodic kinds are the symmetric ones of one more sample, cut."""
    base = kind.removesuffix("Periodic")
    n = size if base != kind else size - 1
    if base == "Sine":
        return [math.sin(k * math.pi / n) for k in range(size)]
    if base == "Triangle":
        return [1 - abs(k - (size - 1) / 2) / (size / 2) for k in range(size)]
    terms = COSINES[base]
    return [sum((-1) ** j * a * math.cos(2 * math.pi * j * k / n) for j, a in enumerate(terms)) for k in range(size)] if len(terms) > 1 else [1.0] * size


@dataclass(frozen=True)
class WindowConfig:
    """A window with a factor and an optional square root, which is taken last."""

    kind: str
    size: int
    factor: float = 1.0
    root: bool = False

    def values(self) -> list[float]:
        out = [v * self.factor for v in window_values(self.kind, self.size)]
        return [math.sqrt(max(v, 0.0)) for v in out] if self.root else out

    def column(self) -> Column:
        return F.array(*map(F.lit, self.values()))

    def apply(self, frame: Column) -> Column:
        """A frame array times the window."""
        return F.zip_with(frame, self.column(), lambda x, w: x * w)


def frames(df: DataFrame, size: int, hop: int) -> DataFrame:
    """Samples (track_id, idx, value) -> frames (track_id, frame_idx, values). A partial tail is dropped.

    Samples are dealt in blocks of many hops, each with the size - hop samples that follow it, so a sample is sent about once however much
    frames overlap, and a track of any length is spread over all tasks.
    """
    per = max(1, -(-4 * size // hop))  # frames of a block
    reach, span = F.floor(F.greatest(F.lit(0), F.col("idx") - (size - 1)) / (per * hop)), F.floor(F.col("idx") / (per * hop))
    rows = df.select("track_id", F.explode(F.sequence(reach, span)).alias("block"), "idx", "value")
    rows = rows.groupBy("track_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("v"))
    rows = rows.select("track_id", F.explode(F.sequence(F.col("block") * per, F.col("block") * per + per - 1)).alias("frame_idx"), "v")
    # places are looked up, so frames with samples missing are left out, as are partial ones
    first = F.array_position(F.col("v.idx"), F.col("frame_idx") * hop)
    rows = rows.withColumn("at", first.cast("int")).where(F.col("at") > 0)
    rows = rows.select("track_id", "frame_idx", F.slice("v", F.greatest(F.lit(1), F.col("at")), size).alias("v"))
    return rows.where((F.size("v") == size) & (F.element_at("v", -1)["idx"] == F.col("frame_idx") * hop + size - 1)).select("track_id", "frame_idx", F.col("v.value").alias("values"))


def stretches(places: DataFrame, track: str, start: str, df: DataFrame, n: int, out: str) -> DataFrame:
    """places with the n samples of their track from `start` on as an array; places whose track lacks some go. Samples are packed in blocks
    that hold the n - 1 samples after them, so a place is joined with one row."""
    block = max(4096, n)
    reach, own = F.floor(F.greatest(F.lit(0), F.col("idx") - (n - 1)) / block), F.floor(F.col("idx") / block)
    packed = df.select(F.col("track_id").alias(track), F.explode(F.sequence(reach, own)).alias("__b"), F.struct("idx", "value").alias("__v"))
    packed = packed.groupBy(track, "__b").agg(F.sort_array(F.collect_list("__v")).alias("__v"))
    rows = places.where(F.col(start) >= 0).withColumn("__b", F.floor(F.col(start) / block)).join(packed, [track, "__b"])
    rows = rows.withColumn("__at", F.array_position(F.col("__v.idx"), F.col(start)).cast("int")).where("__at > 0")
    rows = rows.withColumn("__v", F.slice("__v", F.greatest(F.lit(1), F.col("__at")), n)).where((F.size("__v") == n) & (F.element_at("__v", -1)["idx"] == F.col(start) + n - 1))
    return rows.withColumn(out, F.col("__v.value")).drop("__v", "__b", "__at")


def overlap_add(df: DataFrame, hop: int, column: str = "values") -> DataFrame:
    """Frames -> samples: each frame is added at frame_idx * hop."""
    rows = df.select("track_id", "frame_idx", F.posexplode(column).alias("i", "v"))
    return rows.groupBy("track_id", (F.col("frame_idx") * hop + F.col("i")).alias("idx")).agg(F.sum("v").alias("value"))
