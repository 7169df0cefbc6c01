"""Operators on signals: tables of (track_id, channel, idx, value), or (track_id, idx, value) for mono ones.

All are projections, unions and aggregates that Catalyst plans; only mixing, metering and resampling shuffle, by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Factors of -3 dB and -6 dB in surround downmixes, as published for Lo/Ro downmixing.
MINUS_3_DB, MINUS_6_DB = 0.7071067811865476, 0.5
#: Layouts: channel -> (left, right) factors. Channel 3 of the larger ones is the low-frequency channel, which is left out.
SURROUND = {
    4: {0: (1, 0), 1: (0, 1), 2: (MINUS_6_DB, 0), 3: (0, MINUS_6_DB)},
    6: {0: (1, 0), 1: (0, 1), 2: (MINUS_3_DB, MINUS_3_DB), 4: (MINUS_6_DB, 0), 5: (0, MINUS_6_DB)},
    8: {0: (1, 0), 1: (0, 1), 2: (MINUS_3_DB, MINUS_3_DB), 4: (MINUS_6_DB, 0), 5: (0, MINUS_6_DB), 6: (MINUS_6_DB, 0), 7: (0, MINUS_6_DB)},
}


def pcm16(df: DataFrame, column: str = "value") -> DataFrame:
    """16-bit integers to floats: divided by 32767."""
    return df.withColumn(column, F.col(column) / F.lit(32767.0))


def pcm24(df: DataFrame, column: str = "value") -> DataFrame:
    """24-bit integers to floats: shifted to the top of 32 bits, divided by 2**31."""
    return df.withColumn(column, F.col(column) * 256 / F.lit(2147483648.0))


def mono(df: DataFrame, channels: int, out_channels: int = 1, downmix: bool = True) -> DataFrame:
    """Mean over channels, repeated out_channels times. Without downmix the channels pass; their number must stay."""
    if not downmix:
        if channels != out_channels:
            raise ValueError("channels can only pass if their number stays")
        return df
    mixed = df.groupBy("track_id", "idx").agg(F.sum(F.col("value") / channels).alias("value"))
    return mixed.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(out_channels - 1)))).select("track_id", "channel", "idx", "value")


def surround_downmix(df: DataFrame, channels: int) -> DataFrame:
    """4, 6 or 8 channels to stereo."""
    if channels not in SURROUND:
        raise ValueError(f"no downmix for {channels} channels")
    factor = F.create_map(*[F.lit(x) for c, (l, r) in SURROUND[channels].items() for x in (c, F.array(F.lit(float(l)), F.lit(float(r))))])
    sides = df.withColumn("f", factor[F.col("channel").cast("int")]).where("f is not null")
    sides = sides.groupBy("track_id", "idx").agg(*(F.sum(F.col("value") * F.col("f")[k]).alias(f"s{k}") for k in (0, 1)))
    return sides.select("track_id", "idx", F.posexplode(F.array("s0", "s1")).alias("channel", "value")).select("track_id", "channel", "idx", "value")


def mix(df: DataFrame, group: Column) -> DataFrame:
    """Sum of all tracks of a group at the same place; a track that has ended adds nothing."""
    keys = [c for c in ("channel",) if c in df.columns]
    return df.groupBy(group.alias("mix_id"), *keys, "idx").agg(F.sum("value").alias("value"))


def concatenate(df: DataFrame, group: Column, lengths: DataFrame | None = None) -> DataFrame:
    """Tracks of a group one after another, by track_id: idx moves by the lengths of the tracks before."""
    lengths = df.groupBy(group.alias("mix_id"), "track_id").agg((F.max("idx") + 1).alias("n")) if lengths is None else lengths
    before = Window.partitionBy("mix_id").orderBy("track_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("mix_id", "track_id", "start")
    keys = [c for c in ("channel",) if c in df.columns]
    return df.join(starts, "track_id").select("mix_id", *keys, (F.col("idx") + F.col("start")).alias("idx"), "value")


def check_formats(tracks: DataFrame) -> None:
    """Tracks that are joined must agree in channels, rate, depth and format."""
    if tracks.select("channels", "sample_rate", "bit_depth", "format").distinct().limit(2).count() > 1:
        raise ValueError("formats differ")


def crop(df: DataFrame, begin: int, end: int) -> DataFrame:
    """Samples [begin, end), counted from 0 again."""
    if not 0 <= begin <= end:
        raise ValueError("0 <= begin <= end must hold")
    return df.where((F.col("idx") >= begin) & (F.col("idx") < end)).withColumn("idx", F.col("idx") - begin)


def offset(df: DataFrame, n: int) -> DataFrame:
    """n zeros before each track."""
    if n < 0:
        raise ValueError("an offset cannot be negative")
    keys = [c for c in ("track_id", "channel") if c in df.columns]
    moved = df.select(*keys, (F.col("idx") + n).alias("idx"), F.col("value").cast("double").alias("value"))
    if not n:
        return moved
    zeros = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("idx"), F.lit(0.0).alias("value"))
    return zeros.unionByName(moved)


def dc_offset(df: DataFrame, constant: float) -> DataFrame:
    return df if constant == 0 else df.withColumn("value", F.col("value") + constant)


def invert(df: DataFrame, on: bool = True) -> DataFrame:
    return df.withColumn("value", -F.col("value")) if on else df


def clip(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value"))))


def volume(df: DataFrame, gain: float = 1.0, balance: float = 0.0, mute: bool = False) -> DataFrame:
    """Stereo gain: a positive balance lowers the left channel, a negative one the right."""
    if mute:
        return df.withColumn("value", F.lit(0.0))
    left, right = (1 - balance if balance > 0 else 1.0), (1 + balance if balance < 0 else 1.0)
    if (left, right, gain) == (1.0, 1.0, 1.0):
        return df
    return df.withColumn("value", F.col("value") * F.when(F.col("channel") == 0, left * gain).otherwise(right * gain))


def meter(df: DataFrame, every: int, channels: int) -> DataFrame:
    """Peak level of each channel over runs of `every` samples, all channels counted."""
    run = F.floor(F.col("idx") * channels / every).alias("run")
    return df.groupBy("track_id", "channel", run).agg(F.max(F.abs("value")).alias("peak"))


def rms(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def display_peaks(df: DataFrame, buckets: int) -> DataFrame:
    """n samples of a track as min and max of `buckets` equal runs."""
    n = df.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "track_id").groupBy("track_id", F.floor(F.col("idx") * buckets / F.col("n")).alias("bucket")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def peak_store(df: DataFrame, size: int = 256) -> DataFrame:
    """Min and max of every `size` samples; a peak also takes in the last sample before it."""
    last = F.when(F.col("idx") % size == size - 1, F.struct((F.floor(F.col("idx") / size) + 1).alias("peak"), F.col("value").alias("value")))
    own = F.struct(F.floor(F.col("idx") / size).alias("peak"), F.col("value").alias("value"))
    # the last sample of a run counts in its own peak and in the next, if there is one
    rows = df.select("track_id", "idx", F.explode(F.filter(F.array(own, last), lambda x: x.isNotNull())).alias("p"), (F.col("idx") % size == size - 1).alias("edge"))
    peaks = rows.groupBy("track_id", "p.peak").agg(F.min("p.value").alias("low"), F.max("p.value").alias("high"), F.max((F.floor(F.col("idx") / size) == F.col("p.peak"))).alias("real"))
    return peaks.where("real").select("track_id", "peak", "low", "high")


def peak_pyramid(peaks: DataFrame, level: int, factor: int = 8, first_wide: bool = True) -> DataFrame:
    """Level `level` of the pyramid over peaks. With first_wide the first group holds one more than the factor."""
    for _ in range(level):
        group = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("peak") / factor) - 1) if first_wide else F.floor(F.col("peak") / factor)
        peaks = peaks.groupBy("track_id", group.alias("peak")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return peaks


def pyramid_level(samples_per_bucket: int, size: int = 256, factor: int = 8, levels: int = 6) -> int | None:
    """The coarsest level whose peaks are no wider than asked for; None if samples must be read."""
    fit = [k for k in range(levels) if size * factor**k <= samples_per_bucket]
    return fit[-1] if fit else None


def equal_prefix(a: DataFrame, b: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """Per track, how many samples agree from the start."""
    both = a.select("track_id", "idx", F.col("value").alias("x")).join(b.select("track_id", "idx", F.col("value").alias("y")), ["track_id", "idx"])
    differs = F.min(F.when(F.abs(F.col("x") - F.col("y")) > epsilon, F.col("idx")))
    return both.groupBy("track_id").agg(F.coalesce(differs, F.count(F.lit(1))).alias("n_equal"))


def at_position(tracks: DataFrame, positions: DataFrame) -> DataFrame:
    """Tracks that sound at each position, both ends closed. `positions` is the smaller side; Spark picks the join."""
    return positions.join(tracks, (F.col("offset_ticks") <= F.col("t")) & (F.col("t") <= F.col("offset_ticks") + F.col("length_ticks")))


def timeline(tracks: DataFrame) -> DataFrame:
    """Start, end and summed length of a track list."""
    end = F.max(F.col("offset_ticks") + F.col("length_ticks"))
    return tracks.agg(F.min("offset_ticks").alias("start"), end.alias("end"), F.sum("length_ticks").alias("total"))


def multitrack(df: DataFrame, tracks: DataFrame) -> DataFrame:
    """The mix of a project: muted tracks and, if any is solo, those that are not solo are silent; volume, phase and
    balance apply, then tracks are summed at their offsets and clipped. df is stereo; offset is in samples."""
    solo = tracks.agg(F.max("solo").alias("any_solo"))
    heard = tracks.crossJoin(F.broadcast(solo)).where(~F.col("mute") & (F.col("solo") | ~F.col("any_solo")))
    gain = F.col("volume") * F.when(F.col("inverted_phase"), -1.0).otherwise(1.0)
    side = F.when((F.col("channel") == 0) & (F.col("balance") > 0), 1 - F.col("balance")).when((F.col("channel") == 1) & (F.col("balance") < 0), 1 + F.col("balance")).otherwise(1.0)
    rows = df.join(heard, "track_id").select("channel", (F.col("idx") + F.col("offset")).alias("idx"), (F.col("value") * gain * side).alias("value"))
    return clip(rows.groupBy("channel", "idx").agg(F.sum("value").alias("value")))


def cut(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Slices of each track between cut points (track_id, at); slice 0 starts at the track's start."""
    points = cuts.groupBy("track_id").agg(F.array_sort(F.collect_set("at")).alias("points"))
    rows = df.join(points, "track_id", "left").withColumn("points", F.coalesce("points", F.array().cast("array<bigint>")))
    before = F.filter("points", lambda p: p <= F.col("idx"))
    return rows.select("track_id", F.size(before).alias("slice"), (F.col("idx") - F.coalesce(F.array_max(before), F.lit(0))).alias("idx"), "value")


class Chain:
    """Operators applied one after another, each of which can be found again with its result."""

    def __init__(self, df: DataFrame, steps: tuple = ()):
        self.df, self.steps = df, steps or (("source", df),)

    def then(self, operator, *args, **named) -> Chain:
        out = operator(self.df, *args, **named)
        return Chain(out, (*self.steps, (operator.__name__, out)))

    def find(self, name: str) -> DataFrame | None:
        """The result of the last operator of that name; None if there is none."""
        return next((df for n, df in reversed(self.steps) if n == name), None)

    def source(self) -> DataFrame:
        return self.steps[0][1]


def monitor(df: DataFrame, name) -> DataFrame:
    """A tap: counts and peak of what passes, as an observation (a name, or an Observation to ask)."""
    return df.observe(name, F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("peak"))


def relabel_rate(tracks: DataFrame, factor: float) -> DataFrame:
    """Another sample rate without resampling: a change of speed, and so of length."""
    rate = F.rint(F.col("sample_rate") * factor).cast("int")
    length = F.rint(F.col("length_ticks") * F.col("sample_rate") / rate).cast("long")
    return tracks.withColumns({"length_ticks": length, "sample_rate": rate})
