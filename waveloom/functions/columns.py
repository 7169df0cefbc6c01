"""Column expressions: levels, times, bits, intervals and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_SECOND = 10_000_000
#: Stands for minus infinity in decibel spectra: the least float32.
SILENCE = -3.4028234663852886e38


def to_db(linear: Column) -> Column:
    return 20 * F.log10(linear)


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def db_percent(db: Column, low: float = -60.0, high: float = 0.0) -> Column:
    """Position of a level between two others, clamped to 0..1, as a level meter shows it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db - low) / (high - low)))


def spectrum_db(magnitude: Column, n_bins: int | Column, offset: float = 0.0) -> Column:
    """20 log10(2 magnitude / bins) + offset; silence for 0."""
    return F.when(magnitude <= 0, F.lit(SILENCE)).otherwise(20 * F.log10(magnitude / n_bins * 2) + offset)


def index_to_ticks(index: Column, scale: float) -> Column:
    """Hash index times seconds per hash, rounded half to even."""
    return F.rint(index * F.lit(float(scale)) * TICKS_PER_SECOND).cast("long")


def sample_ticks(rate: int | Column) -> Column:
    return F.lit(float(TICKS_PER_SECOND)) / rate


def ticks_to_samples(ticks: Column, rate: int | Column) -> Column:
    return F.rint(ticks / sample_ticks(rate)).cast("long")


def align_to_samples(start: Column, end: Column, rate: int) -> tuple[Column, Column]:
    """The least interval on the sample grid that holds [start, end]."""
    ticks = TICKS_PER_SECOND / rate
    return (F.floor(start / ticks) * ticks).cast("long"), (F.ceil(end / ticks) * ticks).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def with_bit(word: Column, bit: int, value: bool) -> Column:
    return word.bitwiseOR(F.lit(1 << bit)) if value else word.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))


def gray2(level: Column) -> Column:
    """Two-bit Gray code: 0, 1, 3, 2."""
    return level.bitwiseXOR(F.shiftright(level, 1))


def pack_peaks(bin1: Column, bin2: Column, distance: Column) -> Column:
    """Low bytes of two bins and their frame distance in one 24-bit word."""
    low = lambda c: c.cast("long").bitwiseAND(F.lit(255))
    return F.shiftleft(low(bin1), 16).bitwiseOR(F.shiftleft(low(bin2), 8)).bitwiseOR(low(distance))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12))).cast("long")


def intersects(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Open intersection: touching ends do not count."""
    return (a_from < b_to) & (b_from < a_to)


def contains(a_from: Column, a_to: Column, t: Column) -> Column:
    """Closed at both ends."""
    return (a_from <= t) & (t <= a_to)


def intersection(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return F.when(intersects(a_from, a_to, b_from, b_to), F.struct(F.greatest(a_from, b_from).alias("from"), F.least(a_to, b_to).alias("to")))


def divide(start: Column, end: Column, at: Column) -> Column:
    """An interval split at a point inside it; whole otherwise."""
    cut = (start < at) & (at < end)
    parts = F.array(F.struct(start.alias("from"), at.alias("to")), F.struct(at.alias("from"), end.alias("to")))
    return F.when(cut, parts).otherwise(F.array(F.struct(start.alias("from"), end.alias("to"))))


def simple_average(values: Column, width: int) -> Column:
    """Trailing mean of up to `width` values at each place."""
    at = lambda i: F.slice(values, F.greatest(F.lit(1), i - width + 2), F.least(F.lit(width), i + 1))
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.aggregate(at(i), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(width), i + 1))


def exponential_average(values: Column, alpha: float) -> Column:
    """The last exponential average: the first value starts it, then alpha * x + (1 - alpha) * average."""
    start = F.lit(None).cast("double")
    return F.aggregate(values, start, lambda a, x: F.coalesce(a * (1 - alpha) + x * alpha, x.cast("double")))


def min_max_mean(values: Column) -> Column:
    """Least, greatest and integer mean (truncated)."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.struct(F.array_min(values).alias("min"), F.array_max(values).alias("max"), (total / F.size(values)).cast("long").alias("mean"))


def unit_clamp(value: Column, low: float, high: float) -> Column:
    """Position of a value between two others, clamped to 0..1: what a colour map or a bar shows."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def gradient(position: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Colour at a position of 0..1 between stops, linear in red, green and blue, as 0xRRGGBB."""
    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (a, ca), (b, cb) in reversed(list(zip(stops, stops[1:]))):
            out = F.when(position <= b, F.lit(float(ca[k])) + (position - a) / (b - a) * (cb[k] - ca[k])).otherwise(out)
        return F.when(position <= stops[0][0], float(stops[0][1][k])).otherwise(out).cast("int")

    return F.shiftleft(channel(0), 16) + F.shiftleft(channel(1), 8) + channel(2)
