"""Fingerprint generators: mono signals to (track_id, idx, hash, is_variation).

hashes() sends blocks of frames, or whole tracks where a generator has a running state, to a kernel; the kernels are numpy. Signals
must have the profile's rate already (see resample).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import pack_peaks
from .spectral import band_bins, chroma_classes, log_edges, spectrum
from .windows import WindowConfig

# ---- Haitsma and Kalker (2002): signs of energy differences in time and band


@dataclass(frozen=True)
class BandProfile:
    rate: int = 5512
    size: int = 2048
    hop: int = 64
    low: float = 300
    high: float = 2000
    bands: int = 33
    flips: int = 3
    #: Fixed behaviour of one published profile: integer band width, inclusive upper bin, and the band's own bin in place of the bin's.
    coarse: bool = False
    #: The default sign is that of (previous - current); False gives the paper's.
    reversed_sign: bool = True

    @property
    def scale(self) -> float:
        return self.hop / self.rate


BAND_PROFILES = {
    "default": BandProfile(), "voice": BandProfile(low=80, high=1100), "bass": BandProfile(low=80, high=350),
    "human": BandProfile(44100, 16384, 512, 80, 16000), "coarse": BandProfile(coarse=True),
}


def _frames(values: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = max(0, (len(values) - size) // hop + 1)
    return values[np.arange(size) + hop * np.arange(n)[:, None]] if n else np.zeros((0, size))


def band_energies(values: np.ndarray, p: BandProfile) -> np.ndarray:
    """Sums of decibel bins per band, frame by frame."""
    spectra = spectrum(np.fft.rfft(_frames(values, p.size, p.hop) * np.array(WindowConfig("Hann", p.size).values()), axis=1)[:, : p.size // 2], "decibel", p.size // 2)
    edges = log_edges(p.low, p.high, p.bands)
    out = np.zeros((len(spectra), p.bands))
    if p.coarse:
        width = float(p.rate // (p.size // 2))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out[:, k] = spectra[:, k] * (int(b / width) - int(a / width) + 1)
        return out
    for k, a, b in band_bins(edges, p.rate, p.size // 2):
        out[:, k] = spectra[:, a:b].sum(1)
    return out


def band_hashes(energies: np.ndarray, flips: int = 3, reversed_sign: bool = True) -> list[tuple[int, int, bool]]:
    """(frame, hash, is_variation): bit m is the sign of the double difference of bands m, m + 1 and of two frames. Variations flip every
    non-empty set of the weakest bits."""
    before = np.vstack([np.zeros((1, energies.shape[1])), energies[:-1]])
    d = (before[:, :-1] - before[:, 1:]) - (energies[:, :-1] - energies[:, 1:])
    d = d if reversed_sign else -d
    n = len(d)
    words = (d > 0) @ (1 << np.arange(d.shape[1], dtype=np.int64))
    weak = np.argsort(np.abs(d), axis=1, kind="stable")[:, :flips]
    flipped = [(1 << weak[:, [k for k in range(weak.shape[1]) if s >> k & 1]]).sum(1) for s in range(1, 1 << weak.shape[1])]
    rows = np.stack([words, *(words ^ x for x in flipped)], 1)
    per = rows.shape[1]
    return list(zip(np.repeat(np.arange(n), per).tolist(), rows.ravel().tolist(), ([False] + [True] * (per - 1)) * n))


def haitsma_kalker(values: np.ndarray, p: BandProfile = BAND_PROFILES["default"]) -> list[tuple[int, int, bool]]:
    return band_hashes(band_energies(values, p), p.flips, p.reversed_sign)


# ---- Wang (2003): pairs of spectral peaks


@dataclass(frozen=True)
class PeakProfile:
    rate: int = 11025
    size: int = 512
    hop: int = 256
    alpha: float = 0.05
    least_mean: float = -200.0
    drop: float = 90.0
    peaks: int = 3
    fanout: int = 5
    distance: int = 2
    length: int = 30
    width: int = 63

    @property
    def scale(self) -> float:
        return self.hop / self.rate


PEAK_PROFILES = {"default": PeakProfile(), "wang": PeakProfile(8000, 1024, 64, peaks=3, fanout=10, distance=250, length=625, width=179)}


def spectral_peaks(row: np.ndarray) -> list[int]:
    """Bins of local maxima, the first of a plateau; the last bin is never one."""
    out, rising, place = [], True, 0
    for k in range(1, len(row)):
        if row[k] > row[k - 1]:
            rising, place = True, k
        elif row[k] < row[k - 1]:
            if rising:
                out.append(place)
            rising = False
    return out


def frame_peaks(values: np.ndarray, p: PeakProfile, average: np.ndarray | None = None) -> tuple[list[tuple[int, list[tuple[int, float]]]], np.ndarray | None, int]:
    """(frame, its peaks as (bin, energy)) of the frames that are loud enough: the largest few above a running average of spectra; also that
    average after the last frame, from which more can go on, and the number of frames."""
    spectra = spectrum(np.fft.rfft(_frames(values, p.size, p.hop) * np.array(WindowConfig("Hann", p.size).values()), axis=1)[:, : p.size // 2], "decibel", p.size // 2)
    kept = []
    for f, row in enumerate(spectra):
        if row.mean() < p.least_mean:
            continue
        average = row.copy() if average is None else p.alpha * row + (1 - p.alpha) * average
        rest = row - average - p.drop
        top = sorted(spectral_peaks(rest), key=lambda k: -rest[k])[: p.peaks]
        kept.append((f, [(k, float(row[k])) for k in sorted(top)]))
    return kept, average, len(spectra)


def zone_hashes(kept: list[tuple[int, list[tuple[int, float]]]], n: int, p: PeakProfile) -> list[tuple[int, int]]:
    """(frame, hash) of the first n frames: pairs with peaks of the zone ahead, which counts frames that were kept. Ties in mean energy go by bins
    and distance."""
    out = []
    for at, (f, peaks) in enumerate(kept[:n]):
        pairs = []
        for ahead in range(p.distance, p.distance + p.length):
            if at + ahead >= len(kept):
                break
            for b1, e1 in peaks:
                pairs += [((e1 + e2) / 2, b1, b2, ahead) for b2, e2 in kept[at + ahead][1] if abs(b1 - b2) <= p.width / 2]
        pairs.sort(key=lambda x: (-x[0], *x[1:]))
        out += [(f, h) for h in sorted((b1 & 255) << 16 | (b2 & 255) << 8 | (d & 255) for _, b1, b2, d in pairs[: p.fanout])]
    return out


def wang(values: np.ndarray, p: PeakProfile = PEAK_PROFILES["default"]) -> list[tuple[int, int, bool]]:
    kept, _, _ = frame_peaks(values, p)
    return [(f, h, False) for f, h in zone_hashes(kept, max(0, len(kept) - p.distance), p)]


# ---- Chromaprint: classified rectangles of a chroma image

#: Fixed values: (filter, first class, height in classes, width in frames; thresholds), as published with Chromaprint.
CLASSIFIERS = (
    ((0, 4, 3, 15), (1.98215, 2.35817, 2.63523)),
    ((4, 4, 6, 15), (-1.03809, -0.651211, -0.282167)),
    ((1, 0, 4, 16), (-0.298702, 0.119262, 0.558497)),
    ((3, 8, 2, 12), (-0.105439, 0.0153946, 0.135898)),
    ((3, 4, 4, 8), (-0.142891, 0.0258736, 0.200632)),
    ((4, 0, 3, 5), (-0.826319, -0.590612, -0.368214)),
    ((1, 2, 2, 9), (-0.557409, -0.233035, 0.0534525)),
    ((2, 7, 3, 4), (-0.0646826, 0.00620476, 0.0784847)),
    ((2, 6, 2, 16), (-0.192387, -0.029699, 0.215855)),
    ((2, 1, 3, 2), (-0.0397818, -0.00568076, 0.0292026)),
    ((5, 10, 1, 15), (-0.53823, -0.369934, -0.190235)),
    ((3, 6, 2, 10), (-0.124877, 0.0296483, 0.139239)),
    ((2, 1, 1, 14), (-0.101475, 0.0225617, 0.231971)),
    ((3, 5, 6, 4), (-0.0799915, -0.00729616, 0.063262)),
    ((1, 9, 2, 12), (-0.272556, 0.019424, 0.302559)),
    ((3, 4, 2, 14), (-0.164292, -0.0321188, 0.0846339)),
)
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
GRAY = (0, 1, 3, 2)


@dataclass(frozen=True)
class ChromaProfile:
    rate: int = 11025
    size: int = 4096
    hop: int = 1365
    window: str = "Hamming"
    low: float = 28
    high: float = 3520
    mapping: str = "chromaprint"
    least_norm: float = 0.01
    classifiers: tuple = field(default=CLASSIFIERS)

    @property
    def scale(self) -> float:
        return self.hop / self.rate


CHROMA_PROFILES = {"default": ChromaProfile(), "sync": ChromaProfile(5512, 2048, 64, mapping="paper")}


def rectangles(sums: np.ndarray, kind: int, y: int, h: int, w: int, n: int) -> np.ndarray:
    """log(1 + a) - log(1 + b) of two areas of blocks of h classes from y on and w frames, for the n blocks that start one frame apart; sums are those of
    all classes and frames before."""

    def area(top: int, height: int, left: int, width: int) -> np.ndarray:
        here, after = sums[left : left + n], sums[left + width : left + width + n]
        return after[:, y + top + height] - here[:, y + top + height] - after[:, y + top] + here[:, y + top]

    half, mid, t, u = h // 2, w // 2, h // 3, w // 3
    if kind == 0:
        a, b = area(0, h, 0, w), np.zeros(n)
    elif kind == 1:
        a, b = area(half, h - half, 0, w), area(0, half, 0, w)
    elif kind == 2:
        a, b = area(0, h, mid, w - mid), area(0, h, 0, mid)
    elif kind == 3:
        a, b = area(half, h - half, 0, mid) + area(0, half, mid, w - mid), area(0, half, 0, mid) + area(half, h - half, mid, w - mid)
    elif kind == 4:
        a, b = area(t, t, 0, w), area(0, t, 0, w) + area(2 * t, h - 2 * t, 0, w)
    else:
        a, b = area(0, h, u, u), area(0, h, 0, u) + area(0, h, 2 * u, w - 2 * u)
    return np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))


def chroma_image(values: np.ndarray, p: ChromaProfile) -> np.ndarray:
    power = np.abs(np.fft.rfft(_frames(values, p.size, p.hop) * np.array(WindowConfig(p.window, p.size).values()), axis=1)[:, : p.size // 2]) ** 2
    out = np.zeros((len(power), 12))
    for k, c in chroma_classes(p.rate, p.size, p.low, p.high, p.mapping):
        out[:, c] += power[:, k]
    n = len(out) - len(SMOOTHING) + 1
    if n < 1:
        return np.zeros((0, 12))
    out = sum(w * out[k : k + n] for k, w in enumerate(SMOOTHING))
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm < p.least_norm, 0.0, out / np.maximum(norm, p.least_norm))


def chromaprint(values: np.ndarray, p: ChromaProfile = CHROMA_PROFILES["default"]) -> list[tuple[int, int, bool]]:
    image = chroma_image(values, p)
    n = max(0, len(image) - max(w for (_, _, _, w), _ in p.classifiers) + 1)
    sums = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    words = np.zeros(n, np.int64)
    for (kind, y, h, w), bars in p.classifiers if n else ():
        level = np.searchsorted(np.array(bars), rectangles(sums, kind, y, h, w, n), "right")
        words = words << 2 | np.array(GRAY)[level]
    return [(f, h, False) for f, h in enumerate(words.tolist())]


# ---- Echoprint (Ellis et al. 2011): onsets in subbands of the whitened signal

#: The analysis window of the 8-band filter bank, as published with Echoprint.
ANALYSIS_WINDOW = (
    0.000000477, 0.000000954, 0.000001431, 0.000002384, 0.000003815, 0.000006199, 0.000009060, 0.000013828,
    0.000019550, 0.000027657, 0.000037670, 0.000049591, 0.000062943, 0.000076771, 0.000090599, 0.000101566,
    -0.000108242, -0.000106812, -0.000095367, -0.000069618, -0.000027180, 0.000034332, 0.000116348, 0.000218868,
    0.000339031, 0.000472546, 0.000611782, 0.000747204, 0.000866413, 0.000954151, 0.000994205, 0.000971317,
    -0.000868797, -0.000674248, -0.000378609, 0.000021458, 0.000522137, 0.001111031, 0.001766682, 0.002457142,
    0.003141880, 0.003771782, 0.004290581, 0.004638195, 0.004752159, 0.004573822, 0.004049301, 0.003134727,
    -0.001800537, -0.000033379, 0.002161503, 0.004756451, 0.007703304, 0.010933399, 0.014358521, 0.017876148,
    0.021372318, 0.024725437, 0.027815342, 0.030526638, 0.032754898, 0.034412861, 0.035435200, 0.035780907,
    -0.035435200, -0.034412861, -0.032754898, -0.030526638, -0.027815342, -0.024725437, -0.021372318, -0.017876148,
    -0.014358521, -0.010933399, -0.007703304, -0.004756451, -0.002161503, 0.000033379, 0.001800537, 0.003134727,
    -0.004049301, -0.004573822, -0.004752159, -0.004638195, -0.004290581, -0.003771782, -0.003141880, -0.002457142,
    -0.001766682, -0.001111031, -0.000522137, -0.000021458, 0.000378609, 0.000674248, 0.000868797, 0.000971317,
    -0.000994205, -0.000954151, -0.000866413, -0.000747204, -0.000611782, -0.000472546, -0.000339031, -0.000218868,
    -0.000116348, -0.000034332, 0.000027180, 0.000069618, 0.000095367, 0.000106812, 0.000108242, 0.000101566,
    -0.000090599, -0.000076771, -0.000062943, -0.000049591, -0.000037670, -0.000027657, -0.000019550, -0.000013828,
    -0.000009060, -0.000006199, -0.000003815, -0.000002384, -0.000001431, -0.000000954, -0.000000477, 0.0,
)


@dataclass(frozen=True)
class OnsetProfile:
    rate: int = 11025
    poles: int = 40
    block: int = 10_000
    alpha: float = 1 / 8
    rms_size: int = 8
    rms_hop: int = 4
    over: float = 1.1
    least_distance: int = 128
    target_distance: int = 345
    quantum: float = 8.0
    seed: int = 0x9EA5FA36
    mask: int = 0xFFFFF
    #: True flushes only about half of the onsets left at the end.
    short_flush: bool = True

    @property
    def scale(self) -> float:
        return 8 * self.rms_hop * self.quantum / self.rate


def whiten(values: np.ndarray, p: OnsetProfile = OnsetProfile()) -> np.ndarray:
    """Prediction error of a linear predictor, refitted block by block from smoothed autocorrelations; a block no longer than the number of poles is silence."""
    k = p.poles
    r = np.zeros(k + 1)
    r[0] = 0.001
    carry, out = np.zeros(k), np.zeros(len(values))
    for at in range(0, len(values), p.block):
        x = values[at : at + p.block]
        if len(x) <= k:
            continue
        r += p.alpha * (np.array([x[i:] @ x[: len(x) - i] for i in range(k + 1)]) - r)
        a = np.zeros(k + 1)
        error = r[0]
        for i in range(1, k + 1):
            reflect = (r[i] - a[1:i] @ r[i - 1 : 0 : -1]) / error
            a[1:i] = a[1:i] - reflect * a[i - 1 : 0 : -1]
            a[i] = reflect
            error *= 1 - reflect * reflect
        joined = np.concatenate([carry, x])
        out[at : at + len(x)] = x - np.convolve(joined, a)[k : k + len(x)]
        carry = x[-k:]
    return out


def subband_energies(values: np.ndarray) -> np.ndarray:
    """8 bands, a frame every 8 samples."""
    folded = (_frames(values, 128, 8) * np.array(ANALYSIS_WINDOW)).reshape(-1, 8, 16).sum(1)
    i, j = np.arange(8)[:, None], np.arange(16)
    angle = (2 * i + 1) * (j - 4) * np.pi / 16
    return (folded @ np.cos(angle).T) ** 2 + (folded @ np.sin(angle).T) ** 2


def murmur2(data: bytes, seed: int) -> int:
    """MurmurHash2, 32 bits, for keys whose length leaves at most one byte over a multiple of four."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = seed ^ len(data)
    for at in range(0, len(data) - 3, 4):
        k = int.from_bytes(data[at : at + 4], "little") * m & mask
        k = (k ^ k >> 24) * m & mask
        h = (h * m & mask) ^ k
    if len(data) % 4:
        h = (h ^ data[-1]) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


#: Taps of the detector's filter, and how far the three onsets behind a hash's distances lie ahead of each other.
TAPS = (0.1883, 0.4230, 0.3392)
HOPS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))


def onset_hashes(band: int, o: list[int], p: OnsetProfile) -> list[tuple[int, int]]:
    """(time, hash) of up to six successive onsets: the distances of three of them, by band."""
    if len(o) <= 2:
        return []
    q = lambda v: round(v / p.quantum)
    out = []
    for a, b, c in HOPS:
        d = (q(o[b] - o[a]), q(o[c] - o[b])) if c < min(len(o), 5) else (0, 0)
        key = b"".join((v & 0xFFFF).to_bytes(2, "big") for v in d) + bytes([band])
        out.append((q(o[0]), murmur2(key, p.seed) & p.mask))
    return out


def band_onsets(band: int, levels: np.ndarray, p: OnsetProfile) -> list[tuple[int, int]]:
    """Hashes of one band's onsets: where filtered levels (from rise()) fall below an adaptive threshold again."""
    out: list[tuple[int, int]] = []
    onsets: list[int] = []
    bar, total, tau, was, since = float(levels[0, 1]), 0, 1, False, 0
    for count, x in enumerate(levels[:, 0].tolist()):
        above = x > bar
        bar = x * p.over if above else bar * math.exp(-1 / tau)
        if was and not above:
            merged = total > 0 and count - onsets[-1] < p.least_distance
            if merged:
                onsets.pop()
                total -= 1
            onsets = [*onsets, count][-6:]
            total += 1
            since = 0
            if not merged and total > 1 and len(onsets) == 6:
                out += onset_hashes(band, onsets, p)
        since += 1
        tau = max(1, tau - 1) if since > p.target_distance else tau + 1
        was = above
    for k in range((len(onsets) + 1) // 2 if p.short_flush else len(onsets)):
        out += onset_hashes(band, onsets[k + 1 :], p)
    return out


def rise(rms: np.ndarray) -> np.ndarray:
    """Levels of all bands (times x bands): differences about the middle of seven values, summed up with a slow decay."""
    n = len(rms)
    x = np.zeros_like(rms)
    for k, c in enumerate(TAPS):
        x[6:] += c * (rms[6 - k : n - k] - rms[k : n - 6 + k])
    for t in range(1, n):
        x[t] += 0.98 * x[t - 1]
    return x


def echoprint(values: np.ndarray, p: OnsetProfile = OnsetProfile()) -> list[tuple[int, int, bool]]:
    energies = subband_energies(whiten(values, p))
    window = np.array(WindowConfig("Hann", p.rms_size).values())
    ends = np.arange(p.rms_size, len(energies) + 1)
    ends = ends[ends % p.rms_hop == 0]
    if not len(ends):
        return []
    rms = np.sqrt(np.einsum("w,twb->tb", window, energies[ends[:, None] + np.arange(-p.rms_size, 0)]))
    x = rise(rms)
    return sorted((t, h, False) for b in range(8) for t, h in band_onsets(b, np.stack([x[:, b], rms[:, b]], 1), p))


# ---- Spark

KERNELS = {"hk": haitsma_kalker, "wang": wang, "chromaprint": chromaprint, "echoprint": echoprint}
SOURCES = {"hk": "FP-HK02", "wang": "FP-W03", "chromaprint": "FP-CP", "echoprint": "FP-EP"}


#: Frames of a block. Generators whose hashes depend on few frames are dealt in blocks: on how many before and after, by profile.
BLOCK_FRAMES = 1024
REACH = {"hk": lambda p: (1, 0), "chromaprint": lambda p: (0, len(SMOOTHING) - 1 + max(w for (_, _, _, w), _ in p.classifiers) - 1)}
DEFAULTS = {"hk": BAND_PROFILES["default"], "wang": PEAK_PROFILES["default"], "chromaprint": CHROMA_PROFILES["default"], "echoprint": OnsetProfile()}


@dataclass(frozen=True)
class Held:
    """Signals kept as samples that each stand for `times` ones of the signal, worked out where they are needed: change(values, idx, track_id) of the values held."""

    times: int
    change: Callable[[np.ndarray, np.ndarray, int], np.ndarray] = lambda values, idx, track: values


def in_blocks(df: DataFrame, kernel: Callable[[np.ndarray], pd.DataFrame], schema: str, size: int, hop: int, reach: tuple[int, int] | None, held: Held | None = None) -> DataFrame:
    """Signals (track_id, idx, value) -> rows of kernel(values), with idx the frame, under their track. With reach (frames before, frames after), tracks of
    any length are dealt in blocks with the frames around them that a row depends on; without it a track is taken at a time. What is shuffled and sorted
    are the rows of df, so held samples are far less than those of the signal."""
    times = held.times if held else 1
    before, after = reach or (0, 0)
    span = BLOCK_FRAMES * hop if reach else 1

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        block, track = int(part["block"].iloc[0]), part["track_id"].iloc[0]
        values = part["value"].to_numpy(float)
        if held:
            idx = (part["idx"].to_numpy()[:, None] * times + np.arange(times)).ravel()
            own = slice(None)
            if reach:
                first, end = max(0, block * BLOCK_FRAMES - before) * hop, ((block + 1) * BLOCK_FRAMES - 1 + after) * hop + size
                own = slice(*np.searchsorted(idx, [first, end]).tolist())
            values = held.change(np.repeat(values, times)[own], idx[own], track)
        out = kernel(values)
        out.insert(0, "track_id", track)
        if reach:
            out["idx"] += max(0, block * BLOCK_FRAMES - before)
            out = out[(out["idx"] >= block * BLOCK_FRAMES) & (out["idx"] < (block + 1) * BLOCK_FRAMES)]
        return out

    rows = df.select("track_id", "idx", F.col("value").cast("double").alias("value"))
    if reach:
        low = F.ceil((F.col("idx") * times - (size - 1) - (BLOCK_FRAMES - 1 + after) * hop) / span)
        high = F.floor((F.col("idx") * times + (times - 1) + before * hop) / span)
        rows = rows.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), low), high)))
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    return rows.groupBy("track_id", "block").applyInPandas(run, "track_id long, idx long, " + schema)


def hashes(df: DataFrame, kind: str, profile=None, held: Held | None = None) -> DataFrame:
    """Mono signals (track_id, idx, value) -> hashes. Where a hash depends on few frames, tracks of any length are dealt in blocks with the
    frames around them; generators with a running state take a track at a time."""
    kernel, profile = KERNELS[kind], profile or DEFAULTS[kind]

    def run(values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(kernel(values, profile), columns=["idx", "hash", "is_variation"]).astype({"idx": "int64", "hash": "int64", "is_variation": bool})

    blocked = kind in REACH
    return in_blocks(df, run, "hash long, is_variation boolean", profile.size if blocked else 1, profile.hop if blocked else 1, REACH[kind](profile) if blocked else None, held)


def pair_peaks(peaks: DataFrame, p: PeakProfile = PEAK_PROFILES["default"]) -> DataFrame:
    """Peaks (track_id, frame_idx, bin, energy) -> (track_id, idx, hash): each with the peaks of a zone ahead, in frames and bins, the `fanout` pairs of a
    frame with the largest mean energy. Frames ahead are exploded on one side, so the zone is an equi-join; frames are counted as given."""
    a = peaks.select("track_id", F.col("frame_idx").alias("idx"), F.col("bin").alias("b1"), F.col("energy").alias("e1"), F.explode(F.sequence(F.lit(p.distance), F.lit(p.distance + p.length - 1))).alias("d"))
    b = peaks.select("track_id", F.col("frame_idx").alias("ahead"), F.col("bin").alias("b2"), F.col("energy").alias("e2"))
    pairs = a.withColumn("ahead", F.col("idx") + F.col("d")).join(b, ["track_id", "ahead"]).where(F.abs(F.col("b1") - F.col("b2")) <= p.width / 2)
    order = Window.partitionBy("track_id", "idx").orderBy(F.desc(F.col("e1") + F.col("e2")), "b1", "b2", "d")
    pairs = pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= p.fanout)
    return pairs.select("track_id", "idx", pack_peaks(F.col("b1"), F.col("b2"), F.col("d")).alias("hash"))
