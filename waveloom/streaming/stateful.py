"""Structured Streaming forms of the stream operators: state is kept per track, order is idx, late or repeated idx are dropped and counted."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fingerprints import BAND_PROFILES, CHROMA_PROFILES, PEAK_PROFILES, BandProfile, ChromaProfile, PeakProfile, band_energies, band_hashes, chromaprint, frame_peaks, zone_hashes


class RingBuffer:
    """The last `capacity` items; index 0 is the oldest."""

    def __init__(self, capacity: int):
        self.capacity, self.items = capacity, []

    def write(self, items) -> None:
        self.items = [*self.items, *items][-self.capacity :] if self.capacity else []

    def __len__(self):
        return len(self.items)

    def __getitem__(self, k):
        return self.items[k]


class LossyFifo:
    """A reader behind a ring: what is overwritten before it is read is lost, and lost items are counted."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.lost, self.ended = capacity, [], 0, False

    def write(self, items) -> None:
        if self.ended:
            raise ValueError("written after the end of input")
        self.items += list(items)
        over = max(0, len(self.items) - self.capacity)
        self.lost += over
        self.items = self.items[over:]

    def read(self, n: int) -> list:
        out, self.items = self.items[:n], self.items[n:]
        return out

    def end(self) -> None:
        self.ended = True


class BlockingFifo(LossyFifo):
    """A reader that waits: nothing is lost, read() gives None while there is nothing yet, and an empty list after the end of input; the length is
    known only then."""

    def __init__(self):
        super().__init__(1 << 62)
        self.written = 0

    def write(self, items) -> None:
        items = list(items)
        super().write(items)
        self.written += len(items)

    def read(self, n: int) -> list | None:
        return super().read(n) if self.items or self.ended else None

    def __len__(self):
        return self.written if self.ended else sys.maxsize


def _ordered(parts: Iterator[pd.DataFrame], after: int) -> tuple[np.ndarray, int, int]:
    """Values with idx above `after` in order, the new last idx, and how many rows were late or repeated."""
    rows = pd.concat(list(parts))
    n = len(rows)
    rows = rows[rows["idx"] > after].drop_duplicates("idx").sort_values("idx")
    return rows["value"].to_numpy(float), int(rows["idx"].iloc[-1]) if len(rows) else after, n - len(rows)


#: Samples that a live generator works out at a time, so a track that comes at once takes no more memory than one in parts.
STRETCH = 1 << 17


def runs(df: DataFrame, times: int, low: int = 0, high: int | None = None) -> DataFrame:
    """Samples (track_id, idx, value) that are each held `times` times -> runs (track_id, idx, n, value) of n equal samples from idx on. Those below
    `low` or not below `high`, counted as they are held, are left out, so a run may be cut."""
    first, after = F.greatest(F.col("idx") * times, F.lit(low)), (F.col("idx") + 1) * times
    after = after if high is None else F.least(after, F.lit(high))
    rows = df.select("track_id", first.cast("long").alias("idx"), (after - first).cast("long").alias("n"), F.col("value").cast("double").alias("value"))
    return rows.where("n > 0")


class Runs:
    """Samples in order, as runs of equal ones: n samples of a value from an idx on."""

    def __init__(self, idx, n, value):
        self.idx, self.n, self.value = np.asarray(idx, np.int64), np.asarray(n, np.int64), np.asarray(value, float)
        self.ends = self.n.cumsum()

    def __len__(self):
        return int(self.ends[-1]) if len(self.ends) else 0

    def __add__(self, other: Runs) -> Runs:
        return Runs(*(np.concatenate(x) for x in ((self.idx, other.idx), (self.n, other.n), (self.value, other.value))))

    def cut(self, a: int, b: int) -> Runs:
        """Samples a to b - 1, counted from the first."""
        own = slice(np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b, "left") + 1)
        first = self.ends[own] - self.n[own]
        low, high = np.maximum(a - first, 0), np.minimum(b - first, self.n[own])
        some = high > low
        return Runs((self.idx[own] + low)[some], (high - low)[some], self.value[own][some])

    def values(self) -> np.ndarray:
        return np.repeat(self.value, self.n)

    def places(self) -> np.ndarray:
        """The idx of every sample."""
        return np.repeat(self.idx - self.ends + self.n, self.n) + np.arange(len(self))

    def state(self, places: bool) -> tuple[list, list, list]:
        """As lists, without the idx where they are not asked for, and without lengths that are all one."""
        return self.idx.tolist() if places else [], self.n.tolist() if (self.n > 1).any() else [], self.value.tolist()

    @classmethod
    def of_state(cls, idx, n, value) -> Runs:
        return cls(idx or [0] * len(value), n or [1] * len(value), value)


def _ordered_runs(parts: Iterator[pd.DataFrame], after: int) -> tuple[Runs, int]:
    """Runs (a row without n is one sample) in order, without samples whose idx is not above `after` or comes again, and the new last idx."""
    rows = pd.concat(list(parts))
    idx, value = rows["idx"].to_numpy(np.int64), rows["value"].to_numpy(float)
    n = rows["n"].to_numpy(np.int64) if "n" in rows else np.ones(len(rows), np.int64)
    late = np.clip(after + 1 - idx, 0, n)
    idx, n = idx + late, n - late
    order = np.flatnonzero(n)[np.argsort(idx[n > 0], kind="stable")]
    found = Runs(idx[order], n[order], value[order])
    if (found.idx[1:] < found.idx[:-1] + found.n[:-1]).any():
        # of samples that come again the first to come stays
        came = Runs(idx, n, value)
        places, at = np.unique(came.places(), return_index=True)
        found = Runs(places, np.ones(len(places)), came.values()[at])
    return found, int(found.idx[-1] + found.n[-1] - 1) if len(found) else after


def _live(stream: DataFrame, step: Callable, fresh: tuple, carried: str, change: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None) -> DataFrame:
    """Hashes of a stream of samples (track_id, idx, value) or runs of them, with n. step(samples, *carry) gives (frame, hash) of what it can work out,
    how many samples it is done with, and the carry, which is `fresh` at first and of the types `carried`. With `change`, a sample is
    change(values, idx, track_id) of those that came; they are sent and kept as they came, which takes far less room if they are runs."""
    stretch = STRETCH

    def run(key, parts, state: GroupState):
        last, idx, n, value, *carry = state.get if state.exists else (-1, [], [], [], *fresh)
        came, last = _ordered_runs(parts, last)
        held = Runs.of_state(idx, n, value) + came
        at, room, more = 0, stretch, True
        while more:
            part = held.cut(at, at + room)
            more = at + len(part) < len(held)
            values = part.values() if change is None else change(part.values(), part.places(), key[0])
            rows, done, carry = step(values, *carry)
            at, room = min(at + done, len(held)), stretch if done else 2 * room
            if not more:
                state.update((last, *held.cut(at, len(held)).state(change is not None), *carry))
            yield pd.DataFrame([(key[0], f, h) for f, h in rows], columns=["track_id", "idx", "hash"])

    schema = f"last long, tail_idx array<long>, tail_n array<long>, tail array<double>, {carried}"
    return stream.groupBy("track_id").applyInPandasWithState(run, "track_id long, idx long, hash long", schema, "append", GroupStateTimeout.NoTimeout)


def hop_frames(stream: DataFrame, size: int, hop: int) -> DataFrame:
    """A stream of (track_id, idx, value) -> frames, as soon as they are full: (track_id, frame_idx, values, n_late). State is the tail
    of less than size + hop samples."""

    def run(key, parts, state: GroupState):
        last, frame, skip, tail = state.get if state.exists else (-1, 0, 0, [])
        values, last, late = _ordered(parts, last)
        held = np.concatenate([np.array(tail, float), values])
        cut = min(skip, len(held))
        held, skip = held[cut:], skip - cut
        out = []
        while not skip and len(held) >= size:
            out.append((key[0], frame, held[:size].tolist(), late))
            frame += 1
            skip = max(0, hop - len(held))
            held = held[hop:]
        state.update((last, frame, skip, held.tolist()))
        yield pd.DataFrame(out, columns=["track_id", "frame_idx", "values", "n_late"])

    return stream.groupBy("track_id").applyInPandasWithState(
        run, "track_id long, frame_idx long, values array<double>, n_late long", "last long, frame long, skip long, tail array<double>", "append", GroupStateTimeout.NoTimeout
    )


def live_hashes(stream: DataFrame, profile: BandProfile = BAND_PROFILES["default"], change: Callable | None = None) -> DataFrame:
    """Sub-fingerprints of a stream, without variations; state is the tail of samples, the last band energies and the next index."""

    def step(values, index, before):
        energies = band_energies(values, profile)
        rows = band_hashes(np.vstack([np.array(before)[None, :], energies]), 0, profile.reversed_sign)[1:]
        return [(index + k, h) for k, (_, h, _) in enumerate(rows)], len(energies) * profile.hop, (index + len(rows), energies[-1].tolist() if len(energies) else list(before))

    return _live(stream, step, (0, [0.0] * profile.bands), "index long, before array<double>", change)


def live_chromaprint(stream: DataFrame, profile: ChromaProfile = CHROMA_PROFILES["default"], change: Callable | None = None) -> DataFrame:
    """Chromaprint hashes of a stream. A hash needs the frames of its rectangles only, so the state is the samples of frames without a hash yet."""

    def step(values, index):
        rows = chromaprint(values, profile)
        return [(index + f, h) for f, h, _ in rows], len(rows) * profile.hop, (index + len(rows),)

    return _live(stream, step, (0,), "index long", change)


def live_wang(stream: DataFrame, profile: PeakProfile = PEAK_PROFILES["default"], change: Callable | None = None) -> DataFrame:
    """Wang hashes of a stream, as soon as a frame's whole zone has come. State is the tail of samples, the running average of spectra, and the
    peaks of frames whose zone is open: (frame, bins, energies)."""
    zone = profile.distance + profile.length - 1

    def step(values, index, average, frames, bins, energies):
        kept = [(f, list(zip(b, e))) for f, b, e in zip(frames, bins, energies)]
        found, average, n = frame_peaks(values, profile, np.array(average) if average else None)
        kept += [(f + index, peaks) for f, peaks in found]
        whole = max(0, len(kept) - zone)
        rows, kept = zone_hashes(kept, whole, profile), kept[whole:]
        frames, bins, energies = [f for f, _ in kept], [[int(b) for b, _ in p] for _, p in kept], [[float(e) for _, e in p] for _, p in kept]
        return rows, n * profile.hop, (index + n, [] if average is None else average.tolist(), frames, bins, energies)

    return _live(stream, step, (0, [], [], [], []), "index long, average array<double>, frames array<long>, bins array<array<long>>, energies array<array<double>>", change)


def lossy(stream: DataFrame, capacity: int, read: int) -> DataFrame:
    """A reader that takes `read` samples of each track after each micro-batch from a buffer of `capacity`: (track_id, first, values, lost). `first` is
    the idx of the first sample taken, lost how many were overwritten so far. idx are dense."""

    def run(key, parts, state: GroupState):
        last, held, lost = state.get if state.exists else (-1, [], 0)
        values, last, _ = _ordered(parts, last)
        fifo = LossyFifo(capacity)
        fifo.write(held)
        fifo.write(values.tolist())
        first = last + 1 - len(fifo.items)
        out = fifo.read(read)
        state.update((last, fifo.items, lost + fifo.lost))
        yield pd.DataFrame([(key[0], first, out, lost + fifo.lost)], columns=["track_id", "first", "values", "lost"])

    return stream.groupBy("track_id").applyInPandasWithState(run, "track_id long, first long, values array<double>, lost long", "last long, held array<double>, lost long", "append", GroupStateTimeout.NoTimeout)


def ring(stream: DataFrame, capacity: int) -> DataFrame:
    """The last `capacity` samples of each track, after each micro-batch: (track_id, last, values)."""

    def run(key, parts, state: GroupState):
        last, held = state.get if state.exists else (-1, [])
        values, last, _ = _ordered(parts, last)
        buffer = RingBuffer(capacity)
        buffer.write(held)
        buffer.write(values.tolist())
        state.update((last, buffer.items))
        yield pd.DataFrame([(key[0], last, buffer.items)], columns=["track_id", "last", "values"])

    return stream.groupBy("track_id").applyInPandasWithState(run, "track_id long, last long, values array<double>", "last long, held array<double>", "update", GroupStateTimeout.NoTimeout)
