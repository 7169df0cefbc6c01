"""Order-preserving packing by dynamic programming over window cuts.

Documents, in ascending doc_id order, form one stream of ids. A window (a training sequence) is a run of the stream
between two cuts, at most `window` ids long. Cuts may stand at document ends (free), at sentence ends (a truncation
penalty) and, in stretches without either, at every `stride`-th id (a larger penalty). A window shorter than
`window` is padded, unless its length is a power of two. best(j) = penalty(j) + cost of a sequence + min over i of best(i) + padding(j - i);
as padding is window - (j - i), the minimum of best(i) + i over the last `window` ids is kept in a monotone queue,
and the powers of two are looked up, so the work is linear in the number of possible cuts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hold, slices
from .token_ids import SLICE_BYTES, SLICE_ROWS, default_path, encoder, sentence_ends

WINDOW = 2048
#: Padding ids that a cut costs at a sentence end and elsewhere, how far apart the latter stand, and what a sequence costs besides, so
#: that windows of small powers of two, which need no padding, are not made of what fits into others.
SENTENCE_PENALTY, HARD_PENALTY, STRIDE, SEQUENCE = 1.0, 24.0, 128, 64.0
#: The dynamic programme is closed, at a cut it chose, after so many ids, so that a task's memory is bounded.
BLOCK = 1 << 19


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts (after so many ids, ascending) and their penalties."""
    free = np.unique(doc_ends)
    soft = np.setdiff1d(np.flatnonzero(ends_sentence[ids]) + 1, free, assume_unique=True)
    places = np.concatenate([free, soft])
    cost = np.concatenate([np.zeros(len(free)), np.full(len(soft), SENTENCE_PENALTY)])
    order = np.argsort(places)
    places, cost = places[order], cost[order]
    gaps = np.diff(np.concatenate([[0], places]))
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        before = np.concatenate([[0], places])[wide]
        count = (gaps[wide] - 1) // stride
        hard = np.repeat(before, count) + stride * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        places, cost = np.concatenate([places, hard]), np.concatenate([cost, np.full(len(hard), HARD_PENALTY)])
        order = np.argsort(places)
        places, cost = places[order], cost[order]
    return places, cost


def choose(places: np.ndarray, cost: np.ndarray, window: int = WINDOW, sequence: float = SEQUENCE) -> list[int]:
    """The cuts, from 0 to the last place, with the least padding, penalties and cost of sequences. Ties go to the longer window.

    With f(j) = best(j) + j, a padded window from i to j costs f(j) = f(i) + window + what the cut costs, and an exact one of
    p ids f(i) + p instead; f's minimum over the last `window` ids stands at the head of the queue.
    """
    at = np.concatenate([[0], places])
    # cuts from which a window to this one needs no padding; the longest comes first
    exact: dict[int, list[tuple[int, int]]] = {}
    for p in (1 << b for b in reversed(range(window.bit_length())) if 1 << b < window):
        k = np.searchsorted(at, at - p)
        hits = np.flatnonzero((at >= p) & (at[k] == at - p))
        for j, i in zip(hits.tolist(), k[hits].tolist()):
            exact.setdefault(j, []).append((i, p))
    best, back = [0.0], [0]
    places_, values, sources, head = [0], [0.0], [0], 0
    for k, (j, c) in enumerate(zip(places.tolist(), (cost + sequence).tolist()), 1):
        while places_[head] < j - window:
            head += 1
        low, source = values[head] + window, sources[head]
        if k in exact:
            for i, p in exact[k]:
                if best[i] + p < low:
                    low, source = best[i] + p, i
        low += c
        best.append(low)
        back.append(source)
        while len(values) > head and values[-1] > low:
            places_.pop(), values.pop(), sources.pop()
        places_.append(j), values.append(low), sources.append(k)
    cuts, k = [], len(at) - 1
    while k:
        cuts.append(int(at[k]))
        k = back[k]
    return [0, *reversed(cuts)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence.

    Null text counts as empty and has its end id only. Documents with one doc_id are packed in the order of their texts,
    a null doc_id first. Repeated rows are packed repeatedly. An empty table has no pieces; other columns are ignored.
    Range partitions are packed each for itself, so at most one sequence a partition is short for lack of ids;
    sequence_id is the partition number times 2**32 plus the sequence's number there.
    """
    tokenizer = tokenizer or default_path()

    def run(batches):
        from pyspark import TaskContext

        hold("encoder")
        encode, ends_sentence = encoder(tokenizer), sentence_ends(tokenizer)
        tail = np.array([end_id], encode.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 32
        names, parts, skip, size = [], [], 0, 0  # the held documents; the first `skip` ids of the first one are packed

        def flush(last: bool):
            nonlocal names, parts, skip, size, sequence
            lengths = np.array([len(p) // encode.dtype.itemsize for p in parts], np.int64)
            ends = np.cumsum(lengths)
            ids = np.frombuffer(b"".join(parts), encode.dtype)
            places, cost = possible_cuts(ids[skip:], ends - skip, ends_sentence, max(1, min(STRIDE, window // 8)))
            cuts = np.array(choose(places, cost, window), np.int64) + skip
            if not last:  # the tail is decided with what follows
                cuts = cuts[: max(2, len(cuts) - 4)]
            bounds = np.unique(np.concatenate([cuts, ends[(ends > cuts[0]) & (ends < cuts[-1])]]))
            a, b = bounds[:-1], bounds[1:]
            owner = np.searchsorted(ends, a, "right")
            window_of = np.searchsorted(cuts, a, "right") - 1
            wide = ids.astype("<u4")
            begin = ends - lengths
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k] for k in owner.tolist()], pa.int64()), pa.array(a - begin[owner]), pa.array(b - a),
                    pa.array([zlib.crc32(wide[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist())], pa.int64()),
                    pa.array(lengths[owner]), pa.array(sequence + window_of), pa.array(a - cuts[window_of]),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts) - 1
            first = int(np.searchsorted(ends, cuts[-1], "right"))
            gone = int(begin[first]) if first < len(names) else int(ends[-1])
            skip = int(cuts[-1]) - gone
            names, parts = names[first:], parts[first:]
            size = sum(len(p) for p in parts) // encode.dtype.itemsize - skip
            return out

        for batch in slices(batches, 1, SLICE_ROWS, SLICE_BYTES):
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.encode_many(batch.column(1))):
                own += tail
                names.append(doc_id)
                parts.append(own)
                size += len(own) // encode.dtype.itemsize
                if size >= BLOCK:
                    yield flush(False)
        if size:
            yield flush(True)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, PIECES)
