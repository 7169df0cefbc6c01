"""Similarity join on word shingles: every pair of texts with Jaccard similarity of at least THRESHOLD.

1. Texts that are equal (128-bit hash) become one node with a multiplicity, so copies are never paired.
2. Candidates are exact: of a set of n shingles, ordered from rare to frequent by a sketch of fixed size, the first
   n - ceil(t * n) + COMMON must hold COMMON in common with any set that is similar enough (prefix filtering), and sizes must fit.
   What many texts share comes last, so common passages make no candidates; phrases that meet by chance seldom meet COMMON times.
   The sketch only orders; its errors cost time, not links. Sets that need fewer than COMMON common shingles ask for one.
3. Nodes that agree in three least values form blocks of about BLOCK nodes (large ones are split by a hash), and candidates are
   pairs of blocks, each once. A group of near copies is a few blocks, not all pairs of its members.
4. Bayesian pruning (Satuluri and Parthasarathy, 2012): MinHash values of pairs in a pair of blocks are compared a few at a
   time; a pair is dropped once the posterior probability that its similarity reaches the threshold is below TOLERANCE.
5. What is left is verified exactly on whole shingle sets, and links are counted where they are found: a pair of blocks sends
   a count for each node and the edges of a spanning forest, so output is linear in nodes.
6. Components by alternating large-star and small-star steps (Kiveris et al., 2014).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import keep_last, scope
from .common import hold, materialize, slices, text_of, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a text, how many are compared at a time, and the posterior probability below which a pair goes.
HASHES, STEP, TOLERANCE = 64, 8, 1e-8
#: Nodes of a block, about; buckets of the frequency sketch; shingles that two prefixes must have in common.
BLOCK, SKETCH_BITS, COMMON = 128, 18, 6
#: Postings of a shingle beyond which they are paired by several tasks.
LONG = 2048
#: The frequency class from which a shingle counts as very frequent: seven times the mean of the sketch.
FREQUENT = 12
#: Fixed multipliers, odd, derived from the golden ratio's sequence.
_MIX = [((2 * k + 1) * 0x9E3779B97F4A7C15 ^ (k * 0xD1B54A32D192ED03)) % (1 << 64) | 1 for k in range(HASHES + WORDS)]


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles (with repeats), and how many each text has. A text of fewer than n words has one
    shingle, all its words; one without words has none."""
    flat, sizes = word_hashes(texts, xxhash.xxh64_intdigest)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(n):
        rolled[: len(flat) - k] += flat[k:] * np.uint64(_MIX[k])
    rolled = _finish(rolled)
    for i in short.tolist():
        own = flat[starts[i] : starts[i] + sizes[i]]
        mixed = int(sum(int(h) * _MIX[k] for k, h in enumerate(own.tolist()))) + len(own) * _MIX[-1]
        rolled[starts[i]] = _finish(np.array([mixed % (1 << 64)], np.uint64))[0]
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
    return rolled[at], counts


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    flat, counts = shingles(texts, n)
    ends = np.cumsum(counts).tolist()
    out = []
    for a, b in zip([0, *ends], ends):
        s = np.sort(flat[a:b])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
    return out


def prefix_length(n: int, threshold: float, common: int = COMMON) -> int:
    """A set whose least overlap is below `common` has all its elements in the prefix."""
    return min(n, n - least_overlap(n, threshold) + common)


def least_overlap(n: int, threshold: float) -> int:
    """What a set of n must have in common with any set that is similar enough."""
    return math.ceil(threshold * n - 1e-9)


@lru_cache(8)
def least_matches(threshold: float, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values (step, 2 * step, ...): the fewest matches with which a pair goes on.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and it reaches the threshold with the
    probability that a binomial of n + 1 trials is at most m.
    """
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def bayes_survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Places, in i and j, of the pairs left after incremental comparison of signature rows."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int16)
    for k, least in enumerate(least_matches(threshold)):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches += (left[i[alive], cut] == right[j[alive], cut]).sum(1, dtype=np.int16)
        on = matches >= least
        alive, matches = alive[on], matches[on]
        if not len(alive):
            break
    return alive


def _complete_groups(batches, keys: tuple[int, ...]):
    """Tables of complete groups from batches that are sorted by the key columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        first = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        before = held[-1] if held else None
        if first == 0 and before is not None and any(before.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _binary(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles of each of 2**SKETCH_BITS buckets occur, over all documents: a fixed number of counts."""

    def run(batches):
        hold("near_dup")
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, 0, 1000):
            flat, _ = shingles(batch.column(0), n)
            total += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    table = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


FEATURES = "doc_id long, id string, n long, least long, sig binary, prefix array<long>"


def features(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per document: its text's hash, number of shingles, block key, MinHash values and prefix."""
    counts = sketch(docs, n)
    # frequency classes by powers of two over the mean: noise within a class does not matter
    mean = max(1.0, counts.mean())
    rank = np.floor(np.log2(np.maximum(counts, 1) / mean + 1) * 4).astype(np.int64)
    ranks = docs.sparkSession.sparkContext.broadcast(rank.astype(np.int16))
    multipliers = (np.array(_MIX[:HASHES], np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def run(batches):
        rank = ranks.value
        for batch in slices(batches, 2, 1000):
            sets = shingle_sets(batch.column(2), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), HASHES), np.uint16)
            least = np.zeros(len(sets), np.int64)
            prefixes: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                starts = np.cumsum(sizes[some]) - sizes[some]
                low = (flat >> np.uint64(16)).astype(np.uint32)
                key = np.zeros(len(some), np.uint64)
                for k in range(HASHES):
                    smallest = np.minimum.reduceat(low * multipliers[k], starts)
                    sig[some, k] = smallest
                    if k < 3:
                        key += smallest * np.uint64(_MIX[k])
                least[some] = _finish(key).view(np.int64)
                order = rank[(flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # a set that is mostly of very frequent shingles belongs to a large group: its key is taken from these, so that what
                # each member has of its own does not scatter the group over blocks
                common = np.add.reduceat((order >= FREQUENT).astype(np.int64), starts)
                hashed = np.where(order >= FREQUENT, low * multipliers[0], np.uint32(0xFFFFFFFF))
                shared = np.minimum.reduceat(hashed, starts).astype(np.uint64) * np.uint64(_MIX[4])
                least[some] = np.where(2 * common >= sizes[some], _finish(shared).view(np.int64), least[some])
                for i, a in zip(some.tolist(), starts.tolist()):
                    own, ranks_ = sets[i], order[a : a + sizes[i]]
                    # sets are sorted, so a stable sort by rank breaks ties by the hash's value: one order for all texts
                    sorted_ = own[np.argsort(ranks_, kind="stable")]
                    prefixes[i] = sorted_[: prefix_length(len(own), threshold)].view(np.int64)
            lengths = np.cumsum([0, *(len(p) for p in prefixes)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes), pa.array(least), _binary(sig),
                    pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(np.concatenate(prefixes))),
                ],
                ["doc_id", "id", "n", "least", "sig", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of().cast("binary")).alias("id"), text_of().alias("text"))
    return materialize(rows.mapInArrow(run, FEATURES), "near-features")


def _lists(batches):
    """(shingle, None) for lists of more than LONG postings, which are not held, and (None, table) for complete lists besides, from batches sorted by shingle."""
    held: list[pa.RecordBatch] = []
    rows, skipped = 0, None
    for batch in batches:
        h = batch.column(0).to_numpy()
        start = int(np.argmax(h != skipped)) if skipped is not None and (h != skipped).any() else len(h) if skipped is not None else 0
        batch, h = batch.slice(start), h[start:]
        if not len(h):
            continue
        skipped = None
        last = int(np.searchsorted(h, h[-1]))
        if held and (last or held[-1].column(0)[-1].as_py() != h[0]):
            yield None, pa.Table.from_batches([*held, batch.slice(0, last)])
            held, rows = [], 0
        elif last:
            yield None, pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
        rows += len(h) - last
        if rows > LONG:
            skipped = int(h[-1])
            held, rows = [], 0
            yield skipped, None
    if held:
        yield None, pa.Table.from_batches(held)


def _paired(h, own, c, b, n, threshold: float):
    """Blocks b of each list h, sorted, whose sizes n fit, as pairs: record batches (a, b, few). Where a list is not one chunk's own, only blocks
    of two chunks c make a pair."""
    enough = next(k for k in range(1, 1000) if least_overlap(k, threshold) >= COMMON)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], h[new[1:]] != h[new[:-1]]]))
    b, c, own, low, high = b[new], c[new], own[new], np.minimum.reduceat(n, new), np.maximum.reduceat(n, new)
    size = np.diff(np.concatenate([first, [len(b)]]))
    for k in np.unique(size[size > 1]).tolist():
        lists = first[size == k]
        per = max(1, (1 << 18) // (k * k))
        for at in range(0, len(lists), per):
            places = lists[at : at + per, None] + np.arange(k)
            for x in range(0, k, 256):  # a long list is paired by rows, so memory stays bounded
                i, j = np.triu_indices(k, 1) if k <= 512 else (np.repeat(np.arange(x, min(x + 256, k)), k), np.tile(np.arange(k), min(256, k - x)))
                keep = i < j
                p, q = places[:, i[keep]].ravel(), places[:, j[keep]].ravel()
                fits = (own[p] | (c[p] != c[q])) & (high[p] >= threshold * low[q] - 1e-9) & (high[q] >= threshold * low[p] - 1e-9)
                p, q = p[fits], q[fits]
                few = np.minimum(low[p], low[q]) < enough
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b[p], b[q])), pa.array(np.maximum(b[p], b[q])), pa.array(few)], ["a", "b", "few"])
                if k <= 512:
                    break


def block_pairs(postings: DataFrame, threshold: float) -> DataFrame:
    """(h, block, n) -> (a, b), a < b: the blocks whose prefixes meet in COMMON shingles at sizes that fit, each pair once. One shingle
    will do if a node of either needs no more.

    Postings are dealt by shingle. A list of more than LONG postings is only named there. Such lists, if there are any, are cut into chunks of about LONG
    by a hash of the block, and each two chunks are dealt to a task of their own, so no task pairs more than about 2 * LONG blocks of a shingle.
    """
    pair = "a long, b long, few boolean"

    def short(batches):
        for name, table in _lists(batches):
            if name is None:
                h, b, n = (table.column(k).to_numpy() for k in range(3))
                keys, at, count = np.unique(h, return_index=True, return_counts=True)
                long = keys[count > LONG]
                kept = np.repeat(count <= LONG, count)
                h, b, n = h[kept], b[kept], n[kept]
                if len(h):
                    yield from _paired(h, np.ones(len(h), bool), np.zeros(len(h), np.int32), b, n, threshold)
            else:
                long = np.array([name])
            if len(long):
                yield pa.RecordBatch.from_arrays([pa.array(long, pa.int64()), pa.nulls(len(long), pa.int64()), pa.nulls(len(long), pa.bool_())], ["a", "b", "few"])

    def long(batches):
        for table in _complete_groups(batches, (0, 1, 2)):
            h, u, v, c, b, n = (table.column(k).to_numpy() for k in range(6))
            yield from _paired(_runs(h, u, v), u == v, c, b, n, threshold)

    rows = postings.select("h", "block", "n").repartition("h").sortWithinPartitions("h", "block").mapInArrow(short, pair)
    met = materialize(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max("few").alias("few")), "near-met")
    named = met.where("b is null").select(F.col("a").alias("h"))
    met = met.where("b is not null")
    if not named.isEmpty():
        lists = postings.join(named, "h").groupBy("h", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        lists = materialize(lists, "near-lists")
        parts = lists.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / LONG).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")
        cut = lists.join(parts, "h").withColumns({"c": own, "x": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
        cut = cut.select("h", F.least("c", "x").alias("u"), F.greatest("c", "x").alias("v"), "c", "block", F.explode(F.array("low", "high")).alias("n"))
        more = cut.repartition("h", "u", "v").sortWithinPartitions("h", "u", "v", "block").mapInArrow(long, pair)
        more = more.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max("few").alias("few"))
        met = met.unionByName(more).groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("few").alias("few"))
    return met.where((F.col("k") >= COMMON) | F.col("few")).select("a", "b")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """A number for each run of rows with equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _sides(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of both blocks of each pair, sorted by pair; side 1 for the second block."""
    sides = F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = pairs.select("a", "b", F.explode(sides).alias("side")).withColumn("block", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    return rows.join(members, "block").drop("block").repartition("a", "b").sortWithinPartitions("a", "b", "side", "id")


def _groups(table: pa.Table):
    """(start, first row of side 1, end) of every pair of blocks in a table of complete groups."""
    a, b, side = (table.column(c).to_numpy() for c in ("a", "b", "side"))
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    end = np.concatenate([first[1:], [len(a)]])
    middle = first + np.add.reduceat((side == 0).astype(np.int64), first)
    return first, middle, end, a[first] == b[first]


def prune(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, side, id, sig) -> (a, b, side, id) of the nodes that still have a partner."""

    def run(batches):
        for table in _complete_groups(batches, (0, 1)):
            if not table.num_rows:
                continue
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            keep = np.zeros(table.num_rows, bool)
            first, middle, end, own = _groups(table)
            # pairs of single nodes, all at once
            single = ~own & (middle - first == 1) & (end - middle == 1)
            i, j = first[single], middle[single]
            live = bayes_survivors(sig, sig, i, j, threshold)
            keep[i[live]] = keep[j[live]] = True
            for k in np.flatnonzero(~single).tolist():
                f, m, e = int(first[k]), int(middle[k]), int(end[k])
                for x in range(f, e if own[k] else m, 256):
                    left = np.arange(x, min(x + 256, e if own[k] else m))
                    for y in range(f if own[k] else m, e, 256):
                        right = np.arange(y, min(y + 256, e))
                        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                        if own[k]:
                            i, j = i[i < j], j[i < j]
                        live = bayes_survivors(sig, sig, i, j, threshold)
                        keep[i[live]] = keep[j[live]] = True
            out = table.select(["a", "b", "side", "id"]).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()

    return rows.select("a", "b", "side", "id", "sig").mapInArrow(run, "a long, b long, side int, id string")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the elements that both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    of_a, of_b = np.searchsorted(both, a), np.searchsorted(both, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    in_a = (of_a < len(both)) & (both[np.minimum(of_a, len(both) - 1)] == a) if len(both) else np.zeros(len(a), bool)
    in_b = (of_b < len(both)) & (both[np.minimum(of_b, len(both) - 1)] == b) if len(both) else np.zeros(len(b), bool)
    for at in range(0, len(both), 4096):
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        ka, kb = in_a & (of_a >= at) & (of_a < at + 4096), in_b & (of_b >= at) & (of_b < at + 4096)
        x[row_a[ka], of_a[ka] - at] = 1
        y[row_b[kb], of_b[kb] - at] = 1
        out += x @ y.T
    return out


def _forest(ids: list[str], links: np.ndarray) -> list[str]:
    """For each node the least id of its component; links is a symmetric Boolean matrix."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(links[i, :i]).tolist():
            x, y = find(i), find(j)
            if x != y:
                x, y = (x, y) if ids[x] < ids[y] else (y, x)
                root[y] = x
    return [ids[find(i)] for i in range(len(ids))]


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, side, id, copies, items) -> (id, links, root): links counts partners with their copies."""

    def run(batches):
        for table in _complete_groups(batches, (0, 1)):
            ids, copies = table.column("id").to_pylist(), table.column("copies").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
            out: list[tuple[str, int, str]] = []
            for f, m, e, own in zip(*(x.tolist() for x in _groups(table))):
                if e - f == 2:
                    x, y = sets[f], sets[f + 1]
                    common = len(np.intersect1d(x, y, assume_unique=True)) if (own or m == f + 1) else 0
                    if common and common >= threshold * (len(x) + len(y) - common) - 1e-9:
                        low = min(ids[f], ids[f + 1])
                        out += [(ids[f], int(copies[f + 1]), low), (ids[f + 1], int(copies[f]), low)]
                    continue
                if not own and (m == f or m == e):
                    continue
                left, right = (range(f, e), range(f, e)) if own else (range(f, m), range(m, e))
                common = overlaps([sets[i] for i in left], [sets[j] for j in right])
                size = np.array([len(sets[i]) for i in range(f, e)], np.float64)
                union = size[: len(left), None] + size[len(size) - len(right) :][None, :] - common
                close = (common > 0) & (common >= threshold * union - 1e-9)
                links = np.zeros((e - f, e - f), bool)
                if own:
                    links = close & ~np.eye(e - f, dtype=bool)
                else:
                    links[: m - f, m - f :] = close
                    links |= links.T
                count = links @ copies[f:e]
                roots = _forest(ids[f:e], links)
                out += [(ids[f + i], int(count[i]), roots[i]) for i in np.flatnonzero(count).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["id", "links", "root"]
            )

    return rows.select("a", "b", "side", "id", "copies", "items").mapInArrow(run, "id string, links long, root string")


def classes_by_text(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """near_classes() with the hash of each text: doc_id, id, class_id, n_links."""
    rows = features(docs, n, threshold)
    nodes = rows.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("least").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "near-nodes")
    # what only leads to the links is deleted once these are written
    with scope(docs.sparkSession) as made:
        # nodes of one key are split into blocks; only keys with too many need to be looked up
        large = nodes.where("n > 0").groupBy("least").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
        large = materialize(large.select("least", F.ceil(F.col("k") / BLOCK).alias("parts")), "near-large")
        block = F.xxhash64("least", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).alias("block")
        members = nodes.where("n > 0").join(large, "least", "left").select(block, "id", "sig")
        postings = rows.where("n > 0").select("id", "least", "prefix", F.col("n").cast("int").alias("n")).join(large, "least", "left").select(F.explode("prefix").alias("h"), block, "n")
        own = members.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
        pairs = block_pairs(postings, threshold).unionByName(own)
        live = materialize(prune(_sides(pairs, members), threshold), "near-live")
        wanted = live.select("id").distinct().join(nodes.select("id", "rep", "copies"), "id")

        def collect_sets(batches):
            for batch in slices(batches, 2, 1000):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(shingle_sets(batch.column(2), n))], ["id", "copies", "items"])

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of().cast("binary")).alias("__id"), text_of().alias("__text"))
        sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("__id") == F.col("id"))).select("id", "copies", F.col("__text").alias("text"))
        sets = sets.mapInArrow(collect_sets, "id string, copies long, items binary").dropDuplicates(["id"])
        checked = live.join(sets, "id").repartition("a", "b").sortWithinPartitions("a", "b", "side", "id")
        found = materialize(verify(checked, threshold), "near-found")
        keep_last(made)
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = nodes.select("id", "rep", "copies").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("id", "rep", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = classes.join(least, "root").select("id", "class_id", "n_links")
    return rows.select("doc_id", "id").join(classes, "id").select("doc_id", "id", "class_id", "n_links")


def near_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its component), n_links (documents that are similar to it).

    Words are runs of anything but ASCII white space, case kept; a text of fewer than n words is one shingle. Equal texts are
    similar, also when they have no words; otherwise a text without words is similar to nothing. Null counts as empty. Repeated rows are
    copies of each other. A null doc_id is never a class_id unless all of its class are null. Two texts count as equal if their
    128-bit hashes are; shingles are 64-bit hashes. An empty table gives an empty result; other columns are ignored.
    """
    return classes_by_text(docs, n, threshold).drop("id")


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, one of each class: the one whose doc_id is the class_id. If rows repeat that doc_id in one class, all
    of them stay; exact deduplication comes first."""
    with scope(docs.sparkSession) as made:
        classes = classes_by_text(docs, n, threshold)
        gone = classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id"), F.col("id").alias("__hash")).distinct()
        # all else is deleted before the documents are shuffled
        gone = materialize(gone, "near-gone")
        keep_last(made)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.md5(text_of().cast("binary")) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")


#: near_classes() of `documents` with the defaults, as DuckDB SQL: all pairs that share a shingle, by exact counts. Ids are unique there.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM d),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD}::DOUBLE * (x.n + y.n - c) - 1e-9 UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.t = y.t AND x.doc_id < y.doc_id),
bo AS MATERIALIZED (SELECT a AS u, b AS v FROM lk UNION ALL SELECT b, a FROM lk),
rc(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.v, r.root FROM rc r JOIN bo b ON b.u = r.node AND r.root < b.v)
SELECT doc_id, (SELECT min(root) FROM rc WHERE node = doc_id) AS class_id, (SELECT count(*) FROM bo WHERE u = doc_id) AS n_links FROM d
"""
