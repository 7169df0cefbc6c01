"""Match tables: (track1, track2, t1, t2, similarity, source). Cleaning, grouping, alignment."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components, spanning_forest

MODES = ("best", "first", "mid", "last")


def match_offset(o1: Column, o2: Column) -> Column:
    """How far apart the matched places lie on the timeline."""
    return (o1 + F.col("t1")) - (o2 + F.col("t2"))


def canonical(df: DataFrame) -> DataFrame:
    """Matches with the smaller (track, time) first."""
    a, b = F.struct(F.col("track1").alias("track"), F.col("t1").alias("t")), F.struct(F.col("track2").alias("track"), F.col("t2").alias("t"))
    return df.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One match of each unordered pair of places and equal similarity: the one oriented with the smaller track first."""
    best = F.min(F.struct("track1", "t1", "track2", "t2", "source"))
    out = canonical(df).groupBy("low", "high", "similarity").agg(best.alias("m"))
    return out.select("m.track1", "m.track2", "m.t1", "m.t2", "similarity", "m.source")


def check_pairs(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Pairs that break the rules: a track matched with itself, or both orientations in one table."""
    pair = F.struct(F.least("track1", "track2"), F.greatest("track1", "track2")).alias("pair")
    both = df.groupBy(pair).agg(F.countDistinct("track1").alias("n"), F.max(F.col("track1") == F.col("track2")).alias("same"))
    return both.where(F.col("same") | (F.col("n") > 1)) if ordered else both.where("same")


def pick(df: DataFrame, mode: str, *keys: str) -> DataFrame:
    """One match per group: best similarity, or first, middle (element n div 2) or last by t1. Ties go by t1, then t2; `last`
    takes the last of its ties."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    order = Window.partitionBy(*keys).orderBy(*([F.desc("similarity")] if mode == "best" else []), "t1", "t2", F.desc("similarity"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    wanted = {"best": F.lit(1), "first": F.lit(1), "mid": F.floor(n / 2) + 1, "last": n}[mode]
    out = df.withColumns({"__rn": F.row_number().over(order), "__want": wanted}).where("__rn = __want")
    return out.drop("__rn", "__want")


def window_filter(df: DataFrame, width: int, mode: str = "best") -> DataFrame:
    """One match per pair and tumbling window of t1. A pair's last match, if it stands exactly on a window's start, is left out,
    as windows are opened only before it."""
    last = F.max("t1").over(Window.partitionBy("track1", "track2"))
    rows = df.withColumns({"__last": last, "__w": F.floor(F.col("t1") / width)}).where(F.col("__w") * width < F.col("__last"))
    return pick(rows.drop("__last"), mode, "track1", "track2", "__w").drop("__w")


def drop_coincident(df: DataFrame) -> DataFrame:
    """Within each pair, by (t1, t2): a match whose t1 or t2 equals that of the last one kept goes.

    What is kept depends on what was kept, so each pair's matches are folded in order.
    """
    items = F.array_sort(F.collect_list(F.struct("t1", "t2", "similarity", "source")))

    def step(kept, m):
        last = F.try_element_at(kept, F.lit(-1))
        clash = F.coalesce((last["t1"] == m["t1"]) | (last["t2"] == m["t2"]), F.lit(False))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(m)))

    empty = F.slice(F.col("m"), 1, 0)
    out = df.groupBy("track1", "track2").agg(items.alias("m")).select("track1", "track2", F.explode(F.aggregate("m", empty, step)).alias("k"))
    return out.select("track1", "track2", "k.t1", "k.t2", "k.similarity", "k.source")


def intervals(df: DataFrame, threshold: int = 10_000_000) -> DataFrame:
    """Runs of a pair's matches whose offset t1 - t2 changes by no more than the threshold from one to the next."""
    order = Window.partitionBy("track1", "track2").orderBy("t1", "t2")
    shift = F.col("t1") - F.col("t2")
    rows = df.withColumn("shift", shift)
    jump = F.when(F.abs(F.col("shift") - F.lag("shift").over(order)) > threshold, 1).otherwise(0)
    rows = rows.withColumn("jump", jump).withColumn("run", F.sum("jump").over(order))
    return rows.groupBy("track1", "track2", "run").agg(
        F.min("t1").alias("from1"), F.max("t1").alias("to1"), F.min("t2").alias("from2"), F.max("t2").alias("to2"), F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("similarity")
    )


def time_warps(df: DataFrame) -> DataFrame:
    """Control points for track2 of each pair: the first match fixes it, every other moves to keep its distance from the first."""
    order = Window.partitionBy("track1", "track2").orderBy("t1", "t2")
    a1, a2 = F.first("t1").over(order), F.first("t2").over(order)
    return df.select("track1", "track2", F.col("t2").alias("from_t"), (a2 + F.col("t1") - a1).alias("to_t"))


def non_monotonic(df: DataFrame) -> DataFrame:
    """Matches whose t2 runs back while t1 runs on."""
    order = Window.partitionBy("track1", "track2").orderBy("t1", "t2")
    return df.withColumn("__p", F.lag("t2").over(order)).where(F.col("t2") < F.col("__p")).drop("__p")


def aligned_offset(df: DataFrame, tracks: DataFrame) -> DataFrame:
    """For each match, the offset that puts track2 in line with track1; locked tracks stay."""
    t = tracks.select("track_id", "offset_ticks", "locked")
    a, b = t.select(*(F.col(c).alias(f"{c}_1") for c in t.columns)), t.select(*(F.col(c).alias(f"{c}_2") for c in t.columns))
    rows = df.join(a, F.col("track1") == F.col("track_id_1")).join(b, F.col("track2") == F.col("track_id_2"))
    moved = F.when(F.col("locked_2"), F.col("offset_ticks_2")).otherwise(F.col("offset_ticks_1") + F.col("t1") - F.col("t2"))
    return rows.select("track1", "track2", "t1", "t2", F.col("offset_ticks_2").alias("offset_before"), moved.alias("offset_after"))


def move_to_start(tracks: DataFrame, start: int = 0) -> DataFrame:
    """All unlocked tracks shifted by one amount, so that the least offset of all becomes `start`."""
    least = tracks.agg(F.min("offset_ticks").alias("__least"))
    moved = F.when(F.col("locked"), F.col("offset_ticks")).otherwise(F.col("offset_ticks") + F.lit(start) - F.col("__least"))
    return tracks.crossJoin(F.broadcast(least)).withColumn("offset_ticks", moved).drop("__least")


def average_similarity(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Mean similarity of each listed pair, 0 for one without matches."""
    own = df.groupBy("track1", "track2").agg(F.avg("similarity").alias("s"))
    return pairs.join(own, ["track1", "track2"], "left").select("track1", "track2", F.coalesce("s", F.lit(0.0)).alias("similarity"))


def track_pairs(tracks: DataFrame) -> DataFrame:
    """All unordered pairs of a track list, which is a project's, so short."""
    a, b = tracks.select(F.col("track_id").alias("track1")), tracks.select(F.col("track_id").alias("track2"))
    return a.join(b, F.col("track1") < F.col("track2"))


def assign(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Matches of each pair in either orientation."""
    key = lambda a, b: (F.least(a, b), F.greatest(a, b))
    low, high = key("track1", "track2")
    m = df.select(low.alias("a"), high.alias("b"), F.struct(*df.columns).alias("m"))
    p = pairs.select(F.col("track1").alias("p1"), F.col("track2").alias("p2"), low.alias("a"), high.alias("b"))
    return p.join(m, ["a", "b"]).select("p1", "p2", "m.*")


def groups(df: DataFrame, mode: str | None = "best", width: int | None = None) -> DataFrame:
    """Pairs of the minimum spanning tree of each connected group of tracks: group_id, track1, track2, weight and the pair's matches: the
    one picked by mode, one a window with a width, or all of them without a mode. Weight is 1 minus mean similarity of what is kept."""
    kept = df if mode is None else pick(df, mode, "track1", "track2") if width is None else window_filter(df, width, mode)
    pairs = kept.groupBy("track1", "track2").agg((1 - F.avg("similarity")).alias("weight"))
    nodes = components(pairs.select(F.col("track1").alias("u"), F.col("track2").alias("v")))
    edges = pairs.join(nodes, F.col("track1") == F.col("node")).select(F.col("root").alias("group_id"), F.col("track1").alias("u"), F.col("track2").alias("v"), "weight")
    tree = spanning_forest(edges).select("group_id", F.col("u").alias("track1"), F.col("v").alias("track2"), "weight")
    return tree.join(kept, ["track1", "track2"])


def tree_order(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """A tree's pairs in the order in which it grows from its least track, the lightest pair first."""
    start = min(min(a, b) for a, b, _ in pairs)
    near: dict[int, list] = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((w, a, b))
        near.setdefault(b, []).append((w, a, b))
    grown, heap, out = {start}, list(near[start]), []
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        new = b if a in grown else a
        if new not in grown:
            grown.add(new)
            out.append((a, b))
            for edge in near[new]:
                heapq.heappush(heap, edge)
    return out


def warped(points: list[tuple[int, int]], t: int) -> int:
    """A time under control points (from, to): linear between two of them, else moved with the nearest."""
    for (a, b), (na, nb) in zip(points, points[1:]):
        if a <= t < na:
            return b + int((t - a) * ((nb - b) / (na - a)))
    a, b = points[0] if t < points[0][0] else points[-1]
    return t + b - a


def walk_tree(pairs: dict[tuple[int, int], list[list[int]]], order: list[tuple[int, int]], offset: dict[int, int], locked: set[int]) -> list[tuple[int, int, int]]:
    """Aligns the tracks of a group, changing offset and the matches [t1, t2]; returns control points (track, from, to).

    The first pair with a locked track leads, that track first; the pairs before it follow in reverse, then the others. Each pair moves the
    side that is not aligned yet to its first match. With more matches that side is warped, and its times in other pairs' matches are translated, once each.
    """
    order = list(order)
    aligned: set[int] = set()
    lead = next((k for k, (a, b) in enumerate(order) if a in locked or b in locked), None)
    if lead is not None:
        a, b = order[lead]
        order = [order[lead], *reversed(order[:lead]), *order[lead + 1 :]]
        aligned.add(b if b in locked else a)
    points, done = [], set()
    for k, (a, b) in enumerate(order):
        rows = pairs[a, b]
        # the second side moves, unless it is aligned already; a leading pair with a locked second side is turned round
        side = 0 if b in aligned else 1
        moved, other = (a, b) if side == 0 else (b, a)
        t, o = rows[0][side], rows[0][1 - side]
        if moved not in locked:
            offset[moved] = offset[other] + o - t
        if len(rows) > 1:
            own = [(t, t)] + [(r[side], t + r[1 - side] - o) for r in rows[1:]]
            points += [(moved, x, y) for x, y in own]
            own.sort()
            for r, (_, y) in zip(rows[1:], [(r[side], t + r[1 - side] - o) for r in rows[1:]]):
                r[side] = y
            if moved not in locked:
                for pair, others in pairs.items():
                    if pair != (a, b) and moved in pair:
                        for n, r in enumerate(others):
                            if (pair, n) not in done:
                                done.add((pair, n))
                                at = pair.index(moved)
                                r[at] = warped(own, r[at])
        aligned.add(moved)
    return points


def align_tracks(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Offsets, time warps and translated matches after walking each group's tree: rows (group_id, kind, track_id, offset_ticks) of kind `track`,
    (group_id, kind, track_id, t1, t2) of kind `warp` (from, to), and (group_id, kind, track_id, track2, t1, t2) of kind `match`.

    A group is a project's tracks, so it is walked in one task.
    """
    t = tracks.select("track_id", "offset_ticks", "locked")
    rows = pairs.select("group_id", "track1", "track2", "weight", "t1", "t2")
    rows = rows.join(t.select(F.col("track_id").alias("track1"), F.col("offset_ticks").alias("o1"), F.col("locked").alias("l1")), "track1")
    rows = rows.join(t.select(F.col("track_id").alias("track2"), F.col("offset_ticks").alias("o2"), F.col("locked").alias("l2")), "track2")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        offset, locked, found, weight = {}, set(), {}, {}
        for r in part.sort_values(["track1", "track2", "t1", "t2"]).itertuples():
            offset[r.track1], offset[r.track2] = r.o1, r.o2
            locked |= {k for k, on in ((r.track1, r.l1), (r.track2, r.l2)) if on}
            found.setdefault((r.track1, r.track2), []).append([r.t1, r.t2])
            weight[r.track1, r.track2] = r.weight
        points = walk_tree(found, tree_order([(a, b, w) for (a, b), w in weight.items()]), offset, locked)
        group = part["group_id"].iloc[0]
        out = [(group, "track", k, o, None, None, None) for k, o in offset.items()] + [(group, "warp", k, None, None, a, b) for k, a, b in points]
        out += [(group, "match", a, None, b, t1, t2) for (a, b), own in found.items() for t1, t2 in own]
        return pd.DataFrame(out, columns=["group_id", "kind", "track_id", "offset_ticks", "track2", "t1", "t2"]).astype({c: "Int64" for c in ("offset_ticks", "track2", "t1", "t2")})

    return rows.groupBy("group_id").applyInPandas(walk, "group_id long, kind string, track_id long, offset_ticks long, track2 long, t1 long, t2 long")


def apply_warps(df: DataFrame, warps: DataFrame) -> DataFrame:
    """Matches with the times of their second track translated by control points (track1, track2, from_t, to_t) of the pair, as they stand after the track is
    warped; matches that are control points themselves go where these lead."""
    to = warps.select(F.col("track1"), F.col("track2"), F.col("from_t").alias("t2"), "to_t").groupBy("track1", "track2", "t2").agg(F.min("to_t").alias("to_t"))
    return df.join(to, ["track1", "track2", "t2"], "left").select(*(F.coalesce("to_t", "t2").alias("t2") if c == "t2" else F.col(c) for c in df.columns))


def best_of(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k most similar matches of each group."""
    order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "t1", "t2")
    return df.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")
