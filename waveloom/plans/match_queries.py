"""Queries of fingerprint matching, match processing, correlation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import correlation as K
from ..operators import graph as G
from ..operators import index as I
from ..operators import matching as M
from ..scratch import scratch
from ..sources import sinks
from ..streaming import stateful
from .inputs import MATCHES, SIGNAL, TRACKS, hash_lists, hashes, hashes_sql, matches, rounded, signal, table, tracks, words
from .registry import query
from .spectral_queries import BAND, CHROMA, PEAK, _chromaprint_sql, _held, _hk_sql, _wang_sql

N = 8
_H = hashes_sql()
_VERIFY = (
    "vf AS (SELECT track1, i1, track2, i2, sum(bit_count(xor(a.hash, b.hash)))::BIGINT AS bit_errors, count(*) AS n, max(a.hash = 0 OR b.hash = 0) AS zero FROM "
    f"(SELECT *, unnest(range({N})) AS s FROM cd) c JOIN fp a ON a.track_id = track1 AND a.idx = i1 + s JOIN fp b ON b.track_id = track2 AND b.idx = i2 + s GROUP BY track1, i1, track2, i2)"
)
_SIM = f"1 - bit_errors / {N * 32}.0::DOUBLE"


@query(
    f"WITH {_H}, cd AS (SELECT DISTINCT a.track_id AS track1, a.idx AS i1, b.track_id AS track2, b.idx AS i2 FROM fp a JOIN fp b ON a.hash = b.hash AND a.track_id < b.track_id WHERE a.hash <> 0), "
    f"{_VERIFY} SELECT track1, track2, i1, i2, bit_errors, {_SIM} AS similarity FROM vf WHERE n = {N} AND bit_errors / {N * 32}.0::DOUBLE < 0.35 AND NOT zero"
)
def fp_find_all_matches(spark, sf):
    """All matches of 8 shingle hashes between documents."""
    return I.find_all(hash_lists(spark, sf), N, 0.35, n=words(spark, sf))


@query(f"WITH {_H} SELECT hash, count(*) AS n FROM fp GROUP BY hash HAVING count(*) > 1")
def fp_colliding_keys(spark, sf):
    return I.colliding(hashes(spark, sf))


@query(f"WITH {_H} SELECT track_id, idx, hash FROM fp WHERE hash = (SELECT min(hash) FROM fp WHERE hash <> 0)")
def fp_lookup(spark, sf):
    h = hashes(spark, sf)
    return h.join(F.broadcast(h.where("hash <> 0").agg(F.min("hash").alias("hash"))), "hash").select("track_id", "idx", "hash")


@query(f"WITH {_H} SELECT count(*) AS n, count(DISTINCT track_id) AS tracks FROM fp WHERE hash IN (SELECT hash FROM fp GROUP BY hash HAVING count(*) > 1)")
def fp_without_singletons(spark, sf):
    return I.without_singletons(hashes(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track_id").alias("tracks"))


_BENCH = hashes_sql().replace("documents", "benchmark").replace("doc_id", "item_id").replace("dw AS", "bw AS").replace("FROM dw)", "FROM bw)").replace("fp AS (", "qs AS (")


@query(
    f"WITH {_H}, {_BENCH}, n1 AS (SELECT track_id, max(idx) + 1 AS n FROM fp GROUP BY ALL), n2 AS (SELECT track_id, max(idx) + 1 AS n FROM qs GROUP BY ALL), "
    f"pr AS (SELECT a.track_id AS track1, a.idx AS i1, b.track_id AS track2, b.idx AS i2, greatest(0, a.idx + {N} - n1.n, b.idx + {N} - n2.n) AS o FROM fp a JOIN qs b USING (hash) JOIN n1 ON n1.track_id = a.track_id JOIN n2 ON n2.track_id = b.track_id WHERE hash <> 0), "
    "cd AS (SELECT DISTINCT track1, i1 - o AS i1, track2, i2 - o AS i2 FROM pr WHERE i1 - o >= 0 AND i2 - o >= 0), "
    f"{_VERIFY.replace('JOIN fp b', 'JOIN qs b')} SELECT track1, track2, i1, i2, bit_errors, {_SIM} AS similarity FROM vf WHERE n = {N} AND bit_errors / {N * 32}.0::DOUBLE < 0.35"
)
def fp_probe(spark, sf):
    """Benchmark passages as queries against all documents."""
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    w = bench.select(F.col("doc_id").alias("track_id"), F.split("text", " ").alias("w")).where(F.size("w") >= 4)
    q = w.select("track_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("idx", "s"))
    q = q.select("track_id", F.col("idx").cast("long").alias("idx"), F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long").alias("hash"))
    return I.probe(hashes(spark, sf), q, N, 0.35)


@query(f"WITH {_H}, n AS (SELECT track_id, max(idx) AS m FROM fp GROUP BY ALL) SELECT track_id, idx, hash FROM fp JOIN n USING (track_id) WHERE track_id = 3 AND idx >= greatest(0, least(100000, m - 15)) AND idx < greatest(0, least(100000, m - 15)) + 16")
def fp_window(spark, sf):
    return I.fingerprint(hashes(spark, sf), 3, 100000, 16).select("track_id", "idx", "hash")


@query(
    f"WITH {_H}, f2 AS (SELECT track_id, idx // 16 AS idx, hash % 256 AS hash FROM fp), c AS (SELECT track_id, idx, hash, count(*) AS n FROM f2 GROUP BY ALL), fr AS (SELECT DISTINCT track_id, idx FROM f2), "
    "pr AS (SELECT track_id AS track1, idx AS i1, track_id + 1 AS track2, idx AS i2 FROM fr) SELECT track1, i1, track2, i2, coalesce(sum(least(a.n, b.n)), 0)::BIGINT AS common "
    "FROM pr LEFT JOIN (c a JOIN c b ON a.hash = b.hash AND a.idx = b.idx AND b.track_id = a.track_id + 1) ON a.track_id = track1 AND b.track_id = track2 AND a.idx = i1 GROUP BY ALL"
)
def fp_multiset_overlap(spark, sf):
    """Every frame of 16 shingles against the same frame of the next text."""
    h = hashes(spark, sf).select("track_id", F.expr("idx div 16").alias("idx"), (F.col("hash") % 256).alias("hash"))
    pairs = h.select(F.col("track_id").alias("track1"), F.col("idx").alias("i1"), (F.col("track_id") + 1).alias("track2"), F.col("idx").alias("i2")).distinct()
    return I.multiset_overlap(h, pairs)


@query(
    f"WITH {_H}, f4 AS (SELECT track_id, idx // 4 AS idx, hash FROM fp), c AS (SELECT track_id, idx, hash, count(*) AS n FROM f4 GROUP BY ALL), z AS (SELECT track_id, idx, count(*) AS n FROM f4 GROUP BY ALL), "
    "e AS (SELECT track_id, max(idx) + 1 AS n FROM f4 GROUP BY ALL), sd AS (SELECT DISTINCT a.track_id AS track1, a.idx AS i1, b.track_id AS track2, b.idx AS i2 FROM c a JOIN c b ON a.hash = b.hash AND a.track_id < b.track_id), "
    "st AS (SELECT sd.*, unnest(range(0, least(ea.n - i1, eb.n - i2, 30))) AS f FROM sd JOIN e ea ON ea.track_id = track1 JOIN e eb ON eb.track_id = track2), pl AS (SELECT DISTINCT track1, i1 + f AS p1, track2, i2 + f AS p2 FROM st), "
    "cm AS (SELECT track1, p1, track2, p2, sum(least(a.n, b.n)) AS common FROM pl JOIN c a ON a.track_id = track1 AND a.idx = p1 JOIN c b ON b.track_id = track2 AND b.idx = p2 AND b.hash = a.hash GROUP BY ALL), "
    "rw AS (SELECT st.*, coalesce(common, 0) AS common, coalesce(za.n, 0) + coalesce(zb.n, 0) - coalesce(common, 0) AS tried FROM st LEFT JOIN cm ON cm.track1 = st.track1 AND cm.track2 = st.track2 AND p1 = i1 + f AND p2 = i2 + f "
    "LEFT JOIN z za ON za.track_id = st.track1 AND za.idx = i1 + f LEFT JOIN z zb ON zb.track_id = st.track2 AND zb.idx = i2 + f), "
    "sm AS (SELECT *, sum(common) OVER w AS m, sum(tried) OVER w AS t FROM rw WINDOW w AS (PARTITION BY track1, i1, track2, i2 ORDER BY f)), "
    "rt AS (SELECT *, CASE WHEN t > 0 THEN m / t::DOUBLE ELSE 0.0 END AS rate, 0.3::DOUBLE * pow(0.5::DOUBLE, f * 0.25::DOUBLE / 2) AS bar FROM sm), "
    "nd AS (SELECT track1, track2, i1, i2, arg_min(struct_pack(f := f, rate := rate, hit := f > 3 AND rate > bar), f) AS e FROM rt WHERE (f > 3 AND rate > bar) OR rate < bar / 6 GROUP BY ALL) "
    "SELECT track1, track2, i1, i2, e.f AS frames, round(e.rate, 9) AS similarity FROM nd WHERE e.hit"
)
def fp_frame_scan(spark, sf):
    """Sparse matching over frames of 4 shingles."""
    h = hash_lists(spark, sf).withColumn("idx", F.transform(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: (i / 4).cast("long")))
    return I.frame_scan(h, 3, 30, 0.25, n=words(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query("SELECT i::INT AS f, round(0.3::DOUBLE * pow(0.5::DOUBLE, i * 0.25::DOUBLE / 2), 9) AS bar, i + 1 > 3 AS past_gap FROM range(60) r(i)")
def fp_threshold_curve(spark, sf):
    """The accept curve by seconds, and from which frame on a scan may accept."""
    f = F.col("id")
    return spark.range(60).select(f.cast("int").alias("f"), F.round(I.threshold_curve(0.3, 0.5, 2.0, f * 0.25), 9).alias("bar"), (f + 1 > 3).alias("past_gap"))


@query(
    f"WITH {_H}, cd AS (SELECT DISTINCT a.track_id AS track1, a.idx AS i1, b.track_id AS track2, b.idx AS i2 FROM fp a JOIN fp b ON a.hash = b.hash AND a.track_id < b.track_id WHERE a.hash <> 0), "
    f"{_VERIFY} SELECT track1, track2, round_even(i1 * (64 / 5512.0::DOUBLE) * 10000000, 0)::BIGINT AS t1, round_even(i2 * (64 / 5512.0::DOUBLE) * 10000000, 0)::BIGINT AS t2, {_SIM} AS similarity, 'FP-HK02' AS source "
    f"FROM vf WHERE n = {N} AND bit_errors / {N * 32}.0::DOUBLE < 0.1 AND NOT zero"
)
def fp_named_matches(spark, sf):
    """Matches in ticks under the generator's name, with a stricter threshold."""
    return I.matches(I.find_all(hash_lists(spark, sf), N, 0.1, n=words(spark, sf)), "hk", 64 / 5512)


@query(f"WITH {_H}, w AS (SELECT track_id, idx, hash, list(hash) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS h FROM fp), "
    "k AS (SELECT * FROM w WHERE len(h) = 40 AND NOT list_contains(h, 0)), pr AS (SELECT a.track_id AS track1, b.track_id AS track2, a.idx AS i1, b.idx AS i2, "
    "list_sum(list_transform(list_zip(a.h, b.h), lambda x: bit_count(xor(x[1], x[2]))))::BIGINT AS bit_errors FROM k a JOIN k b ON a.hash = b.hash AND a.track_id < b.track_id) "
    "SELECT *, 1 - bit_errors / 1280.0::DOUBLE AS similarity FROM pr WHERE bit_errors / 1280.0::DOUBLE < 0.35")
def fp_find_long_windows(spark, sf):
    """The same with windows of 40 hashes."""
    return I.find_all(hash_lists(spark, sf), 40, 0.35, n=words(spark, sf))


@query(
    f"WITH {MATCHES} SELECT track1, track2, t1, t2, similarity, any_value(source) AS source FROM m GROUP BY track1, track2, t1, t2, similarity"
)
def match_dedupe(spark, sf):
    df = matches(spark, sf)
    mirrored = df.select(F.col("track2").alias("track1"), F.col("track1").alias("track2"), F.col("t2").alias("t1"), F.col("t1").alias("t2"), "similarity", "source")
    return M.drop_duplicates(df.unionByName(mirrored))


_ORDER = {"best": "similarity DESC, t1, t2", "first": "t1, t2, similarity DESC", "mid": "t1, t2, similarity DESC", "last": "t1, t2, similarity DESC"}
_WANT = {"best": "1", "first": "1", "mid": "n // 2 + 1", "last": "n"}
for _mode in M.MODES:
    query(
        f"WITH {MATCHES}, d AS (SELECT DISTINCT * FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY track1, track2 ORDER BY {_ORDER[_mode]}) AS rn, count(*) OVER (PARTITION BY track1, track2) AS n FROM d) "
        f"SELECT track1, track2, t1, t2, similarity, source FROM r WHERE rn = {_WANT[_mode]}",
        f"match_filter_{_mode}",
    )(lambda spark, sf, mode=_mode: M.pick(matches(spark, sf).distinct(), mode, "track1", "track2"))


@query(
    f"WITH {MATCHES}, d AS (SELECT DISTINCT * FROM m), w AS (SELECT *, t1 // 5000000 AS w, max(t1) OVER (PARTITION BY track1, track2) AS mx FROM d), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY track1, track2, w ORDER BY similarity DESC, t1, t2) AS rn FROM w WHERE w * 5000000 < mx) SELECT track1, track2, t1, t2, similarity, source FROM r WHERE rn = 1"
)
def match_window_filter(spark, sf):
    return M.window_filter(matches(spark, sf).distinct(), 5_000_000)


@query(
    f"WITH {MATCHES}, d AS (SELECT DISTINCT * FROM m), j AS (SELECT *, CASE WHEN abs(t1 - t2 - lag(t1 - t2) OVER w) > 10000000 THEN 1 ELSE 0 END AS j FROM d WINDOW w AS (PARTITION BY track1, track2 ORDER BY t1, t2, similarity)), "
    "g AS (SELECT *, sum(j) OVER (PARTITION BY track1, track2 ORDER BY t1, t2 RANGE UNBOUNDED PRECEDING)::BIGINT AS run FROM j) "
    "SELECT track1, track2, run, min(t1) AS from1, max(t1) AS to1, min(t2) AS from2, max(t2) AS to2, count(*) AS n, avg(similarity) AS similarity FROM g GROUP BY ALL"
)
def match_intervals(spark, sf):
    return M.intervals(matches(spark, sf).distinct())


@query(
    f"WITH RECURSIVE {MATCHES}, d AS (SELECT DISTINCT * FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY track1, track2 ORDER BY t1, t2, similarity) AS rn FROM d), "
    "k(track1, track2, rn, l1, l2, kept) AS (SELECT track1, track2, rn, t1, t2, true FROM r WHERE rn = 1 UNION ALL SELECT r.track1, r.track2, r.rn, CASE WHEN r.t1 = l1 OR r.t2 = l2 THEN l1 ELSE r.t1 END, CASE WHEN r.t1 = l1 OR r.t2 = l2 THEN l2 ELSE r.t2 END, NOT (r.t1 = l1 OR r.t2 = l2) "
    "FROM k JOIN r ON r.track1 = k.track1 AND r.track2 = k.track2 AND r.rn = k.rn + 1) SELECT r.track1, r.track2, t1, t2, similarity, source FROM r JOIN k USING (track1, track2, rn) WHERE kept"
)
def match_coincident(spark, sf):
    return M.drop_coincident(matches(spark, sf).distinct())


@query(f"WITH {MATCHES}, d AS (SELECT DISTINCT track1, track2, t1, t2 FROM m) SELECT track1, track2, t2 AS from_t, first(t2) OVER w + t1 - first(t1) OVER w AS to_t FROM d WINDOW w AS (PARTITION BY track1, track2 ORDER BY t1, t2)")
def match_time_warps(spark, sf):
    return M.time_warps(matches(spark, sf).select("track1", "track2", "t1", "t2").distinct())


@query(f"WITH {MATCHES}, d AS (SELECT DISTINCT track1, track2, t1, t2 FROM m), p AS (SELECT *, lag(t2) OVER (PARTITION BY track1, track2 ORDER BY t1, t2) AS p FROM d) SELECT track1, track2, count(*) AS faults FROM p WHERE t2 < p GROUP BY ALL")
def match_validate(spark, sf):
    return M.non_monotonic(matches(spark, sf).select("track1", "track2", "t1", "t2").distinct()).groupBy("track1", "track2").agg(F.count(F.lit(1)).alias("faults"))


@query(
    f"WITH {MATCHES}, {TRACKS} SELECT track1, track2, t1, t2, b.offset_ticks AS offset_before, CASE WHEN b.locked THEN b.offset_ticks ELSE a.offset_ticks + t1 - t2 END AS offset_after "
    "FROM m JOIN tr a ON a.track_id = track1 JOIN tr b ON b.track_id = track2"
)
def match_align(spark, sf):
    return M.aligned_offset(matches(spark, sf), tracks(spark, sf))


@query(f"WITH {TRACKS} SELECT track_id, CASE WHEN locked THEN offset_ticks ELSE offset_ticks + 1000 - (SELECT min(offset_ticks) FROM tr) END AS offset_ticks FROM tr")
def match_move_to_start(spark, sf):
    return M.move_to_start(tracks(spark, sf), 1000).select("track_id", "offset_ticks")


_MATCHED = "mt AS (SELECT track1 AS t FROM m UNION SELECT track2 FROM m)"


def _matched(spark, sf):
    m = matches(spark, sf)
    return m.select(F.col("track1").alias("track_id")).union(m.select("track2")).distinct()


@query(f"WITH {MATCHES}, {_MATCHED} SELECT a.t AS track1, b.t AS track2, coalesce(avg(similarity), 0) AS similarity FROM mt a JOIN mt b ON a.t < b.t LEFT JOIN m ON m.track1 = a.t AND m.track2 = b.t GROUP BY ALL")
def match_average_similarity(spark, sf):
    """Over all pairs of tracks that have matches."""
    return M.average_similarity(M.track_pairs(_matched(spark, sf)), matches(spark, sf))


@query(f"WITH {MATCHES}, {_MATCHED} SELECT b.t AS p1, a.t AS p2, count(*) AS n FROM mt a JOIN mt b ON a.t < b.t JOIN m ON m.track1 = a.t AND m.track2 = b.t GROUP BY ALL")
def match_assign(spark, sf):
    """Pairs given the other way round."""
    pairs = M.track_pairs(_matched(spark, sf)).select(F.col("track2").alias("track1"), F.col("track1").alias("track2"))
    return M.assign(pairs, matches(spark, sf)).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {MATCHES}, x AS (SELECT track1, track2 FROM m UNION ALL SELECT track2, track1 FROM m WHERE t1 % 700000 = 0 UNION ALL SELECT track1, track1 FROM m WHERE t1 = 0) "
    "SELECT least(track1, track2) AS a, greatest(track1, track2) AS b, count(DISTINCT track1) AS n, bool_or(track1 = track2) AS same FROM x GROUP BY 1, 2 HAVING count(DISTINCT track1) > 1 OR bool_or(track1 = track2)"
)
def match_check_pairs(spark, sf):
    """Pairs in both orientations, or of a track with itself."""
    m = matches(spark, sf).select("track1", "track2", "t1")
    turned = m.where("t1 % 700000 = 0").select(F.col("track2").alias("track1"), F.col("track1").alias("track2"), "t1")
    own = m.where("t1 = 0").select("track1", F.col("track1").alias("track2"), "t1")
    return M.check_pairs(m.unionByName(turned).unionByName(own)).select("pair.col1", "pair.col2", "n", "same").toDF("a", "b", "n", "same")


@query(
    f"WITH {MATCHES}, d AS (SELECT DISTINCT * FROM m), w AS (SELECT track1, track2, t2, first(t2) OVER w + t1 - first(t1) OVER w AS to_t FROM d WINDOW w AS (PARTITION BY track1, track2 ORDER BY t1, t2)), "
    "g AS (SELECT track1, track2, t2, min(to_t) AS to_t FROM w GROUP BY ALL) SELECT track1, track2, t1, to_t AS t2, similarity, source FROM d JOIN g USING (track1, track2, t2)"
)
def match_apply_warps(spark, sf):
    """Matches as they stand once their second tracks are warped."""
    m = matches(spark, sf).distinct()
    return M.apply_warps(m, M.time_warps(m))


@query(f"WITH {MATCHES}, {TRACKS} SELECT track_id FROM tr WHERE track_id IN (SELECT track1 FROM m) AND track_id NOT IN (SELECT track2 FROM m WHERE track2 % 3 = 0)")
def match_semi_anti(spark, sf):
    m = matches(spark, sf)
    t = tracks(spark, sf).select("track_id")
    return t.join(m.select(F.col("track1").alias("track_id")), "track_id", "left_semi").join(m.where("track2 % 3 = 0").select(F.col("track2").alias("track_id")), "track_id", "left_anti")


_EDGES = "ed AS (SELECT c_custkey AS u, c_custkey + 20 AS v, (c_custkey % 17) / 17.0::DOUBLE AS weight FROM customer)"


def _edges(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 20).alias("v"), (F.col("c_custkey") % 17 / 17.0).alias("weight"))


@query(
    f"WITH RECURSIVE {_EDGES}, bo AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed), rc(node, root) AS (SELECT u, u FROM bo UNION SELECT b.v, r.root FROM rc r JOIN bo b ON b.u = r.node AND r.root < b.v) SELECT node, min(root) AS root FROM rc GROUP BY node"
)
def graph_components(spark, sf):
    return G.components(_edges(spark, sf))


@query("SELECT c_custkey AS node, c_custkey % 20 = 3 AS near, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_custkey IN (3, 23)) GROUP BY ALL")
def graph_edges_of(spark, sf):
    """Edges of a node, by the other end and by its own; and whether nodes are connected."""
    e = _edges(spark, sf)
    near = G.has_path(e, 3, 23)
    return G.edges_of(e, 23).select(F.col("u").alias("node")).distinct().select("node", F.lit(near).alias("near"), F.lit(1).cast("long").alias("n"))


def _tree_sql(kept: str) -> str:
    """tree (track1, track2, weight, group_id): an edge is in the minimum spanning tree if lighter ones do not connect its ends."""
    return (
        f"{kept}, ed AS (SELECT track1 AS u, track2 AS v, 1 - avg(similarity) AS weight FROM kept GROUP BY ALL), rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight, u, v) AS r FROM ed), "
        "bo AS MATERIALIZED (SELECT u, v, r FROM rk UNION ALL SELECT v, u, r FROM rk), rc(r, node) AS (SELECT r, u FROM rk UNION SELECT c.r, b.v FROM rc c JOIN bo b ON b.u = c.node AND b.r < c.r), "
        "cn(node, root) AS (SELECT u, u FROM bo UNION SELECT b.v, c.root FROM cn c JOIN bo b ON b.u = c.node AND c.root < b.v), gr AS MATERIALIZED (SELECT node, min(root) AS root FROM cn GROUP BY node), "
        "tree AS MATERIALIZED (SELECT u AS track1, v AS track2, weight, root AS group_id FROM rk JOIN gr ON node = u WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.r = rk.r AND rc.node = rk.v))"
    )


_BEST = f"{MATCHES}, kept AS MATERIALIZED (SELECT track1, track2, t1, t2, similarity, source FROM (SELECT *, row_number() OVER (PARTITION BY track1, track2 ORDER BY similarity DESC, t1, t2) AS rn FROM (SELECT DISTINCT * FROM m)) WHERE rn = 1)"


@query(f"WITH RECURSIVE {_tree_sql(_BEST)} SELECT track1, track2, group_id, round(weight, 9) AS weight, t1, t2, similarity, source FROM tree JOIN kept USING (track1, track2)")
def match_groups(spark, sf):
    return M.groups(matches(spark, sf).distinct()).withColumn("weight", F.round("weight", 9))


@query(f"WITH RECURSIVE {_tree_sql(f'{MATCHES}, kept AS MATERIALIZED (SELECT DISTINCT * FROM m)')} SELECT track1, track2, group_id, round(weight, 9) AS weight, t1, t2, similarity, source FROM tree JOIN kept USING (track1, track2)")
def match_groups_all(spark, sf):
    """Groups with all matches of their pairs."""
    return M.groups(matches(spark, sf).distinct(), None).withColumn("weight", F.round("weight", 9))


@query(
    f"WITH RECURSIVE {TRACKS}, {_tree_sql(_BEST)}, sh AS (SELECT track1 AS a, track2 AS b, t1 - t2 AS s FROM tree JOIN kept USING (track1, track2) UNION ALL SELECT track2, track1, t2 - t1 FROM tree JOIN kept USING (track1, track2)), "
    "wk(node, off, grp) AS (SELECT track_id, offset_ticks, group_id FROM tr JOIN (SELECT DISTINCT group_id FROM tree) ON track_id = group_id UNION SELECT b, off + s, grp FROM wk JOIN sh ON a = node) "
    "SELECT grp AS group_id, node AS track_id, off AS offset_ticks FROM wk"
)
def match_align_tracks(spark, sf):
    """Offsets of the tracks of each group, none of them locked; one match a pair, so nothing is warped."""
    t = tracks(spark, sf).withColumn("locked", F.lit(False))
    found = M.align_tracks(M.groups(matches(spark, sf).distinct()), t)
    return found.where("kind = 'track'").select("group_id", "track_id", "offset_ticks")


@query()
def match_align_warped(spark, sf):
    """The same with windows of matches, locked tracks, and warps."""
    t = tracks(spark, sf)
    return M.align_tracks(M.groups(matches(spark, sf).distinct(), "best", 10_000_000), t)


_STEP = f"{SIGNAL}, pr AS (SELECT a.track_id AS track1, b.track_id AS track2, a.idx, a.value AS x, b.value AS y FROM sig a JOIN sig b ON a.idx = b.idx AND a.track_id < b.track_id)"


@query(f"WITH {_STEP} SELECT track1, track2, round(coalesce(corr(x, y), 0), 6) + 0.0 AS r FROM pr GROUP BY ALL")
def corr_pearson(spark, sf):
    return K.score_all(signal(spark, sf), "correlation").select("track1", "track2", rounded(F.col("value")).alias("r"))


@query(f"WITH {_STEP}, c AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM pr WINDOW w AS (PARTITION BY track1, track2)) SELECT track1, track2, round(1 - avg(abs((x - mx) - (y - my))) + 1e-11::DOUBLE, 9) + 0.0 AS score FROM c GROUP BY ALL")
def corr_interference(spark, sf):
    return K.score_all(signal(spark, sf), "interference").select("track1", "track2", rounded(F.col("value") + 1e-11, 9).alias("score"))  # sums of decimals stand on ties; a little more decides them


def _lag_inputs(spark, sf):
    df = signal(spark, sf)
    a = df.select(F.col("track_id").alias("pair_id"), "idx", "value")
    b = df.where("track_id > 0").select((F.col("track_id") - 1).alias("pair_id"), "idx", "value")
    return a, b


# lags up to half of 256 cover all of every track
_XC = (
    f"{SIGNAL}, ca AS (SELECT track_id AS p, idx, value - avg(value) OVER (PARTITION BY track_id) AS x FROM sig), cb AS (SELECT track_id - 1 AS p, idx, value - avg(value) OVER (PARTITION BY track_id) AS y FROM sig), "
    "sa AS (SELECT p, sum(x * x) AS sx FROM ca GROUP BY p), sb AS (SELECT p, sum(y * y) AS sy FROM cb GROUP BY p), pl AS (SELECT p, l, sqrt(sx * sy) AS low FROM sa JOIN sb USING (p), range(-128, 128) r(l)), "
    "sm AS (SELECT ca.p, cb.idx - ca.idx AS l, sum(x * y) AS s FROM ca JOIN cb ON cb.p = ca.p GROUP BY ALL), xc AS (SELECT p AS pair_id, l AS lag, coalesce(s, 0) / low AS r FROM pl LEFT JOIN sm USING (p, l))"
)


@query(f"WITH {_XC} SELECT pair_id, lag::INT AS lag, round(r, 6) + 0.0 AS r FROM xc")
def corr_cross(spark, sf):
    a, b = _lag_inputs(spark, sf)
    return K.cross_correlation(a, b, 256).select("pair_id", "lag", rounded(F.col("r")).alias("r"))


@query(f"WITH {_XC}, b AS (SELECT pair_id, arg_max(lag, abs(r)) AS lag, max(abs(r)) AS r FROM xc GROUP BY ALL) SELECT pair_id, lag::INT AS lag, round((1 - abs(lag) / 128.0::DOUBLE) * r, 6) + 0.0 AS score FROM b")
def corr_best_lag(spark, sf):
    a, b = _lag_inputs(spark, sf)
    return K.best_lag(K.cross_correlation(a, b, 256)).select("pair_id", "lag", rounded(K.lag_score(F.col("lag"), F.col("r"), 256)).alias("score"))


@query(
    f"WITH {SIGNAL} SELECT track_id, count(*) FILTER (value > 50) AS n_positive, count(*) FILTER (value <= 50) AS n_other, round(coalesce(sum(value - 50) FILTER (value > 50), 0), 4) + 0.0 AS sum_positive, round(coalesce(sum(value - 50) FILTER (value <= 50), 0), 4) + 0.0 AS sum_other, "
    "round(least(0.0, min(value - 50)), 6) + 0.0 AS low, round(greatest(0.0, max(value - 50)), 6) + 0.0 AS high, round(sum(abs(value - 50)) / count(*), 6) + 0.0 AS score FROM sig GROUP BY ALL"
)
def corr_analysis(spark, sf):
    df = K.analysis_summary(signal(spark, sf).withColumn("value", F.col("value") - 50), "track_id")
    return df.select("track_id", "n_positive", "n_other", *(rounded(F.col(c), 4).alias(c) for c in ("sum_positive", "sum_other")), *(rounded(F.col(c)).alias(c) for c in ("low", "high", "score")))


@query(f"WITH {_STEP} SELECT track1, track2, idx // 16 AS \"interval\", round(coalesce(CASE WHEN isnan(corr(x, y)) THEN NULL ELSE corr(x, y) END, 0), 6) + 0.0 AS value FROM pr GROUP BY ALL")
def corr_analyse(spark, sf):
    df = K.analyse(signal(spark, sf), "correlation", 16)
    return df.select("track1", "track2", F.col("interval").cast("long").alias("interval"), rounded(F.col("value")).alias("value"))


# neighbours, in intervals that both have in full
_NEXT = "nb AS (SELECT a.track_id AS track1, b.track_id AS track2, a.idx // {0} AS k, a.idx % {0} AS i, a.value AS x, b.value AS y FROM sig a JOIN sig b ON b.track_id = a.track_id + 1 AND b.idx = a.idx), fl AS (SELECT * FROM nb QUALIFY count(*) OVER (PARTITION BY track1, k) = {0})"


def _neighbours(spark, sf):
    t = signal(spark, sf).select("track_id").distinct()
    return t.select(F.col("track_id").alias("track1"), (F.col("track_id") + 1).alias("track2"))


@query(
    f"WITH {SIGNAL}, {_NEXT.format(16)}, ce AS (SELECT track1, track2, k, i, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM fl WINDOW w AS (PARTITION BY track1, k)), sq AS (SELECT track1, track2, k, sqrt(sum(x * x) * sum(y * y)) AS low FROM ce GROUP BY ALL), "
    "sm AS (SELECT a.track1, a.k, b.i - a.i AS lag, sum(a.x * b.y) AS s FROM ce a JOIN ce b ON b.track1 = a.track1 AND b.k = a.k AND b.i - a.i BETWEEN -8 AND 7 GROUP BY ALL), "
    'bs AS (SELECT track1, k, arg_max(lag, abs(s)) AS lag, max(abs(s)) AS s FROM sm GROUP BY ALL) SELECT track1, track2, k AS "interval", round((1 - abs(lag) / 8.0::DOUBLE) * s / low, 6) + 0.0 AS value FROM bs JOIN sq USING (track1, k)'
)
def corr_analyse_lag(spark, sf):
    df = K.analyse(signal(spark, sf), "lag", 16, _neighbours(spark, sf))
    return df.select("track1", "track2", "interval", rounded(F.col("value")).alias("value"))


def _spectrum_sql(side: str) -> str:
    return (
        f"h{side} AS (SELECT track1, track2, list_transform(list_zip(list({side} ORDER BY i), [0.5 - 0.5 * cos(2 * pi() * j / 63) for j in range(64)]), lambda z: z[1] * z[2]) AS v FROM fl GROUP BY track1, track2, k), "
        f"m{side} AS (SELECT track1, track2, b, sqrt(list_dot_product(v, [cos(2 * pi() * b * j / 64) for j in range(64)]) ** 2 + list_dot_product(v, [sin(2 * pi() * b * j / 64) for j in range(64)]) ** 2) AS m FROM h{side}, range(1, 32) r(b)), "
        f"n{side} AS (SELECT *, m / sum(m) OVER (PARTITION BY track1) AS p FROM m{side})"
    )


@query(f"WITH {SIGNAL}, {_NEXT.format(64)}, {_spectrum_sql('x')}, {_spectrum_sql('y')} SELECT track1, x.track2, 0::BIGINT AS \"interval\", round(1 - sum(abs(x.p - y.p)) / 2, 6) + 0.0 AS value FROM nx x JOIN ny y USING (track1, b) GROUP BY ALL")
def corr_frequency(spark, sf):
    """Likeness of spectra of neighbours; tracks of 64 samples or more have one interval each."""
    df = K.analyse(signal(spark, sf), "frequency", 64, _neighbours(spark, sf))
    return df.select("track1", "track2", "interval", rounded(F.col("value")).alias("value"))


@query(
    f"WITH {SIGNAL}, {MATCHES}, d AS (SELECT DISTINCT track1, track2, t1, t2, round_even(t1 / 1000000.0, 0)::BIGINT AS i1, round_even(t2 / 1000000.0, 0)::BIGINT AS i2 FROM m), z AS (SELECT track_id, max(idx) + 1 AS n FROM sig GROUP BY ALL), "
    "s AS (SELECT track1, track2, t1, t2, i1 - o AS b1, i2 - o AS b2 FROM (SELECT d.*, greatest(0, i1 + 20 - a.n, i2 + 20 - b.n) AS o FROM d JOIN z a ON a.track_id = track1 JOIN z b ON b.track_id = track2) WHERE i1 - o >= 0 AND i2 - o >= 0), "
    "w AS (SELECT s.*, a.idx - b1 AS i, a.value - avg(a.value) OVER p AS x, b.value - avg(b.value) OVER p AS y FROM s JOIN sig a ON a.track_id = track1 AND a.idx >= b1 AND a.idx < b1 + 20 JOIN sig b ON b.track_id = track2 AND b.idx = b2 + a.idx - b1 WINDOW p AS (PARTITION BY track1, track2, t1, t2)), "
    "q AS (SELECT track1, track2, t1, t2, sqrt(sum(x * x) * sum(y * y)) AS low FROM w GROUP BY ALL), sm AS (SELECT a.track1, a.track2, a.t1, a.t2, b.i - a.i AS lag, sum(a.x * b.y) AS s FROM w a JOIN w b ON b.track1 = a.track1 AND b.track2 = a.track2 AND b.t1 = a.t1 AND b.t2 = a.t2 AND b.i - a.i BETWEEN -10 AND 9 GROUP BY ALL), "
    "bs AS (SELECT track1, track2, t1, t2, arg_max(lag, abs(s)) AS lag, max(abs(s)) AS s FROM sm GROUP BY ALL) SELECT track1, track2, t1, t2 + lag * 1000000 AS t2, round(s / low, 6) AS similarity, 'CC' AS source FROM bs JOIN q USING (track1, track2, t1, t2)"
)
def corr_adjust(spark, sf):
    m = matches(spark, sf).select("track1", "track2", "t1", "t2").distinct()
    return K.adjust(m, signal(spark, sf), 10, 2.0).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {TRACKS}, {MATCHES} SELECT a.name AS name1, t1 AS time1, t1 // 10000 AS time1_ms, b.name AS name2, t2 AS time2, t2 // 10000 AS time2_ms, t1 - t2 AS shift, (t1 - t2) // 10000 AS shift_ms, similarity, source FROM m JOIN tr a ON a.track_id = track1 JOIN tr b ON b.track_id = track2")
def sink_matches(spark, sf):
    return sinks.match_rows(matches(spark, sf), tracks(spark, sf))


_FRAMING = (
    f"{SIGNAL}, n AS (SELECT track_id, count(*) AS n FROM sig GROUP BY ALL), fx AS (SELECT track_id, unnest(range(0, (n - 16) // 8 + 1)) AS frame_idx FROM n WHERE n >= 16), "
    "fs AS (SELECT f.track_id, f.frame_idx, s.idx - f.frame_idx * 8 AS i, s.value FROM fx f JOIN sig s ON s.track_id = f.track_id AND s.idx >= f.frame_idx * 8 AND s.idx < f.frame_idx * 8 + 16)"
)


def _streamed(spark, df, step, schema, mode="append"):
    """Two parts of a signal as files, one read after the other by a stream; what it puts out."""
    base = scratch(spark, "stream")
    df.where("idx < 30").write.parquet(f"{base}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")

    def go():
        write = step(source).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        run = write.format("parquet").option("path", f"{base}/out").start() if mode == "append" else write.foreachBatch(lambda x, k: x.write.mode("append").parquet(f"{base}/out")).start()
        run.awaitTermination()

    go()
    df.where("idx >= 30").write.mode("append").parquet(f"{base}/in")
    go()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query(f"WITH {_FRAMING} SELECT track_id, frame_idx, i::INT AS i, value FROM fs")
def stream_hop_frames(spark, sf):
    """Frames of a stream of samples, in two runs of a query that goes on from its state."""
    out = _streamed(spark, signal(spark, sf), lambda s: stateful.hop_frames(s, 16, 8), "track_id long, frame_idx long, values array<double>, n_late long")
    return out.select("track_id", "frame_idx", F.posexplode("values").alias("i", "value"))


@query(f"WITH {SIGNAL}, b AS (SELECT track_id, max(idx) AS last FROM sig GROUP BY ALL UNION ALL SELECT track_id, 29 FROM sig GROUP BY ALL) SELECT track_id, last::BIGINT AS last, (idx - last + 7)::INT AS i, value FROM b JOIN sig USING (track_id) WHERE idx > last - 8 AND idx <= last")
def stream_ring(spark, sf):
    """The last 8 samples of each track after each part of a stream."""
    out = _streamed(spark, signal(spark, sf), lambda s: stateful.ring(s, 8), "track_id long, last long, values array<double>", "update")
    return out.select("track_id", "last", F.posexplode("values").alias("i", "value"))


@query(
    f"WITH {SIGNAL}, n AS (SELECT track_id, count(*) AS n FROM sig GROUP BY ALL), r AS (SELECT track_id, 10 AS first, 10 AS lost FROM n UNION ALL SELECT track_id, greatest(18, n - 20), 10 + greatest(0, n - 38) FROM n) "
    "SELECT r.track_id, (idx - first)::INT AS i, value, lost::BIGINT AS lost FROM r JOIN sig ON sig.track_id = r.track_id AND idx >= first AND idx < first + 8"
)
def stream_lossy(spark, sf):
    """A slow reader of 8 samples after each part of a stream, behind a buffer of 20."""
    out = _streamed(spark, signal(spark, sf), lambda s: stateful.lossy(s, 20, 8), "track_id long, first long, values array<double>, lost long")
    return out.select("track_id", "lost", F.posexplode("values").alias("i", "value"))


@query(f"WITH {SIGNAL}, d AS (SELECT track_id, idx, value FROM sig UNION ALL SELECT track_id, idx, value + 1 FROM sig WHERE idx >= 25 AND idx < 30) SELECT track_id, idx, value, (SELECT count(*) FROM sig s WHERE s.track_id = sig.track_id AND s.idx >= 25 AND s.idx < 30) AS n_late FROM sig WHERE idx >= 30")
def stream_late_rows(spark, sf):
    """Rows that come again behind later ones are dropped, and counted."""
    df = signal(spark, sf)
    first = df.where("idx < 30")
    again = df.where("idx >= 25 and idx < 30").select("track_id", (F.col("idx") + 0).alias("idx"), (F.col("value") + 1).alias("value"))
    base = scratch(spark, "late")
    for part in (first, df.where("idx >= 30").unionByName(again)):
        # all files of a part are one micro-batch, however many tasks write them
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        run = stateful.hop_frames(source, 1, 1).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.schema("track_id long, frame_idx long, values array<double>, n_late long").parquet(f"{base}/out")
    return out.where("frame_idx >= 30").select("track_id", F.col("frame_idx").alias("idx"), F.col("values")[0].alias("value"), "n_late")


def _live(name, sql, step):
    def run(spark, sf):
        held = _held()
        base = scratch(spark, "live")
        for low, high in ((0, 3000), (3000, None)):
            part = stateful.runs(signal(spark, sf), held.times, low, high)
            part.write.mode("append").parquet(f"{base}/in")
            source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")
            out = step(source, held.change).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            out.awaitTermination()
        return spark.read.schema("track_id long, idx long, hash long").parquet(f"{base}/out")

    run.__doc__ = "Hashes of a stream of samples in two parts: those of the whole signal. Samples that are held are sent as runs."
    query(sql, name)(run)


_live("stream_live_hashes", f"SELECT track_id, idx, hash FROM ({_hk_sql()}) WHERE NOT is_variation", lambda s, change: stateful.live_hashes(s, BAND, change))
_live("stream_live_chromaprint", f"SELECT track_id, idx, hash FROM ({_chromaprint_sql()})", lambda s, change: stateful.live_chromaprint(s, CHROMA, change))
# frames whose zone has not come in full have no hashes yet
_live(
    "stream_live_wang", f"WITH z AS ({_wang_sql()}), n AS (SELECT user_id AS track_id, (count(*) * 128 - {PEAK.size}) // {PEAK.hop} + 1 AS n FROM events GROUP BY ALL) SELECT track_id, idx, hash FROM z JOIN n USING (track_id) WHERE idx < n - {PEAK.distance + PEAK.length - 1}",
    lambda s, change: stateful.live_wang(s, PEAK, change),
)
