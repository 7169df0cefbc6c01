"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of a source is to be taken target / source size times on average. The whole part is certain; the fractional
parts are rounded by the pivotal method (Deville and Tille 1998; Srinivasan 2001), here with mass counted in
words: two open documents of sizes a and b meet, and a random transfer of words makes one of them integral while
the expected copies of both and their common sum of words stay as they are. Blocks of at most about BLOCK open documents are
rounded in parallel; what is left open, one document a block, meets again a level higher, until each
source has one open document, which is rounded to the nearer side. What a source then lacks or has too much, half a document at most, is
made up for by documents of about that size: one of each source a round is taken once more or once less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 64
#: Rounds in which a source's rest is made up for.
ROUNDS = 3
#: Weights by rank of the source, repeating, and the most copies.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = 20
#: A fraction so near to 0 or 1 counts as integral.
EPSILON = 1e-9


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    bare = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(bare, " "), "")).cast("bigint")


def running(rows: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """rows with `place` (from 1) in an order and, for each value, `<name>_before`: its sum over the rows before. Ranges of rows are ordered in
    parallel, and the sums of whole ranges, one row each, are added; so no task holds all rows."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    every = {"place": F.lit(1), **values}
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"__{k}": F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in every.items()})
    # one row per range
    front = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(*(F.sum(v).alias(f"__sum_{k}") for k, v in every.items()))
    ranges = ranges.select("__range", *(F.coalesce(F.sum(f"__sum_{k}").over(front), F.lit(0)).alias(f"__from_{k}") for k in every))
    out = dealt.join(ranges, "__range")
    names = {k: "place" if k == "place" else f"{k}_before" for k in every}
    return out.select(*rows.columns, *((F.col(f"__from_{k}") + F.col(f"__{k}") + (1 if k == "place" else 0)).alias(n) for k, n in names.items()))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target. Sources rank by code point, null last.

    Capping and sharing out again ends at min(3 * source_size, level * weight) with one level for all; sources sorted by
    size per weight are capped from the front, so the level follows from running sums over one row per source, of which there may be many.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("bigint")).drop("place")
    per_weight = F.col("source_size") / F.col("weight")
    rows = running(ranked, [per_weight.asc(), F.col("source").asc_nulls_last()], size=F.col("source_size"), weight=F.col("weight"))
    total = rows.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rows = rows.crossJoin(F.broadcast(total))
    level = (F.col("all_size") - MOST * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = materialize(rows.withColumns({"own_level": level, "capped": MOST * F.col("source_size") <= level * F.col("weight")}), "mix-levels")
    # the level is that of the first source, in this order, that is not capped
    first = rows.agg(F.min_by("own_level", F.when(~F.col("capped"), F.col("place"))).alias("level"))
    return rows.crossJoin(F.broadcast(first)).select("source", "source_size", F.least(F.lit(float(MOST)) * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))).alias("target"))


def _round_block(items: Column, level: int) -> Column:
    """Fold a block of struct(key, size, p): all but one become integral; array of struct(key, copy), and the open one."""
    empty = F.array().cast("array<struct<key:bigint,copy:int>>")
    zero = F.struct(F.lit(None).cast("bigint").alias("key"), F.lit(0.0).alias("size"), F.lit(0.0).alias("p"), empty.alias("done"))

    def step(s, x):
        ab, bb = s["size"], x["size"].cast("double")
        # words that can move from x to s, and from s to x
        up, down = F.least(ab * (1 - s["p"]), bb * x["p"]), F.least(ab * s["p"], bb * (1 - x["p"]))
        draw = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), s["key"], x["key"]), F.lit(1 << 52)) / float(1 << 52)
        move = F.when(draw * (up + down) < down, up).otherwise(-down)
        return F.transform(F.array(F.struct(s["p"] + move / ab, x["p"] - move / bb)), lambda v: F.struct(v["col1"].alias("p"), v["col2"].alias("q")))[0]

    def settle(s, x):
        def body(v):
            p, q = v["p"], v["q"]
            shut = (p <= EPSILON) | (p >= 1 - EPSILON)
            open_p = F.struct(s["key"].alias("key"), s["size"].alias("size"), p.alias("p"), F.concat(s["done"], F.array(F.struct(x["key"].alias("key"), F.when(q > 0.5, 1).otherwise(0).alias("copy")))).alias("done"))
            open_q = F.struct(x["key"].alias("key"), x["size"].cast("double").alias("size"), q.alias("p"), F.concat(s["done"], F.array(F.struct(s["key"].alias("key"), F.when(p > 0.5, 1).otherwise(0).alias("copy")))).alias("done"))
            return F.when(shut, open_q).otherwise(open_p)

        return F.transform(F.array(step(s, x)), body)[0]

    def fold(s, x):
        first = F.struct(x["key"].alias("key"), x["size"].cast("double").alias("size"), x["p"].alias("p"), s["done"].alias("done"))
        return F.when(s["key"].isNull(), first).otherwise(settle(s, x))

    return F.aggregate(items, zero, fold)


def decide(rows: DataFrame) -> DataFrame:
    """rows(group, key long, size > 0, p in (0, 1)) -> (key, copy 0 or 1). Keys are unique.

    Each level groups open rows of one group into blocks by a hash of the key, so a group with a third of all rows is
    spread over its blocks; the levels are as many as the largest group needs.
    """
    decided, level = None, 0
    while True:
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        last = (sizes.agg(F.max("n")).first()[0] or 0) <= BLOCK
        blocks = F.when(F.col("n") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") / (BLOCK // 2)))
        block = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), F.lit("block"), "key"), blocks)
        # sizes is one row per group; eqNullSafe keeps the null group
        s = sizes.withColumnRenamed("group", "__g")
        dealt = rows.join(s, F.col("group").eqNullSafe(F.col("__g"))).withColumn("block", block)
        order = F.xxhash64(F.lit(SEED), F.lit(level), F.lit("order"), "key")
        items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), order.alias("o"), "key", "size", "p")))
        out = materialize(dealt.groupBy("group", "block").agg(_round_block(items, level).alias("s")).select("group", "s.*"), f"mix-level{level}")
        done = out.select(F.explode("done").alias("d")).select("d.key", "d.copy")
        if last:
            done = done.unionByName(out.select("key", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("copy")))
            return done if decided is None else decided.unionByName(done)
        decided = done if decided is None else decided.unionByName(done)
        open_ = (F.col("p") > EPSILON) & (F.col("p") < 1 - EPSILON)
        decided = decided.unionByName(out.where(~open_).select("key", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("copy")))
        rows = out.where(open_).select("group", "key", F.col("size").cast("bigint").alias("size"), "p")
        level += 1


def make_up(keyed: DataFrame, drawn: DataFrame) -> DataFrame:
    """(key, group, size, p) and (key, copy) -> (key, copy), where each round the document of a group that brings its sum nearest to the
    sum of size * p is turned, if that helps. A round is two aggregates to a row per group; ties go to the least key."""
    d = drawn.withColumnRenamed("key", "__k")
    state = materialize(keyed.join(d, F.col("key") == F.col("__k")).drop("__k"), "mix-drawn")
    for _ in range(ROUNDS):
        rests = state.groupBy("group").agg(F.sum(F.col("size") * (F.col("p") - F.col("copy"))).alias("rest")).withColumnRenamed("group", "__g")
        turned = F.abs(F.col("rest") - F.col("size") * (1 - 2 * F.col("copy")))
        choices = state.join(rests, F.col("group").eqNullSafe(F.col("__g"))).where(turned < F.abs("rest"))
        turns = choices.groupBy("group").agg(F.min(F.struct(turned.alias("left"), "key")).alias("best")).select(F.col("best.key").alias("__k"))
        # one row per group is written, the state is worked out again from it
        state = state.join(materialize(turns, "mix-turns"), F.col("key") == F.col("__k"), "left")
        state = state.withColumn("copy", F.when(F.col("__k").isNull(), F.col("copy")).otherwise(1 - F.col("copy"))).drop("__k")
    return state.select("key", "copy")


def copies(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, size): its rows, source_size, target and copies each row is taken.

    A null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Rows that repeat
    doc_id, source and size are rounded as one document of their joint size, so reruns agree whatever their order. A source
    without words has target 0. An empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"))
    units = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "mix-units")
    aims = materialize(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))), "mix-targets")
    aims = aims.withColumnRenamed("source", "__s")
    units = units.join(aims, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    units = units.withColumns({
        "key": F.xxhash64("doc_id", F.coalesce("source", F.lit("\0null")), "size"),
        "whole": F.floor(rate + EPSILON), "part": F.greatest(F.lit(0.0), rate - F.floor(rate + EPSILON)),
    })
    # a clash of 64-bit keys would join two documents' draws, so units with one key are rounded as one
    keyed = units.where((F.col("size") > 0) & (F.col("part") > EPSILON))
    keyed = keyed.groupBy("key").agg(F.min("source").alias("group"), F.sum(F.col("size") * F.col("n_rows")).alias("size"), F.first("part").alias("p"))
    drawn = make_up(keyed, decide(keyed))
    drawn = drawn.withColumnRenamed("key", "__k")
    out = units.join(drawn, F.col("key") == F.col("__k"), "left")
    times = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "n_rows", "source_size", "target", times.cast("bigint").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. Null and empty texts have size 0 and are not taken; repeated rows keep
    a row each, all taken alike; an empty table gives none; other columns are ignored. Whole texts are counted."""
    out = copies(docs).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))).alias("r")).drop("r")


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each repeated as often as it is taken: 0 to 3 times, all columns kept. Null and empty texts go; a null source is a source
    of its own; rows that repeat doc_id, source and size are taken alike; an empty table stays empty."""
    times = copies(docs).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies").where("copies > 0")
    rows = docs.withColumn("__words", size_of(F.col("text")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    rows = rows.join(times.withColumnRenamed("copies", "__copies"), on)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return rows.select(*docs.columns)
