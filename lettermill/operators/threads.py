"""Threads of messages by their references, as joins.

Each message claims its last reference as its parent; each reference claims the one before it for its child, the
earliest claim first, where the child is no message or claims nothing itself. Roots, depths and the nearest message
above come together by pointer doubling: the number of joins is the logarithm of the depth, a round takes only the
nodes that have not arrived, and no thread is ever collected in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import forget, materialise

#: Doublings of pointers; enough for chains of 2 ** 40 messages.
MOST_ROUNDS = 40


def _parents(messages: DataFrame, id_: str, refs: str, order: str) -> DataFrame:
    """node, parent (null for roots), is_message: of all ids that are messages or are referred to."""
    own = messages.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("node")).agg(F.min(F.struct(F.col(order).alias("o"), F.filter(F.coalesce(refs, F.array().cast("array<string>")), lambda r: r.isNotNull()).alias("refs"))).alias("m"))
    own = own.select("node", F.col("m.o").alias("o"), F.array_remove(F.col("m.refs"), F.col("node")).alias("refs"))
    last = own.select("node", F.try_element_at("refs", F.lit(-1)).alias("parent"), F.lit(0).alias("rank"), "o", F.lit(0).alias("i"), F.lit(True).alias("is_message"))
    pairs = own.where(F.size("refs") > 0).select("o", F.posexplode("refs").alias("i", "child"), "refs")
    chain = pairs.select(F.col("child").alias("node"), F.when(F.col("i") > 0, F.try_element_at("refs", F.col("i"))).alias("parent"), F.lit(1).alias("rank"), "o", "i", F.lit(False).alias("is_message"))
    claims = last.unionByName(chain).where(~F.col("parent").eqNullSafe(F.col("node")))
    best = F.min(F.when(F.col("parent").isNotNull(), F.struct("rank", "o", "i", "parent")))
    return claims.groupBy("node").agg(best["parent"].alias("parent"), F.max("is_message").alias("is_message"))


#: Of a node: its parent, where its pointer has got to, messages on the way (without itself), the nearest of them, the least node on the way.
_STATE = ["node", "parent", "is_message", "up", "above", "near", "low", "arrived"]


def _start(nodes: DataFrame) -> DataFrame:
    """Pointers to the parents; roots have arrived. What lies behind a pointer is counted when it moves on."""
    root = F.col("parent").isNull()
    return nodes.select("node", "parent", "is_message", F.coalesce("parent", "node").alias("up"), F.lit(0).cast("bigint").alias("above"), F.lit(None).cast("string").alias("near"), F.col("node").alias("low"), root.alias("arrived"))


def _moved(open_: DataFrame, all_: DataFrame) -> DataFrame:
    """The pointers of `open_` moved on to where the nodes they point to point. One that points to a root counts it and arrives."""
    there = all_.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("above").alias("_above"), F.col("near").alias("_near"), F.col("low").alias("_low"), F.col("is_message").alias("_message"), F.col("arrived").alias("_arrived"))
    here = F.when(F.col("_message"), F.col("up"))
    return open_.join(there, "up").select(
        "node", "parent", "is_message", F.col("_up").alias("up"), (F.col("above") + F.col("_above") + F.col("_message").cast("bigint")).alias("above"),
        F.coalesce("near", here, "_near").alias("near"), F.least("low", "_low").alias("low"), F.col("_arrived").alias("arrived"),
    )


def _climbed(nodes: DataFrame, name: str) -> DataFrame:
    """The state of each node when its pointer is at its root; loops are cut at their least node, which becomes a root.

    Every round at least the nodes one deeper than those that have arrived arrive; if none does, the rest is in loops or
    below them. After as many doublings as that rest needs, its pointers are at nodes of loops, and at each of these.
    """
    done: list[DataFrame] = []
    open_ = materialise(_start(nodes), name)
    left = _left(open_)
    while left:
        done.append(open_.where("arrived"))
        still = open_.where("not arrived")
        moved = materialise(_moved(still, reduce(DataFrame.unionByName, [*done, still])), name)
        now = _left(moved)
        if now == left:
            forget(moved)
            done.append(_climbed(_cut(still, left, name), name))
            return reduce(DataFrame.unionByName, done)
        open_, left = moved, now
    return reduce(DataFrame.unionByName, [*done, open_])


def _left(state: DataFrame) -> int:
    return state.where("not arrived").count()


def _cut(loops: DataFrame, count: int, name: str) -> DataFrame:
    """node, parent, is_message of nodes in loops and below them, with each loop's least node made a root."""
    nodes = loops.select("node", "parent", "is_message")
    state = materialise(_start(nodes), name)
    for _ in range(min(MOST_ROUNDS, max(1, count.bit_length()))):
        old, state = state, materialise(_moved(state, state), name)
        forget(old)
    inside = state.select(F.col("up").alias("node")).distinct()
    least = state.join(inside, "node", "left_semi").select(F.col("low").alias("node")).distinct().withColumn("_cut", F.lit(True))
    return nodes.join(least, "node", "left").select("node", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"), "is_message")


def build_threads(messages: DataFrame, id_: str = "message_id", refs: str = "refs", order: str = "received_at") -> DataFrame:
    """thread_id (its root), node_id, parent_id, depth, is_dummy of every message and of the dummies that remain.

    Ids that are referred to but have no message are dummies. They vanish: their children go to the nearest message
    above, or become roots; a dummy that is a root stays if it holds two or more. Messages without an id give no row,
    of messages with one id the first by `order` counts. The result does not depend on how rows are partitioned.
    """
    nodes = materialise(_parents(messages, id_, refs, order), "nodes")
    tree = _climbed(nodes, "climbed")
    roots = _dummy_roots(tree)
    real = tree.where("is_message").join(roots, F.col("up") == F.col("root"), "left")
    # Under a dummy that stays, all go one deeper; one that holds a single message gives its place to it.
    kept, single = F.col("tops") >= 2, F.col("tops") == 1
    out = real.select(
        F.when(single, F.col("top")).otherwise(F.col("up")).alias("thread_id"), F.col("node").alias("node_id"),
        F.coalesce("near", F.when(kept, F.col("root"))).alias("parent_id"), (F.col("above") + F.when(kept, 1).otherwise(0)).cast("int").alias("depth"), F.lit(False).alias("is_dummy"),
    )
    dummies = roots.where(kept).select(F.col("root").alias("thread_id"), F.col("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(True).alias("is_dummy"))
    return out.unionByName(dummies)


def _dummy_roots(tree: DataFrame) -> DataFrame:
    """root, tops, top: of each root that is a dummy, how many messages have no message above them, and the least of these."""
    dummies = tree.where(F.col("parent").isNull() & ~F.col("is_message")).select(F.col("node").alias("root"))
    tops = tree.where(F.col("is_message") & F.col("near").isNull() & (F.col("up") != F.col("node"))).groupBy(F.col("up").alias("root")).agg(F.count("*").alias("tops"), F.min("node").alias("top"))
    return tops.join(dummies, "root", "left_semi")


def root_set(threads: DataFrame) -> DataFrame:
    """thread_id, node_id, position of the roots of `build_threads`, in the order of their ids."""
    return threads.where(F.col("depth") == 0).select("thread_id", "node_id", F.sha2("node_id", 256).alias("_h")).drop("_h").orderBy("node_id")


def descendants(threads: DataFrame, ancestor: str = "ancestor_id") -> DataFrame:
    """`ancestor`, node_id, distance: every pair of a node and one below it, by as many joins as the deepest thread has levels."""
    links = threads.where(F.col("parent_id").isNotNull()).select("node_id", "parent_id")
    level = links.select(F.col("parent_id").alias(ancestor), "node_id", F.lit(1).alias("distance"))
    deepest = threads.agg(F.max("depth")).first()[0] or 0
    out = level
    for n in range(2, deepest + 1):
        level = level.join(links.select(F.col("parent_id").alias("_p"), F.col("node_id").alias("_n")), F.col("node_id") == F.col("_p")).select(ancestor, F.col("_n").alias("node_id"), F.lit(n).alias("distance"))
        out = out.unionByName(level)
    return out
