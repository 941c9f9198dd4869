"""Full hierarchies from parent-child links of unknown depth.

Nodes without children (most of them) take no part in any loop: their place follows
from their parent's in one join at the end. The loops run over nodes with children.

1. Upward: with S_k(v) the children of all nodes less than 2^k steps below v, every
   node hands S_k to its ancestor 2^k steps up, and S_(k+1) is what a node had plus
   what it got. Ancestors 2^k steps up double as well, so the sizes of all subtrees
   take log2(depth) rounds. A round moves only nodes that still have such an ancestor.
2. Depths are contiguous, so if no node runs out of ancestors in a round, all that are
   left are on a cycle or lead into one. Their pointers name exactly the cycles' nodes
   as soon as a further round names no fewer nodes. Each of these learns the smallest
   id of its cycle by pointer doubling.
3. Downward: sibling ranges are prefix sums of subtree sizes, taken per parent in hash
   buckets first and over the buckets second, so that no window holds all children of
   a hot parent; nodes with children come before those without. The offsets are then
   summed along the ancestors by pointer doubling.
4. Paths are read off the nested-set ranges: nodes sorted by their position are swept
   once, with the ranges still open as the path. A tree's positions are cut into blocks
   of fixed length, and a range that spans a block's start is sent there as well, so
   that no task needs a whole tree.

Every node v of a tree with head r owns the preorder range [lft, rgt] in r's
numbering; u descends from v exactly if both have the same tree_id and
v.lft < u.lft <= v.rgt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quarrylens.session import discard, written

#: Hash buckets into which the children of one parent are split for prefix sums.
SIBLING_BUCKETS = 256
#: Positions of a tree that one sweep covers.
BLOCK = 65_536


def _nodes(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """id, parent, n_kids (null without children) of every node."""
    base = (
        nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
        .filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("parent").alias("parent"))
    )
    kids = base.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_kids"))
    return written(base.join(kids, "id", "left"))


def _inner(nodes: DataFrame) -> DataFrame:
    """id, parent (null if it is no node), n_kids, n_inner (children with children) of the nodes with children."""
    inner = nodes.filter(F.col("n_kids").isNotNull())
    known = inner.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    linked = inner.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), "n_kids")
    counts = linked.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_inner"))
    return written(linked.join(counts, "id", "left").withColumn("n_inner", F.coalesce("n_inner", F.lit(0))))


def _subtree_sizes(inner: DataFrame) -> DataFrame:
    """id, parent, n_kids, n_inner, size (of the subtree without links along a cycle), on_cycle."""
    active = written(inner.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("ptr"), F.col("n_kids").alias("below")))
    rounds, count, named = [active], active.count(), -1
    while count:
        got = active.groupBy(F.col("ptr").alias("id")).agg(F.sum("below").alias("gain"))
        ahead = active.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        active = written(active.join(ahead, "ptr").join(got, "id", "left").select(
            "id", F.col("ptr2").alias("ptr"), (F.col("below") + F.coalesce("gain", F.lit(0))).alias("below")))
        left = active.count()
        if left:
            rounds.append(active)
        if left == count:
            now = active.select("ptr").distinct().count()
            if now == named:
                break
            named = now
        count = left
    total = reduce(DataFrame.unionByName, rounds).groupBy(F.col("ptr").alias("id")).agg(F.sum("below").alias("below"))
    sizes = inner.join(total, "id", "left").withColumn("size", F.coalesce("below", F.lit(0)) + F.col("n_kids") + 1).drop("below")
    if not count:
        sizes = written(sizes.withColumn("on_cycle", F.lit(False)))
    else:
        looped = active.select(F.col("ptr").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
        marked = written(sizes.join(looped, "id", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False))))
        # a node on a cycle heads the trees that lead into it; one of its children is on the cycle
        cyclic = marked.filter("on_cycle").select(F.col("id").alias("parent"))
        behind = marked.filter("NOT on_cycle").join(cyclic, "parent").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("size") - 1).alias("behind"))
        sizes = written(marked.join(behind, "id", "left").withColumn(
            "size", F.when(F.col("on_cycle"), F.coalesce("behind", F.lit(0)) + F.col("n_kids")).otherwise(F.col("size"))).drop("behind"))
        rounds += [active, marked]
    discard(*rounds, inner)
    return sizes


def _cycle_labels(on_cycle: DataFrame) -> DataFrame:
    """id, cycle_id (smallest id on the node's cycle) by pointer doubling."""
    state = written(on_cycle.select("id", F.col("parent").alias("ptr"), F.col("id").alias("low")))
    if state.isEmpty():
        return state.select("id", F.col("low").alias("cycle_id"))
    while True:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        stepped = written(state.join(ahead, "ptr").select(
            "id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        discard(state)
        state = stepped
        if stepped.filter("changed").isEmpty():
            return state.select("id", F.col("low").alias("cycle_id"))


def _earlier_siblings(rows: DataFrame, size: str) -> DataFrame:
    """Adds `before`: the summed sizes of the earlier siblings among `rows`."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)))
    bases = bucketed.groupBy("parent", "bucket").agg(F.sum(size).alias("total")).select(
        "parent", "bucket", (F.sum("total").over(W.partitionBy("parent").orderBy("bucket")) - F.col("total")).alias("base"))
    inside = F.sum(size).over(W.partitionBy("parent", "bucket").orderBy("id")) - F.col(size)
    return bucketed.withColumn("inside", inside).join(bases, ["parent", "bucket"]).withColumn(
        "before", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def _placed(sizes: DataFrame) -> DataFrame:
    """id, tree_id, cycle_id, steps, off, size, n_kids, inner_size of the nodes with children."""
    cycles = _cycle_labels(sizes.filter("on_cycle"))
    heads = sizes.filter("on_cycle OR parent IS NULL").join(cycles, "id", "left").select(
        "id", F.lit(None).cast("string").alias("ptr"), F.lit(0).cast("long").alias("off"), F.lit(0).alias("steps"),
        F.col("id").alias("tree_id"), "cycle_id", F.col("n_inner") > 0)
    heads = written(heads.toDF("id", "ptr", "off", "steps", "tree_id", "cycle_id", "open_below"))
    below = _earlier_siblings(sizes.filter("NOT on_cycle AND parent IS NOT NULL").select("id", "parent", "size", "n_inner"), "size")
    open_ = written(below.select(
        "id", F.col("parent").alias("ptr"), (F.col("before") + 1).alias("off"), F.lit(1).alias("steps"),
        F.lit(None).cast("string").alias("tree_id"), F.lit(None).cast("string").alias("cycle_id"), (F.col("n_inner") > 0).alias("open_below")))
    done, steps = [heads], [open_]
    while not open_.isEmpty():
        # every open node looks at the node its pointer names, resolved or not; only nodes above others are looked at
        ahead = reduce(DataFrame.unionByName, [*done, open_]).filter("open_below").select(
            F.col("id").alias("ptr"), F.col("ptr").alias("a_ptr"), F.col("off").alias("a_off"), F.col("steps").alias("a_steps"),
            F.col("tree_id").alias("a_tree"), F.col("cycle_id").alias("a_cycle"))
        stepped = written(open_.drop("cycle_id", "tree_id").join(ahead, "ptr").select(
            "id", F.col("a_ptr").alias("ptr"), (F.col("off") + F.col("a_off")).alias("off"), (F.col("steps") + F.col("a_steps")).alias("steps"),
            F.col("a_tree").alias("tree_id"), F.col("a_cycle").alias("cycle_id"), "open_below"))
        done.append(stepped.filter("ptr IS NULL"))
        open_ = stepped.filter("ptr IS NOT NULL")
        steps.append(stepped)
    rows = written(reduce(DataFrame.unionByName, done).join(sizes.select("id", "size", "n_kids", "on_cycle"), "id").select(
        "id", "tree_id", "cycle_id", "steps", "off", "size", "n_kids", "open_below", "on_cycle"))
    discard(heads, *steps, sizes)
    return rows


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of nodes that come sorted by tree, block and position; ranges that only pass through have no `own`."""
    at, stack = None, []
    for batch in batches:
        ids, paths = [], []
        for node, tree, block, lft, rgt, own in zip(batch["id"], batch["tree_id"], batch["block"], batch["lft"], batch["rgt"], batch["own"]):
            if (tree, block) != at:
                at, stack = (tree, block), []
            while stack and stack[-1][1] < lft:
                stack.pop()
            stack.append((node, rgt))
            if own:
                ids.append(node)
                paths.append([x for x, _ in stack])
        yield pd.DataFrame({"id": ids, "tree_path": paths})


def _with_paths(placed: DataFrame) -> DataFrame:
    """Adds tree_path, the ids from the head of the node's tree down to it."""
    ranged = placed.filter("steps > 0 OR open_below").select("id", "tree_id", F.col("off").alias("lft"), (F.col("off") + F.col("size") - 1).alias("rgt"))
    first, last = F.floor(F.col("lft") / BLOCK), F.floor(F.col("rgt") / BLOCK)
    spread = ranged.select("id", "tree_id", "lft", "rgt", F.explode(F.sequence(first, last)).alias("block"), first.alias("first"))
    sorted_ = spread.withColumn("own", F.col("block") == F.col("first")).drop("first").repartition("tree_id", "block").sortWithinPartitions(
        "tree_id", "block", "lft")
    paths = sorted_.mapInPandas(_swept, "id string, tree_path array<string>")
    return placed.join(paths, "id", "left").withColumn("tree_path", F.coalesce("tree_path", F.array("id")))


def build_hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Root, depth, path and preorder range of every node.

    nodes: one row per node (repeated ids are merged, the greatest parent wins).
    Columns: id, root_id, depth, path (ids from the root down), n_descendants, tree_id, lft, rgt.

    A node without a parent, or whose parent is no node, is a root (depth 0).
    Nodes on a cycle, or leading into one, get depth -1, root_id = the smallest id
    on that cycle and a null path; a node on a cycle heads its own tree (tree_id),
    whose range covers the nodes that lead into it. Rows with a null id are left
    out; an empty input gives an empty result; other columns are ignored.
    """
    return _with_tree_paths(nodes, id_col, parent_col).drop("tree_path")


def _with_tree_paths(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """`build_hierarchy` and tree_path: ids from the head of a node's tree down, behind cycles too."""
    every = _nodes(nodes, id_col, parent_col)
    inner = _with_paths(_placed(_subtree_sizes(_inner(every))))
    outer = every.filter(F.col("n_kids").isNull()).select("id", "parent")
    above = inner.select(F.col("id").alias("parent"), "tree_id", "cycle_id", "steps", F.col("off").alias("p_off"),
                         F.col("size").alias("p_size"), "tree_path", F.lit(True).alias("found"))
    # nodes without children stand behind their siblings with children, at the end of the parent's range
    last = _earlier_siblings(outer.filter(F.col("parent").isNotNull()).withColumn("one", F.lit(1)), "one").select("id", "parent", "before")
    leaves = outer.filter(F.col("parent").isNull()).withColumn("before", F.lit(None).cast("long")).unionByName(last).join(above, "parent", "left").select(
        "id", F.when(F.col("found"), F.col("tree_id")).otherwise(F.col("id")).alias("tree_id"), "cycle_id",
        F.when(F.col("found"), F.col("steps") + 1).otherwise(0).alias("steps"),
        F.when(F.col("found"), F.col("p_off") + F.col("p_size") - 1 - F.col("before")).otherwise(0).cast("long").alias("off"),
        F.lit(1).cast("long").alias("size"),
        F.when(F.col("found"), F.concat("tree_path", F.array("id"))).otherwise(F.array("id")).alias("tree_path"))
    rows = inner.select(leaves.columns).unionByName(leaves)
    looped = F.col("cycle_id").isNotNull()
    return rows.select(
        "id",
        F.coalesce("cycle_id", "tree_id").alias("root_id"),
        F.when(looped, F.lit(-1)).otherwise(F.col("steps")).cast("int").alias("depth"),
        F.when(~looped, F.col("tree_path")).alias("path"),
        (F.col("size") - 1).alias("n_descendants"),
        "tree_id",
        F.col("off").alias("lft"),
        (F.col("off") + F.col("size") - 1).alias("rgt"),
        "tree_path",
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """All (ancestor_id, descendant_id, distance) pairs of acyclic nodes, read off their paths; see `all_descendants`."""
    return _pairs(hierarchy.filter("depth > 0").withColumn("tree_path", F.col("path")))


def all_descendants(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """All (ancestor_id, descendant_id, distance) pairs of the trees.

    The sweep over the nested ranges gives, for each node, the ranges it lies in, in
    their order; each of them is a pair. A node on a cycle heads its tree: it is an
    ancestor of the nodes behind it, and no other node of the cycle is.
    """
    return _pairs(_with_tree_paths(nodes, id_col, parent_col))


def _pairs(rows: DataFrame) -> DataFrame:
    above = F.size("tree_path") - 1
    return (
        rows.filter(above > 0)
        .select(F.col("id").alias("descendant_id"), above.alias("above"), F.posexplode(F.slice("tree_path", 1, above)))
        .select(F.col("col").alias("ancestor_id"), "descendant_id", (F.col("above") - F.col("pos")).alias("distance"))
    )
