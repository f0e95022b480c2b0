"""Level-by-level growth of all trees of all splits together.

A data row stands once, with its bins and an array of (tree, slot, counted, multiplicity): the slot numbers the open
nodes of a tree at this level. The rows are read once a level, for the histogram, where the array is exploded before
partial sums, and once to move them down. Of two open siblings only the smaller one is counted; the other's counts are
their parent's less its sibling's. Everything else (split scores, child sizes, purity, leaf values) follows from the
histogram's small tables. Each level's rows are written to the shared folder, which ends their lineage, and the former
level's are deleted. With a ``folder``, each level leaves a manifest there, from which a later run goes on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import discard, exists, settle, settled_at, spread, write_text
from . import impurity

TREE_NODE = ["split", "tree", "node_id"]


@dataclass(frozen=True)
class Growth:
    n_bins: int
    max_depth: int
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    classes: tuple[float, ...] | None = None
    #: (split, weights array<double>, one a class), or None.
    weights: DataFrame | None = None
    lengths: str = "lengths"
    compat_min_reduction: bool = False


def initial_assign(binned: DataFrame, sample: DataFrame) -> DataFrame:
    """(split, client, tree, row_id, mult, node_id, bins, y): all sampled rows in the root."""
    joined = sample.join(binned.select("split", "client", "row_id", "bins", "y"), ["split", "client", "row_id"])
    return joined.withColumn("node_id", F.lit(1).cast("bigint"))


def initial_state(binned: DataFrame, sample: DataFrame) -> DataFrame:
    """(split, client, bins, y, at): each row once, in the first slot of the trees whose samples hold it."""
    key = ["split", "client", "row_id"]
    own = spread(sample, sample.count(), *key).groupBy(*key).agg(F.collect_list(F.struct("tree", F.lit(0).alias("slot"), F.lit(True).alias("counted"), "mult")).alias("at"))
    rows = binned.select(*key, "bins", "y").join(own, key, "left")
    return rows.select("split", "client", "bins", "y", F.coalesce("at", F.array().cast(own.schema["at"].dataType)).alias("at"))


def own_state(rows: DataFrame) -> DataFrame:
    """As ``initial_state``, of rows that hold their own ``sample``."""
    at = F.transform("sample", lambda x: F.struct(x["tree"].alias("tree"), F.lit(0).alias("slot"), F.lit(True).alias("counted"), x["mult"].alias("mult")))
    return rows.select("split", "client", "bins", "y", at.alias("at"))


def unpacked(state: DataFrame) -> DataFrame:
    """One row a data row and tree that is counted at this level, with ``slot``; only ever the input of partial sums."""
    counted = F.filter("at", lambda x: x["counted"])
    return state.select("split", "client", "bins", "y", F.explode(counted).alias("a")).select("split", "client", "bins", "y", "a.tree", "a.slot", "a.mult")


def moved(state: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows in the slots of the next level. ``steps``: (split, steps), one row a split, broadcast: by tree and slot the
    split and the children's slots, null for a leaf; trees times open nodes a tree."""

    def to(x: Column) -> Column:
        s = F.get(F.get("__steps", x["tree"]), x["slot"])
        side = F.when(F.get("bins", s["feature"]) > s["thr"], s["right"]).otherwise(s["left"])
        return F.struct(x["tree"].alias("tree"), side["slot"].alias("slot"), side["counted"].alias("counted"), x["mult"].alias("mult"))

    at = F.filter(F.transform("at", to), lambda x: x["slot"].isNotNull())
    return state.join(F.broadcast(steps.withColumnRenamed("steps", "__steps")), "split").withColumn("at", at).drop("__steps")


def leaf_value(parts: Column, g: Growth) -> Column:
    """``parts``: list of sites' arrays. Most frequent class, ties to the smallest; or mean of the sites' means."""
    if g.classes is not None:
        k = len(g.classes)
        sums = F.aggregate(parts, F.array(*[F.lit(0).cast("bigint")] * k), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        at = F.array_position(sums, F.array_max(sums)).cast("int") - 1
        return F.get(F.array(*[F.lit(float(c)) for c in g.classes]), at)
    full = F.filter(parts, lambda x: F.get(x, F.lit(0)) > 0)
    total = F.aggregate(full, F.lit(0.0), lambda a, x: a + F.get(x, F.lit(1)) / F.get(x, F.lit(0)))
    return F.when(F.size(full) > 0, total / F.size(full))


def sizes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.aggregate(x, F.lit(0).cast("bigint"), lambda p, q: p + q))


def child_stats(cum: DataFrame, best: DataFrame, g: Growth) -> DataFrame:
    """Per split node: both children's rows, number of sites where they are impure, and leaf values; also the node's own value."""
    own = cum.join(best.select(*TREE_NODE, "pos", "thr", "score"), [*TREE_NODE, "pos"])
    left = F.get("left", F.col("thr"))
    sited = own.select(*TREE_NODE, "feature", "thr", "score", "client", left.alias("l"), F.zip_with("total", left, lambda t, x: t - x).alias("r"), "total")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("client", c))), lambda x: x[c])
    grouped = sited.groupBy(*TREE_NODE, "feature", "thr", "score").agg(ordered("l").alias("l"), ordered("r").alias("r"), ordered("total").alias("t"))
    count = (lambda parts: sizes(parts)) if g.classes is not None else (lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.get(x, F.lit(0))).cast("bigint"))
    impure = lambda parts: F.size(F.filter(parts, lambda x: ~impurity.pure(x, g.classes)))
    side = lambda s: F.struct(count(F.col(s)).alias("n"), impure(F.col(s)).alias("impure"), leaf_value(F.col(s), g).alias("value"))
    return grouped.select(*TREE_NODE, "feature", "thr", "score", side("l").alias("left"), side("r").alias("right"), leaf_value(F.col("t"), g).alias("value"))


def decide(stats: DataFrame, g: Growth) -> DataFrame:
    """Stopping rules: ``is_leaf`` of the node (a child is too small) and of each child (too few rows to split, or pure everywhere)."""
    small = F.least("left.n", "right.n") < g.min_samples_leaf
    ends = lambda s: (F.col(f"{s}.n") < g.min_samples_split) | (F.col(f"{s}.impure") == 0)
    return stats.withColumns({"is_leaf": small, "left_leaf": ends("left"), "right_leaf": ends("right")})


def level_nodes(made: DataFrame, depth: int, last: bool) -> DataFrame:
    """The nodes that one level settles: its own, and children that are leaves (all of them at the last level)."""
    spot = lambda depth, node, feature, thr, score, leaf, value: [F.col("split"), F.col("tree"), node.alias("node_id"), F.lit(depth).alias("depth"), feature.alias("feature"), thr.alias("thr"), score.alias("score"), leaf.alias("is_leaf"), value.alias("value")]
    inner = lambda c: F.when(~F.col("is_leaf"), F.col(c))
    out = made.select(*spot(depth - 1, F.col("node_id"), inner("feature"), inner("thr"), inner("score"), F.col("is_leaf"), F.when(F.col("is_leaf"), F.col("value"))))
    kept = made.filter(~F.col("is_leaf"))
    none_int, none_double = F.lit(None).cast("int"), F.lit(None).cast("double")
    for side, bit in (("left", 0), ("right", 1)):
        done = kept if last else kept.filter(F.col(f"{side}_leaf"))
        out = out.unionByName(done.select(*spot(depth, F.col("node_id") * 2 + bit, none_int, none_int, none_double, F.lit(True), F.col(f"{side}.value"))))
    return out


def opened(made: DataFrame, subtract: bool) -> DataFrame:
    """(split, tree, parent, bit, node_id, slot, counted) of the children that stay open. Of two open siblings the smaller
    one is counted (the left one, if they are equal), the other's counts are a difference; a single one is counted."""
    kept = made.filter(~F.col("is_leaf"))
    both = ~F.col("left_leaf") & ~F.col("right_leaf") & F.lit(subtract)
    smaller = F.col("left.n") <= F.col("right.n")
    child = lambda bit, side, own: F.struct(F.lit(bit).alias("bit"), F.col(f"{side}_leaf").alias("ends"), (~both | own).alias("counted"))
    sides = F.explode(F.array(child(0, "left", smaller), child(1, "right", ~smaller))).alias("s")
    rows = kept.select("split", "tree", F.col("slot").alias("parent"), "node_id", sides).filter(~F.col("s.ends"))
    rows = rows.select("split", "tree", "parent", "s.bit", (F.col("node_id") * 2 + F.col("s.bit")).alias("node_id"), "s.counted")
    # Slots are numbered inside a tree, so the windows are as small as a tree's level.
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("split", "tree").orderBy("node_id")) - 1)


def step_table(made: DataFrame, frontier: DataFrame, n_trees: int) -> DataFrame:
    """(split, steps) for ``moved``."""
    side = lambda bit, name: F.max(F.when(F.col("bit") == bit, F.struct(F.col("slot").alias("slot"), "counted"))).alias(name)
    after = frontier.groupBy("split", "tree", "parent").agg(side(0, "left"), side(1, "right")).withColumnRenamed("parent", "slot")
    each = made.select("split", "tree", "slot", "feature", "thr").join(after, ["split", "tree", "slot"], "left")
    per_tree = each.groupBy("split", "tree").agg(F.array_sort(F.collect_list(F.struct("slot", "feature", "thr", "left", "right"))).alias("x"))
    by_tree = per_tree.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("tree", "x"))).alias("m"))
    return by_tree.select("split", F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.try_element_at("m", t)).alias("steps"))


def last_level(spark: SparkSession, folder: str, most: int) -> dict | None:
    """The manifest of the last level that a run has settled in ``folder``."""
    for depth in range(most, 0, -1):
        if exists(spark, path := f"{folder}/level-{depth}"):
            return json.loads(spark.read.text(path, wholetext=True).first().value)


def grow(state: DataFrame | None, tree_features: DataFrame, g: Growth, folder: str | None = None, stop_after: int | None = None) -> DataFrame | None:
    """(split, tree, node_id, depth, feature, thr, score, is_leaf, value) of all reachable nodes. No leaf is deeper than max_depth - 1.

    ``state`` is that of ``initial_state``, and is kept. With a ``folder``, which executors have to share, a manifest is
    written there after each level, and growth goes on from the last one that is there (``state`` is not read then);
    one of other settings is an error. ``stop_after`` ends a run after that level, without nodes.
    """
    spark = tree_features.sparkSession
    classes = list(g.classes) if g.classes is not None else None
    n_trees = tree_features.agg(F.max("tree")).first()[0] + 1
    in_root = lambda df: df.withColumn("node_id", F.col("slot") + F.lit(1).cast("bigint"))
    if g.max_depth == 1:
        first = tree_features.groupBy("tree").agg(F.min("pos").alias("pos"), F.min_by("feature", "pos").alias("feature"))
        cum = impurity.cumulative(impurity.histogram(in_root(unpacked(state)), first), g.n_bins, classes)
        root = cum.groupBy(*TREE_NODE).agg(F.transform(F.array_sort(F.collect_list(F.struct("client", "total"))), lambda x: x["total"]).alias("t"))
        leaf = leaf_value(F.col("t"), g).alias("value")
        return settle(root.select("split", "tree", "node_id", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("thr"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_leaf"), leaf), "nodes")
    frontier = above = None
    decisions: list[DataFrame] = []
    settings = repr((g.n_bins, g.max_depth, g.min_samples_split, g.min_samples_leaf, g.classes, g.weights is not None, g.lengths, g.compat_min_reduction, n_trees))
    owned, begin = None, 1
    if folder is not None and (known := last_level(spark, folder, g.max_depth)):
        if known["settings"] != settings:
            raise ValueError(f"{folder} holds a run of other settings")
        if "nodes" in known:
            return settled_at(spark, known["nodes"])
        owned, frontier, above = (settled_at(spark, known[k]) for k in ("state", "frontier", "cumulative"))
        decisions = [settled_at(spark, path) for path in known["decisions"]]
        state, begin = owned, known["depth"] + 1
    # Sums of labels are doubles: in regression a difference of two is not the sum of the rest to the last bit.
    subtract = classes is not None
    for depth in range(begin, g.max_depth):
        hist = impurity.histogram(unpacked(state).withColumn("node_id", F.col("slot").cast("bigint")), tree_features)
        cum = impurity.cumulative(hist, g.n_bins, classes).withColumnRenamed("node_id", "slot")
        places = None if frontier is None else frontier.select("split", "tree", "slot", "node_id")
        cum = settle(in_root(cum) if frontier is None else cum.join(places, ["split", "tree", "slot"]), "cumulative")
        if frontier is not None and subtract:
            rest = impurity.without_sibling(above, cum, frontier.filter(~F.col("counted")).select(*places.columns))
            counted, cum = cum, settle(cum.unionByName(rest), "cumulative")
            discard(counted)
        weighted = cum if g.weights is None else cum.join(F.broadcast(g.weights), "split")
        local = impurity.local_scores(weighted, g.n_bins, classes, None if g.weights is None else F.col("weights"), g.lengths, g.compat_min_reduction)
        best = impurity.best_splits(impurity.global_scores(local))
        slots = cum.select(*TREE_NODE, "slot").distinct()
        made = settle(decide(child_stats(cum, best, g), g).join(slots, TREE_NODE), "decisions")
        decisions.append(made)
        done = [x for x in (above, frontier) if x is not None]
        if depth == g.max_depth - 1:
            break
        frontier, above = settle(opened(made, subtract), "frontier"), cum
        if frontier.isEmpty():
            break
        steps = settle(step_table(made, frontier, n_trees), "steps")
        former, state = owned, settle(moved(state.filter(F.size("at") > 0), steps), "state")
        owned = state
        if folder is not None:
            level = {"settings": settings, "depth": depth, "state": state._settled_path, "frontier": frontier._settled_path, "cumulative": cum._settled_path, "decisions": [d._settled_path for d in decisions]}
            write_text(spark, json.dumps(level), f"{folder}/level-{depth}")
        for x in [*done, steps, *([former] if former is not None else [])]:
            discard(x)
        if depth == stop_after:
            return None
    out = None
    for depth, made in enumerate(decisions, 1):
        level = level_nodes(made, depth, depth == g.max_depth - 1)
        out = level if out is None else out.unionByName(level)
    nodes = settle(out, "nodes")
    if folder is not None:
        write_text(spark, json.dumps({"settings": settings, "nodes": nodes._settled_path}), f"{folder}/level-{g.max_depth}")
    for x in [cum, *decisions, *([owned] if owned is not None else [])]:
        discard(x)
    return nodes
