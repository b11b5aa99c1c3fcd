"""Question equivalence and lineage: components, ancestors, version differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.skew import hot_keys, salted_join
from cohortspark.operators.storage import stored

#: Levels of ancestors after which their tables are merged into one, so that plans stay small on long chains.
MERGED_LEVELS = 20
#: A graph of at most so many distinct edges is solved in one task.
SMALL = 200_000


def components(edges: DataFrame, label: str = "min", rounds: int = 60, small: int = SMALL) -> DataFrame:
    """node, component of an undirected graph (src, dst); the component's id is its least (``min``) or greatest (``max``) node.

    Large stars and small stars alternate: each round links every node's greater neighbours to its least neighbour, which
    takes a logarithmic number of rounds also on long chains. Each round is stored, so lineage stays short. Null ends and
    loops are dropped; a node without edges doesn't occur. Neighbour lists are never gathered: the least neighbour
    comes from partial aggregation, and a node with a large share of all edges is spread over tasks in the joins. A graph
    of at most ``small`` distinct edges, which are counted, is solved in one task instead of many rounds.
    """
    sign = 1 if label == "min" else -1
    e = edges.select((F.col("src") * sign).alias("a"), (F.col("dst") * sign).alias("b")).where("a is not null and b is not null and a <> b")
    current = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = current.count()
    if n <= small:
        solved = current.coalesce(1).mapInPandas(_solved, "node bigint, component bigint")
        return solved.select((F.col("node") * sign).alias("node"), (F.col("component") * sign).alias("component"))
    before, total = None, 2 * n
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = salted_join(both, least.drop("n"), ["a"], hot_keys(least, ["a"], "n", total), F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low.drop("n"), ["a"], hot_keys(low, ["a"], "n", total), F.col("b")).where("b <> m").select("b", "m").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        current = stored(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, 2 * state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    found = current.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(found, nodes.node == found.a, "left").select((F.col("node") * sign).alias("node"), (F.coalesce("m", "node") * sign).alias("component"))


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a small graph (a, b): labels fall to the least of each edge's ends, then each to its label's label."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    edges = pd.concat(held)
    nodes, at = np.unique(edges[["a", "b"]].to_numpy(np.int64).T.ravel(), return_inverse=True)
    a, b = at[: len(edges)], at[len(edges) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], least)
            np.minimum.at(new, end, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pd.DataFrame({"node": nodes, "component": nodes[label]})


def equivalence_groups(edges: DataFrame) -> DataFrame:
    """node, group_id: components numbered 1, 2, ... by ascending greatest member."""
    from cohortspark.operators.upsert import numbered

    found = components(edges, "max")
    ids = numbered(found.select("component").distinct(), ["component"], "group_id")
    return found.join(ids, "component").select("node", F.col("group_id").cast("bigint").alias("group_id"))


def ancestors(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, ancestor, depth: all ways up a directed graph (child, parent), the shortest for each pair; cycles end where they close.

    ``start`` (node) limits the nodes asked for. Each level is stored; it ends when a level brings no new pair, however
    far that is.
    """
    e = edges.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    level = e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    if start is not None:
        level = level.join(start.select("node").distinct(), "node", "left_semi")
    level = stored(level, "ancestors")
    found, d = level, 1
    while True:
        d += 1
        step = level.join(e, level.ancestor == e.child).select("node", F.col("parent").alias("ancestor")).where("node <> ancestor").distinct()
        level = stored(step.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(d)), "ancestors")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
        if d % MERGED_LEVELS == 0:
            found = stored(found, "ancestors")


def version_differences(old: DataFrame, new: DataFrame, of: list[str] | None = None) -> DataFrame:
    """link_id, change (added, removed, reworded, reordered) between two versions (link_id, question_text, display_order).

    ``of`` names columns on both sides that say which versions belong together.

    Unchanged items give no row; a change of words takes precedence over a change of place. Repeated link_ids count
    by their first place.
    """
    first = lambda df, p: df.groupBy(*(of or []), "link_id").agg(F.min(F.struct("display_order", "question_text")).alias(p))
    both = first(old, "o").join(first(new, "n"), [*(of or []), "link_id"], "full")
    change = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(~F.col("o.question_text").eqNullSafe(F.col("n.question_text")), "reworded")
        .when(~F.col("o.display_order").eqNullSafe(F.col("n.display_order")), "reordered")
    )
    return both.select(*(of or []), "link_id", change.alias("change")).where("change is not null")
