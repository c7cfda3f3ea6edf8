"""Recursive operators over edge tables: reachability, closure, components.

Each round is one join of the frontier with the edges and one anti-join with what
is already known, so cycles end. Rounds are written to the shared checkpoint
folder, which keeps lineage short and survives lost executors.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored, work_dir


def follow(edges: DataFrame, starts: DataFrame, reverse: bool = False, exclude_start: bool = False, leaves_only: bool = False) -> DataFrame:
    """(start, node): all nodes reachable from each start along (src, dst); a start reaches itself unless excluded.
    A null start reaches nothing else.

    ``leaves_only``: only nodes without a further edge.
    """
    spark = edges.sparkSession
    step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    folder = work_dir(spark, "follow")
    step = stored(step.distinct(), f"{folder}/edges")
    seen = stored(starts.select("start", F.col("start").alias("node")).distinct(), f"{folder}/seen0")
    frontier, rounds = seen, [seen]
    for k in count(1):
        near = frontier.where("start IS NOT NULL").join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        fresh = stored(near.join(known, ["start", "node"], "left_anti"), f"{folder}/seen{k}")
        if fresh.isEmpty():
            break
        rounds.append(fresh)
        frontier = fresh
        if len(rounds) > 8:  # few tables to read, however deep the graph
            whole = rounds[0]
            for r in rounds[1:]:
                whole = whole.unionByName(r)
            rounds = [stored(whole, f"{folder}/merged{k}")]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    if leaves_only:
        out = out.join(step.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("start", "node")
    if exclude_start:
        # A start on a cycle stays excluded: it is where the walk began.
        out = out.where(F.col("start") != F.col("node"))
    return out


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for all pairs joined by a path of one edge or more, by doubling."""
    spark = edges.sparkSession
    folder = work_dir(spark, "closure")
    pairs = stored(edges.select("src", "dst").distinct(), f"{folder}/0")
    for k in range(1, 64):
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        grown = stored(pairs.unionByName(longer).distinct(), f"{folder}/{k}")
        if grown.count() == pairs.count():
            return pairs
        pairs = grown
    raise RuntimeError("the closure did not settle")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable when edges count both ways.

    Each round takes the smallest label nearby and then that label's own label, so
    a chain settles in logarithmic rounds.
    """
    spark = edges.sparkSession
    folder = work_dir(spark, "components")
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), f"{folder}/edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("comp")), f"{folder}/0")
    for k in count(1):
        near = both.join(labels.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.least("comp", "near").alias("least"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("least"), F.col("comp").alias("far"))
        table = stored(least.join(jump, "least").select("node", F.least("least", "far").alias("comp"), "old"), f"{folder}/{k}")
        labels = table.select("node", "comp")
        if table.where("comp != old").isEmpty():
            return labels
