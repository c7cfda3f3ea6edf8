"""Connected components of an edge table by minimum-label propagation with pointer jumping.

Forests of single parents need pointer jumps only (``roots_of``); more links are
then merged on the graph of components (``merge_components``).


Labels live in Parquet tables of the shared checkpoint folder, one per round, so
lineage stays short and lost executors cost one round at most. Nothing but the
count of changed labels comes to the driver. Minimum is a partial aggregation
and the joins are splittable where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_dir, stored, work_dir


def roots_of(parents: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """Table (node, comp) of a forest given as (node, parent) with parent < node, one parent a node; comp is the root.

    Pointer jumping: each round doubles the height that is resolved. Roots are nodes of the result, too.
    """
    spark = parents.sparkSession
    whole = parents.select("node", "parent").unionByName(parents.select(F.col("parent").alias("node"), "parent").distinct().join(parents.select("node"), "node", "left_anti"))
    labels = stored(whole.select("node", F.col("parent").alias("comp")), f"{folder}/roots0")
    for k in range(1, most + 1):
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        table = stored(labels.join(up, "comp").select("node", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")), f"{folder}/roots{k}")
        moved = not table.where("moved").isEmpty()
        labels = table.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"the forest did not settle in {most} rounds")


def merge_components(comps: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(node, comp) after more links (a, b): only the graph of components is worked on."""
    of = comps.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
    ends = links.select("a", "b").join(of, F.col("a") == F.col("__n"), "left").select(F.coalesce("__c", "a").alias("x"), "a", "b")
    of2 = of.select(F.col("__n").alias("__m"), F.col("__c").alias("__d"))
    ends = ends.join(of2, F.col("b") == F.col("__m"), "left").select("x", F.coalesce("__d", "b").alias("y"), "a", "b")
    ends = stored(ends, f"{folder}/ends")
    upper = connected_components(ends, "x", "y", folder)
    nodes = comps.select("node", "comp").unionByName(ends.select(F.col("a").alias("node"), F.col("x").alias("comp"))).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("comp"))).distinct()
    top = upper.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return stored(nodes.join(top, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), f"{folder}/merged")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None, most: int = 60) -> DataFrame:
    """Table (node, comp) for every node of ``edges`` (loops allowed); comp is the smallest node reachable."""
    spark = edges.sparkSession
    folder = folder or work_dir(spark, "components")
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    both = stored(one.where("u != v").select("u", "v").unionByName(one.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{folder}/edges")
    # Each node starts at the smallest of itself and its neighbours.
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{folder}/labels0")
    for k in range(1, most + 1):
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        # Pointer jump: take the label of the label as well.
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        table = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), F.col("comp").alias("old"))
        table = stored(table, f"{folder}/labels{k}")
        changed = table.where("comp != old").limit(1).count()
        if k > 1:
            remove_dir(spark, f"{folder}/labels{k - 2}")
        labels = table.select("node", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
