"""Are two quad tables equal up to the names of anonymous objects? By colour refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import BNODE, REF
from ..sources.files import stored, work_dir


def colours(quads: DataFrame, rounds: int = 8) -> DataFrame:
    """Quads with anonymous ids replaced by a hash of their surroundings."""
    blank = lambda c: F.col(c).startswith(BNODE)
    q = quads.select("s", "p", "o", "ot", "c")
    nodes = q.where(blank("s")).select(F.col("s").alias("n")).union(q.where(blank("o") & (F.col("ot") == REF)).select("o")).distinct()
    folder = work_dir(quads.sparkSession, "colour")
    colour = stored(nodes.withColumn("h", F.lit("")), f"{folder}/0")

    def painted(c: DataFrame) -> DataFrame:
        cs, co = c.select(F.col("n").alias("s"), F.col("h").alias("hs")), c.select(F.col("n").alias("o"), F.col("h").alias("ho"))
        return q.join(cs, "s", "left").join(co, "o", "left")

    for k in range(1, rounds + 1):
        t = painted(colour)
        out = t.where(blank("s")).select(F.col("s").alias("n"), F.md5(F.concat_ws("|", F.lit(">"), "p", F.coalesce("ho", "o"), "ot", "c")).alias("e"))
        into = t.where(blank("o") & (F.col("ot") == REF)).select(F.col("o").alias("n"), F.md5(F.concat_ws("|", F.lit("<"), "p", F.coalesce("hs", "s"), "c")).alias("e"))
        colour = stored(out.union(into).groupBy("n").agg(F.md5(F.array_join(F.array_sort(F.collect_list("e")), ",")).alias("h")), f"{folder}/{k}")
    t = painted(colour)
    return t.select(F.coalesce("hs", "s").alias("s"), "p", F.coalesce("ho", "o").alias("o"), "ot", "c")


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    x, y = colours(a), colours(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
