"""Set operators over quads and typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUAD = ["s", "p", "o", "ot", "c"]


def union(*stores: DataFrame) -> DataFrame:
    """Union scan of several stores, each statement once."""
    return reduce(lambda a, b: a.unionByName(b), stores).dropDuplicates(QUAD)


def difference(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of only one side, with ``change`` = 'removed' or 'added': one shuffle of net counts, summed before it."""
    keys = keys or old.columns
    both = old.select(*keys).withColumn("__n", F.lit(1)).unionByName(new.select(*keys).withColumn("__n", F.lit(-1)))
    net = both.groupBy(*keys).agg(F.sum("__n").alias("__n")).where("__n != 0")
    change = F.when(F.col("__n") > 0, "removed").otherwise("added").alias("change")
    # A row that one side holds n times more often comes out n times.
    return net.select(*keys, change, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n"))).alias("__k")).drop("__k")


def without(base: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` whose key is not in ``removed``; null keys match each other."""
    other = removed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return base.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


def scan(quads: DataFrame, subject=None, predicate=None, obj=None, objecttype=None, context=None, as_quad: bool = True, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Pattern scan: None is a wildcard. An object without a type does not match references."""
    out = quads
    for name, want in (("s", subject), ("p", predicate), ("o", obj), ("ot", objecttype), ("c", context)):
        if want is not None:
            out = out.where(F.col(name) == want)
    if obj is not None and objecttype is None:
        out = out.where("ot <> 'R'")
    keys = QUAD if as_quad else QUAD[:4]
    out = out.dropDuplicates(keys)
    if limit is not None or offset is not None:
        out = out.orderBy(*QUAD)
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out


def as_of(changes: DataFrame, revision: str | int, keys: list[str], rev: str = "rev", op: str = "op") -> DataFrame:
    """Net state at a revision: of each key the last change, if it added."""
    last = changes.where(F.col(rev) <= F.lit(revision)).groupBy(*keys).agg(F.max_by(op, rev).alias("__op"))
    return last.where("__op = 'add'").select(*keys)


def nest(df: DataFrame, keys: list[str], name: str = "rows") -> DataFrame:
    """Group rows under their key as an array of structs."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, name: str = "rows", outer: bool = False) -> DataFrame:
    """The inverse: one row per element; ``outer`` keeps rows with an empty cell."""
    others = [c for c in df.columns if c != name]
    exploded = df.select(*others, (F.explode_outer if outer else F.explode)(name).alias("__x"))
    return exploded.select(*others, "__x.*")


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key by ``at``."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reifications(quads: DataFrame, s: str, p: str, o: str, prefix: str = "http://www.w3.org/1999/02/22-rdf-syntax-ns#") -> DataFrame:
    """Ids of statements about the statement (s, p, o): one aggregation instead of three self-joins."""
    wanted = F.count_if((F.col("p") == prefix + "subject") & (F.col("o") == s)) * F.count_if((F.col("p") == prefix + "predicate") & (F.col("o") == p)) * F.count_if((F.col("p") == prefix + "object") & (F.col("o") == o))
    rows = quads.where(F.col("p").isin(prefix + "subject", prefix + "predicate", prefix + "object"))
    return rows.groupBy(F.col("s").alias("id")).agg(wanted.alias("n")).where("n > 0").select("id")


def ordered(quads: DataFrame) -> DataFrame:
    """Per subject and property the values in list order."""
    v = F.struct(F.element_at(F.coalesce("listpos", F.array(F.lit(1 << 30))), 1).alias("pos"), "o", "ot")
    return quads.groupBy("s", "p").agg(F.sort_array(F.collect_list(v)).alias("vs")).select("s", "p", F.transform("vs", lambda x: F.struct(x["o"].alias("o"), x["ot"].alias("ot"))).alias("values"))
