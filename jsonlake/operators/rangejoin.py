"""Joins on an order comparison, by blocks of sorted rows.

A plain join tests every pair, in as many tasks as its larger side was read in.
Here each side is cut into blocks of neighbouring rows; only pairs of blocks
whose bounds allow a match are kept, spread evenly over the tasks and unfolded
there. The work is that of sorting both sides and of the pairs that match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, a power of two: of fixed width, and of texts, arrays and the like.
NARROW, WIDE = 256, 64


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, (T.MapType, T.VariantType))


def _blocks(df: DataFrame, keys: list[str], value: Column, side: str, rows: int | None) -> DataFrame:
    """One row per block: its keys, number, least and greatest value, whether a value is null, and its rows."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    fields = [f for f in df.schema.fields if f.name not in keys]
    wide = any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in fields)
    v, tie, at = f"__{side}v", f"__{side}tie", f"__{side}at"
    # Equal values are told apart by a hash of the row, so that a task that is run again cuts the same blocks.
    hashed = [F.col(f"`{f.name}`") for f in fields if not _has_map(f.dataType)]
    df = df.withColumn(v, value).withColumn(tie, F.xxhash64(*hashed) if hashed else F.lit(0))
    order = [*keys, v, tie]
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = df.withColumn(at, F.expr(f"monotonically_increasing_id() div {rows or (WIDE if wide else NARROW)}"))
    row = F.struct(*[F.col(f"`{f.name}`") for f in fields])
    return df.groupBy(*keys, at).agg(F.min(v).alias(f"__{side}min"), F.max(v).alias(f"__{side}max"), F.max(F.col(v).isNull()).alias(f"__{side}null"), F.collect_list(row).alias(f"__{side}rows"))


def range_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], low: Column, high: Column, left_is_low: bool, strict: bool, condition: Column, rows: int | None = None) -> DataFrame:
    """Inner join where ``condition`` holds, which implies that ``low`` is below ``high`` or, if not ``strict``, equal.

    ``low`` is a column of one side and ``high`` of the other; null is below everything. ``keys`` are pairs of
    columns that must be equal and that the result drops. ``rows`` is the size of a block.
    """
    a = _blocks(left, [k for k, _ in keys], low if left_is_low else high, "l", rows)
    b = _blocks(right, [k for _, k in keys], high if left_is_low else low, "r", rows)
    lo, hi = ("l", "r") if left_is_low else ("r", "l")
    least, most = F.col(f"__{lo}min"), F.col(f"__{hi}max")
    may = F.col(f"__{lo}null") | F.coalesce(least < most if strict else least <= most, F.lit(False))
    for x, y in keys:
        may = (F.col(x) == F.col(y)) & may
    pairs = a.join(b, may).select("__lat", "__rat", "__lrows", "__rrows").repartition("__lat", "__rat")
    one = pairs.select(F.inline("__lrows"), "__rrows")
    both = one.select(*[F.col(f"`{c}`") for c in one.columns if c != "__rrows"], F.inline("__rrows"))
    return both.where(condition)
