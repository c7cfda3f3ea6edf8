"""Order comparisons between labels: the pairs of brute force, spread over the tasks, without testing all pairs."""

import itertools
import operator

import pytest
from pyspark.sql import functions as F

from jsonlake.operators.rangejoin import range_join
from jsonlake.store import Store

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
NAN = float("nan")
#: Ties, nulls (below everything), NaN (above all numbers) and both zeros.
A = [5.0, None, -3.0, 0.0, -0.0, 7.5, 7.5, NAN, 2.0, None, 1e9, 5.0]
B = [7.5, 0.0, None, NAN, -3.0, 2.0, -1e9, 5.0, -0.0]


def rank(x):
    return (0, 0) if x is None else (2, 0) if x != x else (1, x)


def tables(spark, a, b, kind="double"):
    left = spark.createDataFrame([(i, i % 3 if i % 5 else None, v) for i, v in enumerate(a)], f"a int, g int, x {kind}").coalesce(1)
    right = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(b)], f"b int, h int, y {kind}").coalesce(1)
    return left, right


def stored(spark, left, right):
    return Store.from_tables(spark, {"l": left, "r": right}, {"l": "a", "r": "b"})


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("kind", ["double", "string"])
def test_comparison_join_equals_brute_force(spark, op, kind):
    a, b = (A, B) if kind == "double" else ([None if v is None else f"t{v}" for v in x] for x in (A, B))
    s = stored(spark, *tables(spark, a, b, kind))
    got = sorted(map(tuple, s.query_df(f'{{?l a, "b": ?r.b where ?l.x {op} ?r.y}}').collect()))
    assert got == [(i, j) for (i, v), (j, w) in itertools.product(enumerate(a), enumerate(b)) if OPS[op](rank(v), rank(w))]


@pytest.mark.parametrize("rows", [1, 4])
@pytest.mark.parametrize("left_is_low", [True, False])
def test_blocks_lose_and_double_nothing(spark, rows, left_is_low):
    a, b = [v % 37 for v in range(150)], [v % 11 + 20 for v in range(60)]
    left, right = tables(spark, a, b, "int")
    low, high = (F.col("x"), F.col("y")) if left_is_low else (F.col("y"), F.col("x"))
    got = range_join(left, right, [], low, high, left_is_low, True, low < high, rows).select("a", "b")
    want = [(i, j) for (i, v), (j, w) in itertools.product(enumerate(a), enumerate(b)) if (v < w if left_is_low else w < v)]
    assert sorted(map(tuple, got.collect())) == want


def test_only_blocks_that_may_match_are_unfolded(spark):
    left, right = tables(spark, list(range(1000)), [v + 950 for v in range(1000)], "int")
    tested = range_join(left, right, [], F.col("y"), F.col("x"), False, True, F.lit(True), 16).count()
    assert 49 * 48 / 2 <= tested < 20_000  # of 1,000,000 pairs


def test_comparison_join_uses_more_than_the_tasks_of_its_input(spark):
    left, right = tables(spark, [float(v) for v in range(4000)], [float(v) for v in range(0, 4000, 4)])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = stored(spark, left, right).query_df('{?l a, "b": ?r.b where ?l.x + 100 < ?r.y}')
        shares = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(shares) == sum(v - 100 > x for x in range(4000) for v in range(0, 4000, 4))
    assert len(shares) > 1 and max(shares) < 0.6 * sum(shares)


@pytest.mark.parametrize("op", OPS)
def test_keyed_comparison_join_equals_brute_force(spark, op):
    left, right = tables(spark, A, B)
    s = stored(spark, left, right)
    got = sorted(map(tuple, s.query_df(f'{{?l a, "b": ?r.b where ?l.g = ?r.h and ?l.x {op} ?r.y}}').collect()))
    assert got == [(i, j) for (i, v), (j, w) in itertools.product(enumerate(A), enumerate(B)) if i % 5 and i % 3 == j % 3 and OPS[op](rank(v), rank(w))]


def test_two_comparisons_and_a_key_equal_brute_force(spark):
    s = stored(spark, *tables(spark, A, B))
    got = sorted(map(tuple, s.query_df('{?l a, "b": ?r.b where ?l.g = ?r.h and ?l.x < ?r.y and ?l.a + 1 >= ?r.b}').collect()))
    assert got == [(i, j) for (i, v), (j, w) in itertools.product(enumerate(A), enumerate(B)) if i % 5 and i % 3 == j % 3 and rank(v) < rank(w) and i + 1 >= j]


@pytest.mark.parametrize("rows", [1, 4, 16])
def test_keyed_blocks_lose_and_double_nothing(spark, rows):
    left, right = (df.withColumn(k, F.col(v)) for df, k, v in zip(tables(spark, [v % 37 for v in range(150)], [v % 11 + 20 for v in range(60)], "int"), ("lk", "rk"), ("g", "h"), strict=True))
    got = range_join(left, right, [("lk", "rk")], F.col("x"), F.col("y"), True, False, F.col("x") <= F.col("y"), rows)
    assert "lk" not in got.columns and "rk" not in got.columns
    want = [(i, j) for i in range(150) for j in range(60) if i % 5 and i % 3 == j % 3 and i % 37 <= j % 11 + 20]
    assert sorted(map(tuple, got.select("a", "b").collect())) == want


def test_a_frequent_key_is_shared_by_several_tasks(spark):
    left, right = tables(spark, [float(v) for v in range(4000)], [float(v) for v in range(0, 4000, 4)])
    left, right = left.withColumn("g", F.lit(1)), right.withColumn("h", F.lit(1))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = stored(spark, left, right).query_df('{?l a, "b": ?r.b where ?l.g = ?r.h and ?l.x < ?r.y}')
        shares = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(shares) == sum(range(0, 4000, 4))
    assert len(shares) > 1 and max(shares) < 0.6 * sum(shares)
