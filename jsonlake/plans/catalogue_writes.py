"""Registered queries of the write path, the history and the text formats, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import formats
from ..sources.files import work_dir
from ..store import Store
from ..streaming import history
from .catalogue import customer_quads

#: Revisions of the change log made of events: one for so many events.
EVENTS_A_REVISION = 500
_STORED = "s", "p", "o"


def _stored(s: Store) -> DataFrame:
    return s.quads.select(*_STORED)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_quads(spark, sf_dir).where("p = 'c_mktsegment'")


def _add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second value for one segment's customers; statements that are there already are not added again."""
    s = Store(spark, _segments(spark, sf_dir))
    s.add(s.quads.where("o = 'BUILDING'").unionByName(s.quads.where("o = 'BUILDING'").withColumn("o", F.lit("HOUSES"))))
    return _stored(s)


def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment lose all of their properties but a new one."""
    s = Store(spark, customer_quads(spark, sf_dir))
    chosen = s.quads.where("p = 'c_mktsegment' AND o = 'MACHINERY'")
    s.replace(chosen.withColumn("p", F.lit("c_class")))
    return _stored(s).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("objects"))


def _remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of customers of one segment goes."""
    s = Store(spark, customer_quads(spark, sf_dir))
    of = s.quads.where("p = 'c_mktsegment' AND o = 'FURNITURE'").select("s")
    s.remove(s.quads.where("p = 'c_acctbal'").join(of, "s", "left_semi").select("s", "p", "o", "ot", "c", "listpos"))
    return _stored(s).groupBy("p").agg(F.count("*").alias("n"))


def _maybe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property that half of the objects lack, once required and once not."""
    q = customer_quads(spark, sf_dir)
    s = Store(spark, q.where("p = 'c_name' OR (p = 'c_mktsegment' AND o < 'C')"))
    value = lambda c: F.get(F.col(c), 0)["s"]
    every = s.query_df("{c_name, maybe c_mktsegment}").select(value("c_name").alias("c_name"), value("c_mktsegment").alias("segment"), F.lit("maybe").alias("form"))
    some = s.query_df("{c_name, c_mktsegment}").select(value("c_name").alias("c_name"), value("c_mktsegment").alias("segment"), F.lit("must").alias("form"))
    return every.unionByName(some)


def _round_trip(form: str, ending: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_dir(spark, 'formats')}/customers.{ending}"
        formats.write(customer_quads(spark, sf_dir), path, form)
        number = F.when(F.col("p") == "c_acctbal", F.col("o").cast("double"))
        return formats.read(spark, path).select("s", "p", F.when(number.isNull(), F.col("o")).alias("o"), number.alias("x"))

    return run


def event_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as a change log with its commit order: even event ids add the user's type, odd ones remove it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.floor(F.col("event_id") / EVENTS_A_REVISION)
    rev = F.concat(F.lit("A"), F.lpad(n.cast("string"), 8, "0"))
    log = e.select(F.col("user_id").cast("string").alias("s"), F.lit("did").alias("p"), F.col("event_type").alias("o"), F.lit("L").alias("ot"), F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos"), F.when(F.col("event_id") % 2 == 0, "add").otherwise("del").alias("op"), rev.alias("rev"))
    return log, e.select(rev.alias("rev"), n.cast("int").alias("n")).distinct()


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.state_at(*event_log(spark, sf_dir), rev="A00000008").select("s", "o")


def _changes_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes_after(*event_log(spark, sf_dir), "A00000008").select("s", "o", "op")


def _modified_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.modified_after(*event_log(spark, sf_dir), "A00000018")


def _last_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_revision(*event_log(spark, sf_dir)).select("s", "o", "rev")


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who changed a statement last: one author writes all regions' nations, another moves those of one region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = n.select(F.col("n_name").alias("s"), F.lit("region").alias("p"), F.col("n_regionkey").cast("string").alias("o"), F.lit("L").alias("ot"), F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos"))
    s = Store(spark, rows.limit(0)).with_history(work_dir(spark, "history"))
    s.add(rows, author="ann")
    s.update(rows.where("o = '1'").withColumn("o", F.lit("4")), author="bob")
    got = s.query_df("{id, region, 'who': getTransactionAuthor(region), 'rev': getTransactionId(region)}")
    return got.select(F.col("id").alias("n_name"), F.get("region", 0)["s"].alias("region"), F.get("who", 0).alias("who"), F.get("rev", 0).alias("rev"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches write different regions; one merges the other's changeset into data that its history never held."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = n.select(F.col("n_name").alias("s"), F.lit("region").alias("p"), F.col("n_regionkey").cast("string").alias("o"), F.lit("L").alias("ot"), F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos"))
    folder = work_dir(spark, "branches")
    a = Store(spark, rows.where("o IN ('0', '1')")).with_history(f"{folder}/a")
    b = Store(spark, rows.limit(0)).with_history(f"{folder}/b", "B")
    a.add(rows.where("o = '2'"))
    b.add(rows.where("o IN ('3', '4')"))
    a.merge(b.history.changeset(b.history.tip))
    return _stored(a)


_QUADS = """SELECT 'customer:' || c_custkey AS s, 'c_name' AS p, c_name AS o, CAST(NULL AS DOUBLE) AS x FROM customer UNION ALL
SELECT 'customer:' || c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'c_acctbal', NULL, c_acctbal FROM customer"""
_C = """c AS (SELECT 'customer:' || c_custkey AS s, c_name, c_acctbal, c_mktsegment FROM customer)"""
_E = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS s, event_type AS o, event_id // {EVENTS_A_REVISION} AS n, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events),
g AS (SELECT s, o, n, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0)"""

#: Query and SQL by name.
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "crud_add": (_add, f"WITH {_C} SELECT s, 'c_mktsegment' AS p, c_mktsegment AS o FROM c UNION ALL SELECT s, 'c_mktsegment', 'HOUSES' FROM c WHERE c_mktsegment = 'BUILDING'"),
    "crud_replace": (_replace, f"WITH {_C}, q AS (SELECT s, unnest(CASE WHEN c_mktsegment = 'MACHINERY' THEN ['c_class'] ELSE ['c_name', 'c_acctbal', 'c_mktsegment'] END) AS p FROM c) SELECT p, count(*) AS n, count(DISTINCT s) AS objects FROM q GROUP BY p"),
    "crud_remove": (_remove, f"WITH {_C}, q AS (SELECT s, unnest(CASE WHEN c_mktsegment = 'FURNITURE' THEN ['c_name', 'c_mktsegment'] ELSE ['c_name', 'c_acctbal', 'c_mktsegment'] END) AS p FROM c) SELECT p, count(*) AS n FROM q GROUP BY p"),
    "maybe_property": (_maybe, "SELECT c_name, CASE WHEN c_mktsegment < 'C' THEN c_mktsegment END AS segment, 'maybe' AS form FROM customer UNION ALL SELECT c_name, c_mktsegment, 'must' FROM customer WHERE c_mktsegment < 'C'"),
    "ntriples_round_trip": (_round_trip("ntriples", "nt"), _QUADS),
    "ntjson_round_trip": (_round_trip("ntjson", "ntjson"), _QUADS),
    "history_as_of": (_as_of, f"WITH {_E} SELECT s, o FROM g WHERE n <= 8 GROUP BY s, o HAVING arg_max(d, n) > 0"),
    "history_changes_after": (_changes_after, f"WITH {_E} SELECT s, o, CASE WHEN arg_max(d, n) > 0 THEN 'add' ELSE 'del' END AS op FROM g WHERE n > 8 GROUP BY s, o"),
    "history_modified_after": (_modified_after, f"WITH {_E} SELECT DISTINCT s FROM e WHERE n > 18"),
    "history_last_revision": (_last_revision, f"WITH {_E} SELECT s, o, 'A' || lpad(CAST(max(n) AS VARCHAR), 8, '0') AS rev FROM e GROUP BY s, o"),
    "revision_functions": (_authors, "SELECT n_name, CASE WHEN n_regionkey = 1 THEN '4' ELSE CAST(n_regionkey AS VARCHAR) END AS region, CASE WHEN n_regionkey = 1 THEN 'bob' ELSE 'ann' END AS who, CASE WHEN n_regionkey = 1 THEN 'A00002' ELSE 'A00001' END AS rev FROM nation"),
    "merge_changeset": (_merge, "SELECT n_name AS s, 'region' AS p, CAST(n_regionkey AS VARCHAR) AS o FROM nation"),
}
