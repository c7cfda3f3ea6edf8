"""The registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import inference, sets
from ..operators.graph import components, transitive_closure
from ..store import Store

#: Id column of each table, and references between tables.
IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
REFERENCES = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def store(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    """The named driver tables as entity tables; only these are opened."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or TABLES}
    return Store.from_tables(spark, frames, IDS, REFERENCES)


def ask(tables: str, query: str, binds: dict | None = None, names: list[str] | None = None, casts: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the language as a registered query; ``names`` renames result columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = store(spark, sf_dir, *tables.split()).query_df(query, binds)
        if names:
            df = df.toDF(*names)
        for c, kind in (casts or {}).items():
            df = df.withColumn(c, F.col(c).cast(kind))
        return df

    return run


def joined_list(tables: str, query: str, key: str, items: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose list column becomes one sorted text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = store(spark, sf_dir, *tables.split()).query_df(query)
        return df.select(key, F.array_join(F.array_sort(F.col(items)), ",").alias(name))

    return run


def _mergeall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = store(spark, sf_dir, "nation").query_df("{n_name : n_regionkey MERGEALL}")
    entries = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.select(F.array_join(entries, ",").alias("merged"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as quads: each refers to the turn before it."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    name = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    prev = t.select("conv_id", (F.col("turn") + 1).alias("turn"))
    return t.join(prev, ["conv_id", "turn"]).select(name(F.col("turn")).alias("s"), F.lit("reply_to").alias("p"), name(F.col("turn") - 1).alias("o"), F.lit("R").alias("ot"), F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos"))


def _follow(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Store(spark, turns(spark, sf_dir)).query_df(query)
        return df.select("id", F.explode("reached").alias("node"))

    return run


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitive_closure(turns(spark, sf_dir).select(F.col("s").alias("src"), F.col("o").alias("dst")))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(turns(spark, sf_dir).select(F.col("s").alias("src"), F.col("o").alias("dst")))


def customer_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table in the quads layout."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    double, text = "http://www.w3.org/2001/XMLSchema#double", "L"
    pairs = F.array(F.struct(F.lit("c_name").alias("p"), F.col("c_name").alias("o"), F.lit(text).alias("ot")), F.struct(F.lit("c_acctbal").alias("p"), F.col("c_acctbal").cast("string").alias("o"), F.lit(double).alias("ot")), F.struct(F.lit("c_mktsegment").alias("p"), F.col("c_mktsegment").alias("o"), F.lit(text).alias("ot")))
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o", "x.ot", F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos"))


def _quads_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Store(spark, customer_quads(spark, sf_dir)).query_df("{c_name, c_acctbal where c_mktsegment = 'BUILDING' and c_acctbal > 5000}")
    return df.select(F.col("c_name")[0]["s"].alias("c_name"), F.col("c_acctbal")[0]["n"].alias("c_acctbal"))


def _quads_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Store(spark, customer_quads(spark, sf_dir)).query_df("{c_mktsegment, 'n': count(*), 'top': max(c_acctbal) group by c_mktsegment}")
    return df.select(F.col("c_mktsegment")["s"].alias("c_mktsegment"), "n", F.col("top")["n"].alias("top"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log made of events: of a user and a type, even event ids add and odd ones remove."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "event_type", F.col("event_id").alias("rev"), F.when(F.col("event_id") % 2 == 0, "add").otherwise("del").alias("op"))


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.as_of(event_changes(spark, sf_dir), 5000, ["user_id", "event_type"])


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return sets.difference(o.where("o_totalprice > 100000").select("o_custkey", "o_orderpriority").distinct(), o.where("o_totalprice < 200000").select("o_custkey", "o_orderpriority").distinct())


def _json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    typed = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")
    return Store.from_tables(spark, {"events": typed}, {"events": "event_id"}).query_df("{event_id, k where k > 50}")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.scan(customer_quads(spark, sf_dir), predicate="c_mktsegment", obj="BUILDING").select("s", "p", "o")


def _union_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = customer_quads(spark, sf_dir)
    return sets.union(q.where("p = 'c_name'"), q.where("p = 'c_name' OR p = 'c_mktsegment'")).groupBy("p").agg(F.count("*").alias("n"))


def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment move to another, through the write path."""
    s = Store(spark, customer_quads(spark, sf_dir))
    moved = s.quads.where("p = 'c_mktsegment' AND o = 'BUILDING'").withColumn("o", F.lit("CONSTRUCTION"))
    s.update(moved)
    return s.query_df("{c_mktsegment, 'n': count(*) group by c_mktsegment}").select(F.col("c_mktsegment")["s"].alias("c_mktsegment"), "n")


def _nest_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_name")
    return sets.unnest(sets.nest(n, ["n_regionkey"]))


def _udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir, "part")
    s.register_function("my:half", build=lambda x: x / 2)
    return s.query_df("{p_partkey, 'half': <my:half>(p_size)}")


def _udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir, "nation")
    s.register_fold("sumsq", 0.0, lambda a, x: a + x * x)
    return s.query_df("{n_regionkey, 'ss': sumsq(n_nationkey) group by n_regionkey}")


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.uri_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.authority", "u.path", "u.query", "u.fragment")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.groupBy(text.root_element(F.col("html")).alias("root")).agg(F.count("*").alias("n"))


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.sanitize_whitelist("html").alias("clean"), text.truncate_html("html", 20).alias("start"))


def _excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return d.select("item_id", text.truncate_text(F.col("text"), lines=1).alias("line"))


def nation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as classes below their region's class, customers as their instances."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = lambda tag, col: F.concat(F.lit(tag), F.col(col).cast("string"))
    rest = [F.lit("R").alias("ot"), F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos")]
    below = n.select(name("nation:", "n_nationkey").alias("s"), F.lit(inference.SUBCLASS).alias("p"), name("region:", "n_regionkey").alias("o"), *rest)
    return below.unionByName(c.select(name("customer:", "c_custkey").alias("s"), F.lit(inference.TYPE).alias("p"), name("nation:", "c_nationkey").alias("o"), *rest))


def _subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = inference.expand_types(nation_classes(spark, sf_dir))
    return q.where(F.col("p") == inference.TYPE).groupBy(F.col("o").alias("type")).agg(F.count("*").alias("n"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "object_construct": (ask("customer", "{c_name, c_acctbal}"), "SELECT c_name, c_acctbal FROM customer"),
    "building_customers": (ask("customer", "{c_name, c_acctbal where c_mktsegment = 'BUILDING' and c_acctbal > 5000}"), "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "array_construct": (ask("nation", "[n_name, n_regionkey]"), "SELECT n_name AS _1, n_regionkey AS _2 FROM nation"),
    "value_construct": (ask("region", "(r_name)"), "SELECT r_name AS value FROM region"),
    "alias": (ask("customer", '{"segment": c_mktsegment, "who": c_name}'), "SELECT c_mktsegment AS segment, c_name AS who FROM customer"),
    "wildcard": (ask("region nation", "{* where type = 'nation'}"), "SELECT *, n_nationkey AS id FROM nation"),
    "typed_eq": (ask("orders", "{o_orderkey where o_orderstatus = 'F'}"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "not_eq": (ask("orders", "{o_orderkey where o_orderstatus != 'F'}"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "compare": (ask("lineitem", "{l_orderkey, l_quantity where l_quantity >= 45}"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45"),
    "and_filter": (ask("lineitem", "{l_orderkey, l_partkey where l_quantity < 5 and l_returnflag = 'R'}"), "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'"),
    "or_filter": (ask("orders", "{o_orderkey where o_orderstatus = 'F' or o_totalprice > 300000}"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000"),
    "not_group": (ask("orders", "{o_orderkey where not (o_orderstatus = 'F' and o_totalprice > 100000)}"), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)"),
    "in_list": (ask("nation", "{n_name where n_nationkey in (1, 2, 3)}"), "SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3)"),
    "not_in_list": (ask("nation", "{n_name where n_nationkey not in (1, 2, 3)}"), "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)"),
    "bindvar": (ask("part", "{p_partkey where p_size = :size}", {"size": 7}), "SELECT p_partkey FROM part WHERE p_size = 7"),
    "bindvar_list": (ask("part", "{p_partkey where p_size in (:sizes)}", {"sizes": [1, 5, 9]}), "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)"),
    "arithmetic": (ask("lineitem", '{l_orderkey, "rev": l_extendedprice * (1 - l_discount)}'), "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS rev FROM lineitem"),
    "modulo_sign": (ask("customer", '{c_custkey, "m": (c_custkey - 75) % 7, "k": (c_custkey - 75) % -7}'), "SELECT c_custkey, CAST(c_custkey - 75 AS DOUBLE) - 7.0 * floor((c_custkey - 75) / 7.0) AS m, CAST(c_custkey - 75 AS DOUBLE) + 7.0 * floor((c_custkey - 75) / -7.0) AS k FROM customer"),
    "string_funcs": (ask("part", "{\"u\": upper(p_name), \"l\": lower(p_brand), \"t\": trim(p_type, 'AEIOUaeiou'), \"r\": rtrim(p_brand, '0123456789#')}"), "SELECT upper(p_name) AS u, lower(p_brand) AS l, trim(p_type, 'AEIOUaeiou') AS t, rtrim(p_brand, '0123456789#') AS r FROM part"),
    "number_cast": (ask("part", '{p_partkey, "n": number(p_brand), "s": string(p_size)}'), "SELECT p_partkey, CAST(0.0 AS DOUBLE) AS n, CAST(p_size AS VARCHAR) AS s FROM part"),
    "if_func": (ask("lineitem", "{l_orderkey, \"big\": if(l_quantity > 25, 'y', 'n')}"), "SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 'y' ELSE 'n' END AS big FROM lineitem"),
    "order_asc_desc": (ask("orders", "{o_orderkey, o_orderpriority, o_totalprice order by o_orderpriority asc, o_totalprice desc, o_orderkey limit 50}"), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50"),
    "offset_limit": (ask("customer", "{c_custkey, c_name order by c_custkey limit 20 offset 30}"), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30"),
    "null_semantics": (ask("region", "[null=null, null!=null, null=0, null='', null > 0, null < 0]"), "SELECT true AS _1, false AS _2, false AS _3, false AS _4, false AS _5, true AS _6"),
    "omit_force": (lambda spark, d: store(spark, d, "nation").query_df("{n_name, [maybe n_regionkey]}").select("n_name", F.array_join(F.array(F.col("n_regionkey").cast("string")), ",").alias("regions")), "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS regions FROM nation"),
    "group_count": (ask("orders", '{o_orderstatus, "n": count(*) group by o_orderstatus}'), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "group_sum_min_max": (ask("lineitem", '{l_returnflag, "s": sum(l_quantity), "lo": min(l_extendedprice), "hi": max(l_extendedprice) group by l_returnflag}'), "SELECT l_returnflag, sum(l_quantity) AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1"),
    "group_avg": (ask("lineitem", '{l_linestatus, "a": avg(l_quantity) group by l_linestatus}'), "SELECT l_linestatus, avg(l_quantity) AS a FROM lineitem GROUP BY 1"),
    "group_collect": (joined_list("nation", "{n_regionkey, n_name group by n_regionkey}", "n_regionkey", "n_name", "names"), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "group_expr_agg": (ask("customer", '{c_mktsegment, "spread": max(c_acctbal) - min(c_acctbal) group by c_mktsegment}'), "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1"),
    "group_order_limit": (ask("orders", '{o_custkey, "n": count(*) group by o_custkey order by o_custkey desc limit 10}'), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 10"),
    "conditional_agg": (ask("lineitem", "{l_linestatus, \"r\": sum(if(l_returnflag == 'R', l_quantity, 0)) group by l_linestatus}"), "SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1"),
    "global_agg": (ask("lineitem", "[count(*), sum(l_quantity), avg(l_quantity), min(l_discount), max(l_tax)]"), "SELECT count(*) AS _1, sum(l_quantity) AS _2, avg(l_quantity) AS _3, min(l_discount) AS _4, max(l_tax) AS _5 FROM lineitem"),
    "global_agg_columns": (ask("nation", '{n_name, "total": count(n_name)}'), "SELECT n_name, count(n_name) OVER () AS total FROM nation"),
    "total_empty": (ask("part", '{"t": total(p_size), "a": avg(p_size), "n": count(p_size) where p_size > 100000}'), "SELECT CAST(0 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS a, CAST(0 AS BIGINT) AS n"),
    "count_nonnull": (ask("events", '{event_type, "n": count(value), "rows": count(*) group by event_type}'), "SELECT event_type, count(value) AS n, count(*) AS rows FROM events GROUP BY 1"),
    "equi_join": (ask("orders customer", '{?o o_orderkey, "cust": ?c.c_name where ?o.o_custkey = ?c.c_custkey}'), "SELECT o_orderkey, c_name AS cust FROM orders JOIN customer ON o_custkey = c_custkey"),
    "three_way_join": (ask("customer nation region", '{?c c_name, "nation": ?n.n_name, "region": ?r.r_name where c_nationkey = ?n.n_nationkey and ?n.n_regionkey = ?r.r_regionkey}'), "SELECT c_name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "multi_condition_join": (ask("customer supplier", '{?c c_custkey, "s": ?s.s_suppkey where ?c.c_nationkey = ?s.s_nationkey and ?c.c_acctbal < ?s.s_acctbal}'), "SELECT c_custkey, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal"),
    "left_join": (ask("orders customer", '{?c c_custkey, "order": string(?o.o_orderkey) where maybe c_custkey = ?o.o_custkey and {?o o_totalprice > 400000}}'), "SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS \"order\" FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey"),
    "anti_join": ((lambda spark, d: _semi(spark, d, "not in")), "SELECT c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "semi_join": ((lambda spark, d: _semi(spark, d, "in")), "SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "semi_join_ids": (ask("orders customer", "{o_orderkey where o_custkey in {c_mktsegment = 'BUILDING' and c_acctbal > 9000}}"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"),
    "anti_join_ids": (ask("orders customer", "{o_orderkey where o_custkey not in {c_acctbal > 0}}"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "cross_join": (lambda spark, d: store(spark, d, "region", "nation").query_df("{r_name, 'all': ?n.n_name}").select("r_name", F.size("all").alias("n")), "SELECT r_name, CAST((SELECT count(*) FROM nation) AS INT) AS n FROM region"),
    "theta_join": (ask("customer supplier", '{?c c_custkey, "s": ?s.s_suppkey where ?c.c_acctbal + 10000 < ?s.s_acctbal}'), "SELECT c_custkey, s_suppkey AS s FROM customer JOIN supplier ON c_acctbal + 10000 < s_acctbal"),
    "computed_key_join": (ask("region nation", '{?n n_name, "next": ?r.r_name where ?n.n_regionkey + 1 = ?r.r_regionkey}'), "SELECT n_name, r_name AS next FROM nation JOIN region ON n_regionkey + 1 = r_regionkey"),
    "alias_labels": (ask("part", "{?a p_partkey, \"brand\": ?b.p_brand where ?a = ?b and ?b.p_size < 10}"), "SELECT p_partkey, p_brand AS brand FROM part WHERE p_size < 10"),
    "nested_construct": (lambda spark, d: store(spark, d, "region", "nation").query_df("{?r r_name, 'nations': [{n_name where n_regionkey = ?r}]}").select("r_name", F.array_join(F.array_sort(F.col("nations.n_name")), ",").alias("nations")), "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "path_reference": (ask("customer nation region", '{c_name, "region": c_nationkey.n_regionkey.r_name}'), "SELECT c_name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "mergeall": (_mergeall, "SELECT string_agg(x, ',' ORDER BY x) AS merged FROM (SELECT n_name || '=' || n_regionkey AS x FROM nation)"),
    "follow_conversation": (_follow("{id, 'reached': follow(id, reply_to)}"), "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || ':' || a.turn AS s, b.conv_id || ':' || b.turn AS o FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT * FROM (WITH RECURSIVE r(id, node) AS (SELECT s, s FROM e UNION SELECT r.id, e.o FROM r JOIN e ON r.node = e.s) SELECT id, node FROM r)"),
    "rfollow_conversation": (_follow("{id, 'reached': rfollow(id, reply_to, true)}"), "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || ':' || a.turn AS s, b.conv_id || ':' || b.turn AS o FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT * FROM (WITH RECURSIVE r(id, node) AS (SELECT s, s FROM e UNION SELECT r.id, e.s FROM r JOIN e ON r.node = e.o) SELECT id, node FROM r WHERE id <> node)"),
    "leaf_follow": (_follow("{id, 'reached': follow(id, reply_to, true, true)}"), "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || ':' || a.turn AS s, b.conv_id || ':' || b.turn AS o FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT * FROM (WITH RECURSIVE r(id, node) AS (SELECT s, s FROM e UNION SELECT r.id, e.o FROM r JOIN e ON r.node = e.s) SELECT id, node FROM r WHERE id <> node AND node NOT IN (SELECT s FROM e))"),
    "transitive_closure": (_closure, "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || ':' || a.turn AS s, b.conv_id || ':' || b.turn AS o FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT * FROM (WITH RECURSIVE r(src, dst) AS (SELECT s, o FROM e UNION SELECT r.src, e.o FROM r JOIN e ON r.dst = e.s) SELECT src, dst FROM r)"),
    "graph_components": (_components, "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || ':' || a.turn AS s, b.conv_id || ':' || b.turn AS o FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1), u AS (SELECT s, o FROM e UNION SELECT o, s FROM e) SELECT node, min(c) AS comp FROM (WITH RECURSIVE r(node, c) AS (SELECT s, s FROM u UNION SELECT u.o, r.c FROM r JOIN u ON r.node = u.s) SELECT node, c FROM r) GROUP BY node"),
    "quads_pivot": (_quads_pivot, "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "quads_group": (_quads_group, "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1"),
    "quad_scan": (_scan, "SELECT 'customer:' || c_custkey AS s, 'c_mktsegment' AS p, c_mktsegment AS o FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "union_stores": (_union_stores, "SELECT p, (SELECT count(*) FROM customer) AS n FROM (VALUES ('c_name'), ('c_mktsegment')) v(p)"),
    "update_quads": (_update, "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "as_of_revision": (_as_of, "SELECT user_id, event_type FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events WHERE event_id <= 5000) WHERE k = 1 AND event_id % 2 = 0"),
    "diff_sets": (_diff, "WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice < 200000) SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    "json_props": (_json_props, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50"),
    "subclass_expansion": (_subclass, "SELECT type, count(*) AS n FROM (SELECT 'nation:' || c_nationkey AS type FROM customer UNION ALL SELECT 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1"),
    "uri_parts": (_uris, r"SELECT page_id, regexp_extract(url, '^([^:/?#]+):', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN regexp_matches(url, '^[^?#]*\?') THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)', 1) END AS fragment FROM pages".replace("\\\\", "\\")),
    "root_elements": (_roots, "SELECT 'html' AS root, count(*) AS n FROM pages"),
    "sanitized_pages": (_sanitized, None),
    "first_lines": (_excerpt, "SELECT item_id, split_part(text, chr(10), 1) AS line FROM benchmark"),
    "nest_unnest": (_nest_unnest, "SELECT n_regionkey, n_name FROM nation"),
    "scalar_udf": (_udf, "SELECT p_partkey, p_size / 2.0 AS half FROM part"),
    "aggregate_udf": (_udaf, "SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS DOUBLE) AS ss FROM nation GROUP BY 1"),
}


def _semi(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    """Customers by the keys of their large orders: the orders are seen as objects with the customer's id."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice")
    s = Store.from_tables(spark, {"customer": c, "orders": o}, {"customer": "c_custkey", "orders": "o_custkey"})
    return s.query_df(f"{{c_name where c_custkey {op} {{o_totalprice > 450000}}}}")
