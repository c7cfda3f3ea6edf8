"""Registered queries of the language's smaller parts, of inference and of list data, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import REF
from ..operators import inference, sets
from ..sources import formats
from ..sources.files import work_dir
from ..store import Store
from .catalogue import ask, customer_quads, joined_list, nation_classes, store


def _no_list() -> Column:
    return F.lit(None).cast("array<int>").alias("listpos")


def quads_of(df: DataFrame, s: str, p: str, o: str, ot: str = "L") -> DataFrame:
    """Statements by three SQL expressions."""
    return df.select(F.expr(s).cast("string").alias("s"), F.expr(p).alias("p"), F.expr(o).cast("string").alias("o"), F.lit(ot).alias("ot"), F.lit("").alias("c"), _no_list())


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days with many values of one property: the types of the events, each once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL")
    return quads_of(e, "concat(user_id, '/', date(ts))", "'did'", "event_type").dropDuplicates(sets.QUAD)


def _forms(spark: SparkSession, sf_dir: str, forms: dict[str, str]) -> DataFrame:
    """The ids that each of several conditions finds in the segments of customers below 'C'."""
    q = customer_quads(spark, sf_dir).where("p = 'c_name' OR (p = 'c_mktsegment' AND o < 'C')")
    s = Store(spark, q)
    found = [s.query_df(f"{{id where {cond}}}").select("id", F.lit(name).alias("form")) for name, cond in forms.items()]
    return found[0].unionByName(found[1])


def _existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, {"has": "c_name and c_mktsegment", "lacks": "c_name and not c_mktsegment"})


def _many_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a property with many values keeps the objects that have such a value, and of the property those values."""
    df = Store(spark, user_events(spark, sf_dir)).query_df("{id, did where did in ('purchase', 'view')}")
    return df.select("id", F.array_join(F.array_sort(F.transform("did", lambda v: v["s"])), ",").alias("did"))


def _many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression over a property with many values has one value for each."""
    df = Store(spark, user_events(spark, sf_dir)).query_df("{id, 'loud': upper(did)}")
    return df.select("id", F.array_join(F.array_sort(F.col("loud")), ",").alias("loud"))


def _group_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object counts in the group of each of its values."""
    df = Store(spark, user_events(spark, sf_dir)).query_df("{did, 'n': count(*) group by did}")
    return df.select(F.col("did")["s"].alias("did"), "n")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and literals told apart in one property."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    q = quads_of(n.where("n_regionkey < 2"), "n_name", "'of'", "n_regionkey", REF).unionByName(quads_of(n.where("n_regionkey >= 2"), "n_name", "'of'", "n_regionkey"))
    df = Store(spark, q).query_df("{id, 'r': isref(of), 'b': isbnode(of)}")
    return df.select("id", *[F.get(c, 0).alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in ("r", "b")])


def _nested_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation with its rich customers as a nested list; nations without any are no result."""
    df = store(spark, sf_dir, "nation", "customer").query_df("{?n n_name, 'rich': [{c_name where c_nationkey = ?n and c_acctbal > 9000}]}")
    return df.select("n_name", F.array_join(F.array_sort(F.col("rich.c_name")), ",").alias("rich"))


def _named_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = store(spark, sf_dir, "region").query_df("{'x': *, 'n': r_name where type = 'region'}")
    return df.select(F.col("n"), F.col("x.r_regionkey").alias("k"))


def _rdfjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark, 'formats')}/customers.rj"
    formats.write_rdfjson(customer_quads(spark, sf_dir)).write.text(path)
    raw = spark.read.text(path)
    number = F.when(F.col("p") == "c_acctbal", F.col("o").cast("double"))
    got = formats.rdfjson_quads(raw)
    return got.select("s", "p", F.when(number.isNull(), F.col("o")).alias("o"), number.alias("x"))


def _create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New objects beside old ones; ids that exist are refused, which the last column tells."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    s = Store(spark, quads_of(n.where("n_regionkey < 3"), "n_name", "'region'", "n_regionkey"))
    fresh = quads_of(n.where("n_regionkey >= 3"), "n_name", "'region'", "n_regionkey")
    s.create(fresh)
    try:
        s.create(fresh)
        refused = False
    except ValueError:
        refused = True
    return s.quads.select("s", "o", F.lit(refused).alias("refused"))


def _update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write that updates a property of some nations and removes others."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    q = quads_of(n, "n_name", "'region'", "n_regionkey")
    s = Store(spark, q)
    s.update_all(update=q.where("o = '1'").withColumn("o", F.lit("one")), removed=q.where("o = '2'"))
    return s.quads.select("s", "o")


def _subproperty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two properties below a third: its statements follow."""
    quads = customer_quads(spark, sf_dir)
    below = spark.createDataFrame([("c_name", inference.SUBPROPERTY, "label"), ("c_mktsegment", inference.SUBPROPERTY, "label"), ("label", inference.SUBPROPERTY, "note")], "s string, p string, o string")
    got = inference.expand_properties(quads.unionByName(below.select("s", "p", "o", F.lit(REF).alias("ot"), F.lit("").alias("c"), _no_list())))
    return got.where("p IN ('label', 'note')").select("s", "p", "o")


def _entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that follow from the domain and the range of one property, and through a superclass."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lives = quads_of(c, "concat('customer:', c_custkey)", "'lives'", "concat('nation:', c_nationkey)", REF)
    schema = spark.createDataFrame([("lives", inference.DOMAIN, "Person"), ("lives", inference.RANGE, "Country"), ("Person", inference.SUBCLASS, "Agent")], "s string, p string, o string")
    got = inference.entail(lives.unionByName(schema.select("s", "p", "o", F.lit(REF).alias("ot"), F.lit("").alias("c"), _no_list())))
    return got.where("o IN ('Person', 'Country', 'Agent')").select("s", F.col("o").alias("type"))


def _compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.compatible(nation_classes(spark, sf_dir), "region:1")


def _reified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the statements about one nation's region, among statements about all."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sid, rdf = "concat('about:', n_nationkey)", inference.RDF
    about = quads_of(n, sid, f"'{rdf}subject'", "n_name").unionByName(quads_of(n, sid, f"'{rdf}predicate'", "'region'")).unionByName(quads_of(n, sid, f"'{rdf}object'", "n_regionkey"))
    return sets.reifications(about, "NATION_5", "region", "0").unionByName(sets.reifications(about, "NATION_7", "region", "2"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as one ordered list property, read back in list order."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn IS NOT NULL AND role IS NOT NULL").groupBy("conv_id", "role").agg(F.sort_array(F.collect_set(F.col("turn").cast("int"))).alias("listpos"))
    q = t.select(F.col("conv_id").cast("string").alias("s"), F.lit("roles").alias("p"), F.col("role").alias("o"), F.lit("L").alias("ot"), F.lit("").alias("c"), "listpos")
    return sets.ordered(q).select(F.col("s").alias("conv"), F.array_join(F.transform("values", lambda v: v["o"]), ",").alias("roles"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of object and type, and one that sees a statement once whatever its contexts."""
    q = customer_quads(spark, sf_dir)
    twice = q.unionByName(q.withColumn("c", F.lit("other")))
    one = sets.scan(twice, predicate="c_mktsegment", obj="BUILDING", objecttype="L", as_quad=False).select("s", F.lit("triple").alias("form"))
    return one.unionByName(sets.scan(twice, predicate="c_mktsegment", obj="BUILDING").select("s", F.lit("quad").alias("form")))


_USERS = "u AS (SELECT DISTINCT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS id, event_type AS did FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)"
_ALL = """SELECT 'customer:' || c_custkey AS s, 'c_name' AS p, c_name AS o, CAST(NULL AS DOUBLE) AS x FROM customer UNION ALL
SELECT 'customer:' || c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'c_acctbal', NULL, c_acctbal FROM customer"""

#: Query and SQL by name.
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "unary_signs": (ask("customer", '{c_custkey, "neg": -c_acctbal, "pos": +c_acctbal}'), "SELECT c_custkey, -c_acctbal AS neg, c_acctbal AS pos FROM customer"),
    "add_div": (ask("lineitem", '{l_orderkey, "a": l_quantity + l_linenumber, "d": l_extendedprice / l_quantity}'), "SELECT l_orderkey, l_quantity + l_linenumber AS a, l_extendedprice / l_quantity AS d FROM lineitem"),
    "bool_func": (ask("part", '{p_partkey, "b": bool(p_size - 7), "t": bool(p_brand), "e": bool(\'\')}'), "SELECT p_partkey, p_size <> 7 AS b, p_brand <> '' AS t, false AS e FROM part"),
    "number_parse": (ask("part", "{p_partkey, \"n\": number(ltrim(p_brand, 'Brand#')), \"m\": number(p_name)}"), "SELECT p_partkey, CAST(ltrim(p_brand, 'Brand#') AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS m FROM part"),
    "ltrim_func": (ask("part", "{p_partkey, \"t\": ltrim(p_type, 'AEIOUPSL'), \"u\": ltrim(p_name)}"), "SELECT p_partkey, ltrim(p_type, 'AEIOUPSL') AS t, ltrim(p_name) AS u FROM part"),
    "two_property_predicate": (ask("lineitem", "{l_orderkey, l_linenumber where l_quantity < l_linenumber * 3 and l_partkey > l_suppkey}"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber * 3 AND l_partkey > l_suppkey"),
    "constant_predicate": (ask("nation", "{n_name where 1 = 1 and n_regionkey > 1}"), "SELECT n_name FROM nation WHERE n_regionkey > 1"),
    "in_expression": (ask("lineitem", "{l_orderkey where l_linenumber + 1 in (l_quantity, 3)}"), "SELECT l_orderkey FROM lineitem WHERE l_linenumber + 1 IN (l_quantity, 3)"),
    "group_expression": (joined_list("nation", "{n_regionkey, 'low': lower(n_name) group by n_regionkey}", "n_regionkey", "low", "low"), "SELECT n_regionkey, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS low FROM nation GROUP BY 1"),
    "group_join": (ask("customer nation", '{?n n_name, "n": count(?c.c_name), "top": max(?c.c_acctbal) where ?c.c_nationkey = ?n.n_nationkey group by n_name}'), "SELECT n_name, count(*) AS n, max(c_acctbal) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "order_by_label": (ask("customer nation", '{?c c_custkey, "nation": ?n.n_name where c_nationkey = ?n.n_nationkey order by ?n.n_name desc, c_custkey limit 40}'), "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC, c_custkey LIMIT 40"),
    "filter_set_join": (ask("customer supplier", "{?c c_custkey, 'bal': ?s.s_acctbal where c_nationkey = ?s.s_nationkey and {?s s_acctbal > 9000} and c_acctbal > 5000}"), "SELECT c_custkey, s_acctbal AS bal FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 9000 AND c_acctbal > 5000"),
    "outer_property": (ask("orders customer", '{?c c_custkey, "p": ?o.o_totalprice where maybe c_custkey = ?o.o_custkey and {?o o_totalprice > 480000}}'), "SELECT c_custkey, o_totalprice AS p FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c_custkey = o_custkey"),
    "path_predicate": (ask("customer nation region", "{c_name where c_nationkey.n_regionkey.r_name = 'ASIA' and c_acctbal < 0}"), "SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal < 0"),
    "property_existence": (_existence, "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_mktsegment < 'C' THEN 'has' ELSE 'lacks' END AS form FROM customer"),
    "many_value_filter": (_many_filter, f"WITH {_USERS} SELECT id, string_agg(did, ',' ORDER BY did) AS did FROM u WHERE did IN ('purchase', 'view') GROUP BY id"),
    "many_value_expression": (_many_values, f"WITH {_USERS} SELECT id, string_agg(upper(did), ',' ORDER BY upper(did)) AS loud FROM u GROUP BY id"),
    "group_many_values": (_group_many, f"WITH {_USERS} SELECT did, count(*) AS n FROM u GROUP BY did"),
    "reference_kinds": (_kinds, "SELECT n_name AS id, n_regionkey < 2 AS r, false AS b FROM nation"),
    "nested_filtered": (_nested_filtered, "SELECT n_name, string_agg(c_name, ',' ORDER BY c_name) AS rich FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1"),
    "named_wildcard": (_named_wildcard, "SELECT r_name AS n, r_regionkey AS k FROM region"),
    "rdfjson_round_trip": (_rdfjson, _ALL),
    "crud_create": (_create, "SELECT n_name AS s, CAST(n_regionkey AS VARCHAR) AS o, true AS refused FROM nation"),
    "crud_update_all": (_update_all, "SELECT n_name AS s, CASE WHEN n_regionkey = 1 THEN 'one' ELSE CAST(n_regionkey AS VARCHAR) END AS o FROM nation WHERE n_regionkey <> 2"),
    "subproperty_expansion": (_subproperty, "SELECT 'customer:' || c_custkey AS s, p, o FROM (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS o FROM customer), (VALUES ('label'), ('note')) v(p)"),
    "domain_range_types": (_entailment, "SELECT 'customer:' || c_custkey AS s, t AS type FROM customer, (VALUES ('Person'), ('Agent')) v(t) UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 'Country' FROM customer"),
    "compatible_types": (_compatible, "SELECT 'nation:' || n_nationkey AS t FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region:1'"),
    "reification_lookup": (_reified, "SELECT 'about:' || n_nationkey AS id FROM nation WHERE (n_name = 'NATION_5' AND n_regionkey = 0) OR (n_name = 'NATION_7' AND n_regionkey = 2)"),
    "ordered_values": (_ordered, "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE turn IS NOT NULL AND role IS NOT NULL GROUP BY ALL) SELECT CAST(conv_id AS VARCHAR) AS conv, string_agg(role, ',' ORDER BY t, role) AS roles FROM f GROUP BY conv_id"),
    "positional_scan": (_positions, "SELECT 'customer:' || c_custkey AS s, form FROM customer, (VALUES ('triple'), ('quad'), ('quad')) v(form) WHERE c_mktsegment = 'BUILDING'"),
}
