"""HTML, URI and quad utilities."""

from pyspark.sql import functions as F

from jsonlake.functions import text
from jsonlake.operators import isomorphism, sets
from jsonlake.sources.docjson import QUADS
from jsonlake.store import Store


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(make(df).alias("y")).first().y


def test_html(spark):
    page = '<div onclick="x()"><script>bad()</script><a href="javascript:1">l</a><p title="t">one <b>two three</b> four</p><br>&amp;</div>'
    assert one(spark, page, lambda df: text.sanitize_blacklist("x")) == '<div><a>l</a><p title="t">one <b>two three</b> four</p><br>&amp;</div>'
    assert one(spark, page, lambda df: text.sanitize_whitelist("x")) == '<a>l</a><p title="t">one <b>two three</b> four</p><br>&amp;'
    assert one(spark, "<p>one <b>two three</b> four</p>", lambda df: text.truncate_html("x", 2)) == "<p>one <b>two </b></p>"
    assert one(spark, '<a href="b?c#d">x</a>', lambda df: text.rewrite_links("x", "http://h/a/")) == '<a href="http://h/a/b?c#d">x</a>'
    assert one(spark, None, lambda df: text.sanitize_whitelist("x")) is None
    assert one(spark, "<?xml v?><!-- c --><!DOCTYPE html>\n<html a='b'>", lambda df: text.root_element(F.col("x"))) == "html"
    assert one(spark, "a b\nc d e\nf", lambda df: text.truncate_text(F.col("x"), words=4, lines=2)) == "a b\nc d "


def test_uris(spark):
    assert tuple(one(spark, "http://h:80/p/q?x=1#f", lambda df: text.uri_parts(F.col("x")))) == ("http", "h:80", "/p/q", "x=1", "f")
    assert tuple(one(spark, "p#", lambda df: text.uri_parts(F.col("x")))) == (None, None, "p", None, "")
    assert one(spark, "HTTP://Host.Example:80?Q#f", lambda df: text.normalize_uri(F.col("x"))) == "http://host.example/?Q"
    assert one(spark, "a b/é", lambda df: text.percent_encode(F.col("x"))) == "a%20b%2F%C3%A9"
    assert one(spark, "a+b%20c", lambda df: text.percent_decode(F.col("x"))) == "a+b c"
    assert one(spark, "../z", lambda df: text.absolutize("x", "http://h/a/b/c")) == "http://h/a/z"
    assert [text.relative_to(u, "http://h/a/b/c") for u in ("http://h/a/z", "http://h/a/b/d?x", "http://o/a", "http://h/a/b/c#f")] == ["../z", "d?x", "http://o/a", "#f"]


def test_isomorphism(spark):
    def make(a, b, last="2"):
        return spark.createDataFrame([("r", "p", a, "R", "", None), (a, "q", b, "R", "", None), (b, "v", last, "L", "", None)], QUADS)

    x = make("bnode:1", "bnode:2")
    assert isomorphism.isomorphic(x, make("bnode:9", "bnode:7"))
    assert not isomorphism.isomorphic(x, make("bnode:9", "bnode:7", "3"))
    assert not isomorphism.isomorphic(x, make("named", "bnode:7"))


def test_reification_and_order(spark):
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    q = spark.createDataFrame([("st", rdf + "subject", "a", "R", "", None), ("st", rdf + "predicate", "b", "R", "", None), ("st", rdf + "object", "c", "L", "", None), ("other", rdf + "subject", "a", "R", "", None)], QUADS)
    assert [r.id for r in sets.reifications(q, "a", "b", "c").collect()] == ["st"]
    q = spark.createDataFrame([("s", "p", "x", "L", "", [2]), ("s", "p", "y", "L", "", [0])], QUADS)
    assert [v.o for v in sets.ordered(q).first()["values"]] == ["y", "x"]


def test_mirror_view_and_dump(spark, tmp_path):
    a, b = Store.from_json(spark, []), Store.from_json(spark, [])
    a.mirror(b)
    a.add([{"id": "1", "x": 1}, {"id": "2", "y": 1}])
    assert sorted(r["id"] for r in b.query("{*}")) == ["1", "2"]
    v = a.view(F.col("p") == "x")
    assert v.query("{*}") == [{"id": "1", "x": 1}]
    v.add({"id": "3", "x": 5})
    assert sorted(r["id"] for r in a.query("{id, x}")) == ["1", "3"]
    a.dump(str(tmp_path / "d.nt"))
    assert Store.open(spark, str(tmp_path / "d.nt")).quads.count() == 3
