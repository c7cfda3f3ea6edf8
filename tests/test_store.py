"""Writes, history, formats, inference."""

import json

import pytest

from jsonlake.operators import inference, sets
from jsonlake.operators.graph import transitive_closure
from jsonlake.sources import formats
from jsonlake.sources.docjson import QUADS, DocError, DocReader, read_json_lines, serialize
from jsonlake.store import Store
from jsonlake.streaming.history import History, MergeConflict, changes_after, format_revision, includes, last_revision, merge_revisions, modified_after, next_revision, parse_revision, revisions_of, subscribe


def by_id(store, query="{*}"):
    return {x["id"]: x for x in store.query(query)}


def test_crud(spark):
    s = Store.from_json(spark, [{"id": "1", "tags": ["a b", "c d"], "o": {"x": 1}}, {"id": "2", "n": 1}])
    s.add({"id": "2", "m": 5})
    assert by_id(s)["2"] == {"id": "2", "n": 1, "m": 5}
    with pytest.raises(ValueError, match="exists"):
        s.create({"id": "2", "z": 1})
    s.create({"id": "3", "z": 1})
    s.update([{"id": "1", "tags": ["new one"], "o": {"x": 2}}, {"id": "2", "n": 7}])
    got = by_id(s)
    assert got["1"] == {"id": "1", "tags": ["new one"], "o": {"x": 2}} and got["2"] == {"id": "2", "n": 7, "m": 5}
    s.replace({"id": "2", "only": True})
    assert by_id(s)["2"] == {"id": "2", "only": True}
    s.remove([{"id": "1", "tags": None}])
    assert by_id(s)["1"] == {"id": "1", "o": {"x": 2}}
    s.remove("1")
    assert sorted(by_id(s)) == ["2", "3"]
    assert s.quads.where("s LIKE 'bnode:%'").count() == 0


def test_update_keeps_the_id_of_an_embedded_object(spark):
    s = Store.from_json(spark, [{"id": "1", "o": {"x": 1}}])
    before = s.query("{*}", for_update=True)[0]["o"]["id"]
    s.update({"id": "1", "o": {"x": 2}})
    assert s.query("{*}", for_update=True)[0]["o"] == {"id": before, "x": 2}


def test_batch_hooks_and_rollback(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "st"))
    seen = []
    for h in ("before-add", "before-commit", "after-commit", "after-abort"):
        s.hooks[h].append(lambda *a, h=h: seen.append(h))
    with s.batch():
        s.add({"id": "1", "a": 1})
        assert by_id(s)["1"]["a"] == 1
        s.update({"id": "1", "a": 2})
    assert seen == ["before-add", "before-add", "before-commit", "after-commit"]
    with pytest.raises(RuntimeError), s.batch():
        s.remove("1")
        raise RuntimeError
    assert by_id(s)["1"] == {"id": "1", "a": 2} and seen[-1] == "after-abort"
    again = Store.open(spark, str(tmp_path / "st"))
    assert by_id(again)["1"] == {"id": "1", "a": 2}


def test_requests(spark):
    s = Store.from_json(spark, [{"id": "1", "a": 1}])
    out = s.handle([{"method": "add", "params": {"id": "2", "a": 3}}, {"method": "query", "params": "{id, a where a = 3}"}, {"method": "nope"}])
    assert out[0]["added"] == 1 and out[1] == [{"id": "2", "a": 3}] and "error" in out[2]


def test_revision_text():
    assert parse_revision("A00001,B00002") == {"A": 1, "B": 2}
    assert next_revision("", "A") == "A00001" and next_revision("A00001,B00002", "B") == "A00001,B00003"
    assert merge_revisions("A00002,B00001", "B00004") == "A00002,B00004" == format_revision({"B": 4, "A": 2})
    assert includes("A00002", "A00001") and not includes("A00002", "B00001")


def test_history_as_of_and_merge(spark, tmp_path):
    a = Store.from_json(spark, []).with_history(str(tmp_path / "a"), "A")
    b = Store.from_json(spark, []).with_history(str(tmp_path / "b"), "B")
    a.add({"id": "1", "x": 1}, author="me", comment="first")
    a.update({"id": "1", "x": 2})
    h = a.history
    assert h.state("A00001").count() == 1 and h.state("A00001").first().o == "1" and h.state().first().o == "2"
    assert [r.s for r in modified_after(h.changes(), h.order(), "A00001").collect()] == ["1"]
    assert sorted(r.rev for r in revisions_of(h.changes(), "1").collect()) == ["A00001", "A00002"]
    assert {r.op for r in changes_after(h.changes(), h.order(), "A00001").collect()} == {"add", "del"}
    assert last_revision(h.changes(), h.order()).where("o = '2'").first().rev == "A00002"
    assert a.query("{'t': getTransactionId(x), 'w': getTransactionComment(x)}") == [{"t": "A00002", "w": ""}]
    # Out of order: the second waits for the first.
    assert b.merge(h.changeset("A00002")) is False and len(b.history.pending) == 1
    assert b.merge(h.changeset("A00001")) is True
    assert by_id(b)["1"] == {"id": "1", "x": 2} and b.history.tip == "A00002"
    b.add({"id": "2", "y": 1})
    a.add({"id": "3", "z": 1})
    assert b.merge(h.changeset(h.tip)) is True  # both moved on, no conflict
    assert sorted(by_id(b)) == ["1", "2", "3"] and parse_revision(b.history.tip) == {"A": 3, "B": 2}
    a.update({"id": "2", "y": 5})
    b.update({"id": "2", "y": 6})
    with pytest.raises(MergeConflict):
        b.merge({**h.changeset(h.tip), "baserevision": "A00003"})
    again = History(spark, str(tmp_path / "a"), "A")
    assert again.tip == h.tip and again.state().count() == h.state().count()


def test_change_stream(spark, tmp_path):
    a = Store.from_json(spark, []).with_history(str(tmp_path / "a"), "A")
    a.add({"id": "1", "x": 1})
    a.add({"id": "2", "x": 2})
    feed = str(tmp_path / "feed")
    for rev in ("A00002", "A00001"):
        a.history.publish(rev, feed)
    target = History(spark, str(tmp_path / "b"), "B")
    subscribe(spark, feed, target, str(tmp_path / "cp"))
    assert target.tip == "A00002" and target.state().count() == 2
    subscribe(spark, feed, target, str(tmp_path / "cp2"))  # known revisions change nothing
    assert target.state().count() == 2


DOCS = [
    [{"id": "1", "a": "text", "b": 1, "c": 1.5, "d": None, "e": True, "f": "@2"}, {"id": "2", "g": [1, [2, 3], [], "x"], "h": []}],
    [{"id": "1", "list": ["a", "b", "a"], "one": ["x"], "o": {"deep": {"er": [1]}}}],
    [{"id": "1", "t": {"datatype": "date", "value": "2000-01-01"}, "l": {"datatype": "json", "value": "@noref"}}],
]


@pytest.mark.parametrize("doc", DOCS)
def test_document_round_trip(doc):
    rows = DocReader().quads(doc)
    assert sorted(json.dumps(x, sort_keys=True) for x in serialize(rows, inline=False)) == sorted(json.dumps(x, sort_keys=True) for x in doc) or DocReader().quads(serialize(rows, inline=False)) == rows


def test_document_rules():
    rows = DocReader({"id": "key", "refs": None}).quads([{"key": "k", "p": "@x"}])
    assert rows == [("k", "p", "@x", "L", "", None)]
    with pytest.raises(DocError):
        DocReader().quads([{"id": "1", "a": 1}, {"id": "1", "a": 2}])
    assert DocReader().quads({"pjson": "0.9", "context": "g", "data": [{"id": "1", "a": 1}]})[0][4] == "g"
    assert serialize(DocReader().quads([{"id": "1", "o": "@2"}, {"id": "2", "x": 1}])) == [{"id": "1", "o": {"id": "2", "x": 1}}]


def test_formats(spark, tmp_path):
    quads = Store.from_json(spark, [{"id": "http://x/1", "p": "a \"b\"\nc", "q": [1, 2.5, True, None], "r": "@http://x/2"}]).quads.cache()
    nt = str(tmp_path / "out.nt")
    formats.write(quads, nt)
    same = lambda a, b: {(r.s, r.p, r.o, r.ot) for r in a.collect()} == {(r.s, r.p, r.o, r.ot) for r in b.collect()}
    back = formats.read(spark, nt)
    assert {(r.s, r.p, r.o) for r in back.collect()} == {(r.s, r.p, r.o) for r in quads.collect()}
    js = str(tmp_path / "lines")
    formats.write_pjson(quads, js)
    assert same(read_json_lines(spark, js), quads)
    rj = formats.write_rdfjson(quads).collect()
    assert formats.read_rdfjson(spark, rj[0].value).count() == quads.count()
    bad = spark.createDataFrame([("a b", "p", "o", "L", "", None)], QUADS)
    with pytest.raises(Exception, match="white space"):
        formats.ntriples_lines(bad).collect()
    f = tmp_path / "d.nt"
    f.write_text('#!graph <g1>\n<a> <p> "1" .\n\n# note\n<a> <p> "2"@en .\n#!remove <a> <p> "1" .\n#!json {"id": "b", "x": 1}\n')
    got = {(r.s, r.p, r.o, r.ot, r.c) for r in formats.read_ntriples(spark, str(f)).collect()}
    assert got == {("a", "p", "2", "en", "g1"), ("b", "x", "1", "http://www.w3.org/2001/XMLSchema#integer", "g1")}


def test_multipart_and_sniffing():
    doc = {"id": "1", "long": "x" * 400 + "\n--part\n", "short": "y", "l": ["z" * 300]}
    text = formats.write_multipart(doc)
    assert formats.parse_multipart(text) == doc
    assert formats.sniff(text) == "mjson" and formats.sniff(" [1]") == "pjson" and formats.sniff("<?xml version='1.0'?>") == "rdfxml" and formats.sniff("<a> <b> <c> .") == "ntriples"
    assert formats.format_of("a/b.json") == "pjson"


def test_scan_patterns(spark):
    q = spark.createDataFrame([("s", "p", "o", "L", "", None), ("s", "p", "o", "R", "", None), ("s", "p", "o", "L", "c", None), ("t", "p", "x", "L", "", None)], QUADS)
    assert sets.scan(q, subject="s").count() == 3
    assert sets.scan(q, obj="o").count() == 2  # references need their type
    assert sets.scan(q, obj="o", objecttype="R").count() == 1
    assert sets.scan(q, subject="s", as_quad=False).count() == 2
    assert [r.s for r in sets.scan(q, limit=1, offset=3).collect()] == ["t"]
    assert sets.union(q, q).count() == 4
    assert sets.difference(q.where("s = 's'"), q.where("c = ''"), ["s", "p", "o", "ot", "c"]).count() == 2


def test_inference(spark):
    R, I = "R", inference
    rows = [("A", I.SUBCLASS, "B"), ("B", I.SUBCLASS, "C"), ("x", I.TYPE, "A"), ("p", I.SUBPROPERTY, "q"), ("x", "p", "y"), ("q", I.DOMAIN, "D"), ("q", I.RANGE, "E")]
    q = spark.createDataFrame([(s, p, o, R, "", None) for s, p, o in rows], QUADS)
    types = {r.o for r in I.expand_types(q).where(f"s = 'x' AND p = '{I.TYPE}'").collect()}
    assert types == {"A", "B", "C"}
    assert I.expand_properties(q).where("s = 'x' AND p = 'q' AND o = 'y'").count() == 1
    made = {(r.s, r.o) for r in I.entail(q).where(f"p = '{I.TYPE}'").collect()}
    assert {("x", "D"), ("y", "E"), ("p", I.PROPERTY), ("x", "B"), ("x", I.RESOURCE)} <= made
    assert {r.t for r in I.compatible(q, "C").collect()} == {"A", "B", "C"}
    assert transitive_closure(q.where(f"p = '{I.SUBCLASS}'").selectExpr("s AS src", "o AS dst")).count() == 3


def test_merge_keeps_what_the_history_never_held(spark, tmp_path):
    a = Store.from_json(spark, [{"id": "a", "x": 1}], folder=str(tmp_path / "store")).with_history(str(tmp_path / "a"))
    b = Store.from_json(spark, []).with_history(str(tmp_path / "b"), "B")
    b.add({"id": "b", "y": 2})
    assert a.merge(b.history.changeset(b.history.tip)) is True
    want = {"a": {"id": "a", "x": 1}, "b": {"id": "b", "y": 2}}
    assert {r["id"]: r for r in a.query("{*}")} == want
    assert {r["id"]: r for r in Store.open(spark, str(tmp_path / "store")).query("{*}")} == want


def test_revision_functions_tell_statements_with_one_value_apart(spark, tmp_path):
    s = Store.from_json(spark, []).with_history(str(tmp_path / "h"))
    s.add({"id": "1", "p": "same"}, author="ann", comment="first")
    s.add({"id": "1", "q": "same"}, author="bob")
    s.add({"id": "2", "p": "same"}, author="cid")
    got = s.query("{id, 'p': getTransactionAuthor(p), 'q': getTransactionAuthor(maybe q), 'r': getTransactionId(p)}")
    assert sorted((r["id"], r["p"], r.get("q"), r["r"]) for r in got) == [("1", "ann", "bob", "A00001"), ("2", "cid", None, "A00003")]


def test_a_commit_that_failed_half_way_stays_invisible(spark, tmp_path):
    s = Store.from_json(spark, []).with_history(str(tmp_path / "h"))
    s.add({"id": "1", "p": 1})
    lost = s.history.changes().limit(1).selectExpr("'9' s", "p", "o", "ot", "c", "listpos", "op", "'A00002' rev", "'dead' batch")
    lost.write.mode("append").parquet(str(tmp_path / "h" / "changes"))
    s.add({"id": "2", "p": 2})
    assert sorted(r.s for r in s.history.state().collect()) == ["1", "2"]


def test_rebuild_takes_revisions_in_commit_order(spark, tmp_path):
    from jsonlake.streaming.history import CHANGES, History

    rows = [("1", "p", "old", "L", "", None, "add", "A99999"), ("1", "p", "old", "L", "", None, "del", "A100000"), ("1", "p", "new", "L", "", None, "add", "A100000")]
    h = History(spark, str(tmp_path / "r"))
    h.rebuild(spark.createDataFrame(rows, CHANGES))
    assert h.tip == "A100000" and [r.o for r in h.state().collect()] == ["new"]
