"""Queries over small JSON models with the results they must give."""

import pytest

from jsonlake.plans.ast import QueryError
from jsonlake.store import Store

REFS = {"refs": "(URIREF)"}

MODELS = {
    "smoke": [{"id": "1", "parent": "2", "child": "3"}, {"id": "2", "foo": "bar"}, {"id": "3", "parent": "1", "child": "2"}, {"id": "4", "foo": "bar", "child": "1"}, {"id": "5"}],
    "values": [{"id": "1", "v": ["a b", 1, None, {"$ref": "x"}]}, {"id": "2", "v": [1, 1, 2]}, {"id": "3", "v": None}, {"id": "4", "n": 1}, {"id": "5", "v": "x y"}],
    "groups": [{"id": "1", "type": [1, 1, 2, 2], "val": [1, 2]}, {"id": "2", "type": 1, "val": 4}, {"id": "3", "type": 2, "val": None}, {"id": "4", "type": 3, "val": 10}],
    "tags": [{"id": "t1", "type": "Tag", "label": "top tag"}, {"id": "t2", "type": "Tag", "subsumedby": "t1"}, {"id": "t3", "type": "Tag", "subsumedby": "t2"}, {"id": "p1", "type": "post", "tags": ["t2", "t3"]}, {"id": "p2", "type": "post", "tags": "t1"}, {"id": "p3", "type": "post"}],
    "lists": [{"id": "1", "l": [[1, 2], [3]], "m": [], "n": [3, 1, 3, 2], "o": {"x": 1, "y": [{"z": 2}]}}],
    "ab": [{"id": "a1", "type": "a", "start": ["2000", "2001"], "pa": 1}, {"id": "b1", "type": "b", "date": "2000", "pb": 2}, {"id": "b2", "type": "b", "date": "2001", "pb": 3}, {"id": "b3", "type": "b", "date": "2002"}],
    "loop": [{"id": "1", "next": "2"}, {"id": "2", "next": "3"}, {"id": "3", "next": "1"}],
    "pairs": [{"id": "1", "a": [1, 2], "b": 2}, {"id": "2", "a": 1, "b": 2}, {"id": "3", "a": 6, "b": 12}],
}

CASES = [
    ("smoke", "{}", [{}]),
    ("smoke", "(foo)", ["@bar", "@bar"]),
    ("smoke", "{id, foo}", [{"id": "2", "foo": "@bar"}, {"id": "4", "foo": "@bar"}]),
    ("smoke", "{id : foo MERGEALL}", [{"2": "@bar", "4": "@bar"}]),
    ("smoke", "{id, maybe foo}", [{"id": "1", "foo": None}, {"id": "2", "foo": "@bar"}, {"id": "3", "foo": None}, {"id": "4", "foo": "@bar"}]),
    ("smoke", "{id, omitnull maybe foo where child}", [{"id": "1"}, {"id": "3"}, {"id": "4", "foo": "@bar"}]),
    ("smoke", "{id, [maybe foo]}", [{"id": "1", "foo": []}, {"id": "2", "foo": ["@bar"]}, {"id": "3", "foo": []}, {"id": "4", "foo": ["@bar"]}]),
    ("smoke", "{id, 'p': ?x.foo where parent = ?x}", [{"id": "1", "p": "@bar"}]),
    ("smoke", "{id where not foo}", [{"id": "1"}, {"id": "3"}]),
    ("smoke", "{'s': ['foo']}", [{"s": ["foo"]}]),
    ("smoke", "{'e': [[]]}", [{"e": []}]),
    ("smoke", "{* where id = @1 DEPTH 1}", [{"id": "1", "parent": {"id": "2", "foo": "@bar"}, "child": {"id": "3", "parent": "@1", "child": "@2"}}]),
    ("smoke", "[null=null, null!=null, null=0, null='', 1+null, trim(null), null > 0, null < 0]", [[True, False, False, False, None, None, False, True]]),
    ("smoke", "[1 + '2', 'x' + 1, 7 % -3, -7 % 3, bool(''), string(true), number(' 12 '), number('1d'), upper('a'), trim('xax', 'x')]", [[3.0, 1.0, -2.0, 2.0, False, "True", 12.0, 0.0, "A", "a"]]),
    ("values", "{id, v where v = null}", [{"id": "1", "v": [None]}, {"id": "3", "v": None}]),
    ("values", "{id, v where v = 1}", [{"id": "1", "v": [1]}, {"id": "2", "v": [1, 1]}]),
    ("values", "{id, v where v != 1}", [{"id": "1", "v": ["a b", None, "@x"]}, {"id": "2", "v": [2]}, {"id": "3", "v": None}, {"id": "5", "v": "x y"}]),
    ("values", "{id, v where v = 2 and v}", [{"id": "2", "v": [1, 1, 2]}]),
    ("values", "{id, maybe v where maybe v = null}", [{"id": "1", "v": [None]}, {"id": "3", "v": None}, {"id": "4", "v": None}]),
    ("values", "{id where v in (2, 'x y')}", [{"id": "2"}, {"id": "5"}]),
    ("groups", "{type, 'n': count(*), 's': sum(val) group by type}", [{"type": 1, "n": 2, "s": 7}, {"type": 2, "n": 2, "s": 3}, {"type": 3, "n": 1, "s": 10}]),
    ("groups", "[count(val), count(*), sum(val), avg(val)]", [[4, 4, 17, 4.25]]),
    ("groups", "{type, 'd': max(val) - min(val) group by type order by type desc limit 1}", [{"type": 3, "d": 0}]),
    ("groups", "{type, 'x': sum(if(val > 1, val, 0)) group by type}", [{"type": 1, "x": 6}, {"type": 2, "x": 2}, {"type": 3, "x": 10}]),
    ("groups", "{id, 't': total(val)}", [{"id": str(k), "t": 17} for k in (1, 2, 3, 4)]),
    ("tags", "{?parent, id, 'contains' : [{id where subsumedby = ?parent}]}", [{"id": "t1", "contains": [{"id": "t2"}]}, {"id": "t2", "contains": [{"id": "t3"}]}]),
    ("tags", "{* where type = @Tag and not subsumedby}", [{"id": "t1", "type": "@Tag", "label": "top tag"}]),
    ("tags", "{id, 'tags': {id where id=?tag} where maybe tags = ?tag and type=@post}", [{"id": "p1", "tags": [{"id": "t2"}, {"id": "t3"}]}, {"id": "p2", "tags": {"id": "t1"}}, {"id": "p3", "tags": None}]),
    ("tags", "{id, 'tags': [{id where id=?tag}] where maybe tags = ?tag and type=@post}", [{"id": "p1", "tags": [{"id": "t2"}, {"id": "t3"}]}, {"id": "p2", "tags": [{"id": "t1"}]}, {"id": "p3", "tags": []}]),
    ("tags", "{id, 'l': ?any.label where type=@post}", [{"id": k, "l": "top tag"} for k in ("p1", "p2", "p3")]),
    ("tags", "{id where tags not in {id = @t2} and type=@post}", [{"id": "p2"}]),
    ("tags", "{id where tags in {type = @Tag and id = @t1}}", [{"id": "p2"}]),
    ("tags", "{id, 'top': follow(id, subsumedby, true, true) where type=@Tag}", [{"id": "t1", "top": None}, {"id": "t2", "top": "@t1"}, {"id": "t3", "top": "@t1"}]),
    ("tags", "{id where tags in rfollow(@t2, subsumedby)}", [{"id": "p1"}]),
    ("tags", "{* where {type = @nothing}}", []),
    ("tags", "{id, 'l': tags.label}", [{"id": "p2", "l": "top tag"}]),
    ("tags", "{id where label or type = @post}", [{"id": "t1"}, {"id": "p1"}, {"id": "p2"}, {"id": "p3"}]),
    ("lists", "{*}", [{"id": "1", "l": [[1, 2], [3]], "m": [], "n": [3, 1, 3, 2], "o": {"x": 1, "y": [{"z": 2}]}}]),
    ("lists", "{id, n where n = 3}", [{"id": "1", "n": [3, 3]}]),
    ("ab", "{id, start, 'b': ?b where type=@a and start = ?b.date and {?b type=@b}}", [{"id": "a1", "start": ["@2000", "@2001"], "b": ["@b1", "@b2"]}]),
    ("ab", "{id where pa < ?b.pb and {?b type=@b}}", [{"id": "a1"}]),
    ("loop", "{id, 'r': follow(id, next, true)}", [{"id": "1", "r": ["@2", "@3"]}, {"id": "2", "r": ["@1", "@3"]}, {"id": "3", "r": ["@1", "@2"]}]),
    ("pairs", "{id where a = b}", [{"id": "1"}]),
    ("pairs", "{id where a = b / 2}", [{"id": "1"}, {"id": "2"}, {"id": "3"}]),
]


@pytest.fixture(scope="module")
def stores(spark):
    return {name: Store.from_json(spark, model, REFS) for name, model in MODELS.items()}


def key(x):
    return repr(sorted(x.items())) if isinstance(x, dict) else repr(x)


@pytest.mark.parametrize(("model", "query", "expected"), CASES, ids=[f"{m}:{q}" for m, q, _ in CASES])
def test_golden(stores, model, query, expected):
    assert sorted(stores[model].query(query), key=key) == sorted(expected, key=key)


def test_order_and_slice(stores):
    s = stores["smoke"]
    assert [x["id"] for x in s.query("{id, maybe child order by child, id}")] == ["2", "4", "3", "1"]
    assert [x["id"] for x in s.query("{id, maybe child order by id desc limit 2 offset 1}")] == ["3", "2"]
    assert s.query("{id, foo limit 0}") == []


def test_binds_and_errors(stores):
    s = stores["smoke"]
    assert s.query("[:a, :b]", {"a": "x", "b": 3}) == [["x", 3]]
    assert s.query("{id where id = :who}", {"who": "@2"}) == [{"id": "2"}]
    with pytest.raises(QueryError):
        s.query("{id where id = :missing}")
    with pytest.raises(QueryError):
        s.query("{'a': nosuch(foo)}")
    got = s.query("{'a': nosuch(foo)}", capture_errors=True)
    assert got["results"] == [] and got["errors"]
    assert "explain" in s.query("{id, foo}", explain=True)


def test_for_update_shows_embedded_ids(spark):
    s = Store.from_json(spark, [{"id": "1", "o": {"x": 1}}], REFS)
    assert s.query("{*}") == [{"id": "1", "o": {"x": 1}}]
    assert s.query("{*}", for_update=True)[0]["o"]["id"].startswith("bnode:j:e:")


def test_functions_of_users(stores):
    s = stores["groups"]
    s.register_function("my:twice", build=lambda x: x * 2)
    s.register_fold("product", 1.0, lambda a, x: a * x)
    assert s.query("{id, 't': <my:twice>(val) where id = @2}") == [{"id": "2", "t": 8}]
    assert s.query("(product(val))") == [80]


def test_namemap(spark):
    base = "http://www.w3.org/2000/01/rdf-schema#"
    s = Store.from_json(spark, [{"id": "1", base + "range": "@Tag", base + "sub": "@" + base + "Class", "p": 1}])
    names = '{"sharedpatterns": {"rdfs:": "' + base + '"}}'
    got = s.query("{* where <rdfs:range> = @Tag order by <rdfs:range> namemap = " + names + "}")
    assert got == [{"id": "1", "rdfs:range": "@Tag", "rdfs:sub": "@rdfs:Class", "p": 1}]
    assert s.query('{key, p, namemap = {"id": "key"}}') == [] or s.query('{id, p, namemap = {"id": "key"}}') == [{"key": "1", "p": 1}]
    assert s.query('{q namemap = {"q": "p"}}') == [{"q": 1}]


def test_expressions_in_groups(spark):
    rows = [{"key": k, "type": t, "val": (-1 if t % 2 else 1) * k * v} for k in (1, 10) for t in (1, 2) for v in (2, 4)]
    s = Store.from_json(spark, rows)
    got = s.query("{key, 'sum': sum(val), 'val': val, 'x': val*type*2, 'd': sum(if(type==1, val, 0)) - sum(if(type==2, val, 0)) group by key order by key}")
    assert [(g["key"], g["sum"], sorted(g["val"]), sorted(g["x"]), g["d"]) for g in got] == [(1, 0, [-4, -2, 2, 4], [-8, -4, 8, 16], -12), (10, 0, [-40, -20, 20, 40], [-80, -40, 80, 160], -120)]
    assert s.query("{key, 'min': min(val), 'max': max(val) group by key order by key}") == [{"key": 1, "min": -4, "max": 4}, {"key": 10, "min": -40, "max": 40}]
