"""More goldens: nested constructs, labels, outer and cross joins. Reference marks (@) do not count here."""

import json

import pytest

from jsonlake.store import Store

REFS = {"refs": "(URIREF)"}

MODELS = {
    "outer": [{"label": "tag 1", "id": "tag1"}, {"parent": "1", "child": "3", "id": "b1"}, {"id": "2", "type": "post", "tags": "tag1"}, {"id": "3", "type": "post"}],
    "many": [{"label": "tag 1", "id": "tag1"}, {"label": "tag 2", "id": "tag2"}, {"parent": "1", "child": "3", "id": "b1"}, {"id": "2", "type": "post", "tags": ["tag1", "tag2"]}, {"id": "3", "type": "post"}],
    "subjects": [{"id": "commons", "label": "commons", "subsumedby": "projects", "type": "Tag"}, {"id": "garden", "label": "garden", "subsumedby": "projects", "type": "Tag"}, {"id": "toread", "subsumedby": "actions", "type": "Tag"}, {"id": "projects", "type": "Tag"}, {"id": "actions", "type": "Tag"}, {"id": "c1", "subject": "commons", "content": "text one"}, {"id": "c2", "subject": "commons", "content": "text two"}, {"id": "c3", "subject": "garden", "content": "text three"}],
    "semi": [{"label": "tag 1", "id": "tag1"}, {"label": "tag 2", "id": "tag2"}, {"id": "1", "type": "post", "tags": ["tag1"]}, {"id": "2", "type": "post", "tags": ["tag1", "tag2"]}, {"id": "3", "type": "post", "tags": ["tag1"]}],
    "nulls": [{"id": "1", "values": [None, None]}, {"id": "2", "values": [None, None]}, {"id": "3", "novalues": ""}, {"id": "4", "novalues": ""}],
    "halves": [{"id": "1", "prop1": [1, 2], "prop2": [2, 4]}, {"id": "2", "prop1": [1, 2], "prop2": [2, 4]}, {"id": "3", "prop1": [1, 2], "prop2": [6, 7]}],
    "alias": [{"id": "1", "prop1": 1, "prop2": 1}, {"id": "2", "prop1": 2, "prop2": 2}],
    "txn": [{"id": "1", "txn": "t1"}, {"id": "2", "txn": "t2"}, {"id": "t1", "createtime": 2}, {"id": "t2", "createtime": 1}],
}

OUTER = [{"id": "3", "tags": None}, {"id": "tag1", "tags": None}, {"id": "b1", "tags": None}, {"id": "2", "tags": {"id": "tag1"}}]
CASES = [
    ("outer", "{id, 'tags': {id where (id=?tag)} where tags and maybe tags = ?tag}", [{"id": "2", "tags": {"id": "tag1"}}]),
    ("outer", "{id, 'tags': {id where (id=?tag)} where maybe tags = ?tag}", OUTER),
    ("outer", "{id, 'tags': {id where id=?tag and label = \"tag 1\"} where maybe (maybe tags) = ?tag}", OUTER),
    ("outer", "{?post, id, 'tags': [id where (id=?tag)] where (maybe tags = ?tag)}", [{"id": "3", "tags": None}, {"id": "tag1", "tags": None}, {"id": "b1", "tags": None}, {"id": "2", "tags": ["tag1"]}]),
    ("outer", "{?post, id, 'tags': [{id where (id = ?tag)}] where (maybe tags = ?tag)}", [{"id": "3", "tags": []}, {"id": "tag1", "tags": []}, {"id": "2", "tags": [{"id": "tag1"}]}, {"id": "b1", "tags": []}]),
    ("outer", "{*, 'tags': {id where (id=?tag)} where (type=@post and maybe tags = ?tag)}", [{"id": "3", "tags": None, "type": "post"}, {"id": "2", "tags": {"id": "tag1"}, "type": "post"}]),
    ("outer", "{*, 'tags': {* where (id=?tag)} where (type=@post and maybe tags = ?tag)}", [{"id": "3", "tags": None, "type": "post"}, {"id": "2", "tags": {"id": "tag1", "label": "tag 1"}, "type": "post"}]),
    ("outer", "{'tags': ?tag where (tags = ?tag)}", [{"tags": "tag1"}]),
    ("outer", "{?tag, label, 'attributes': {'itemid': ?tag.id} where (label = 'tag 1')}", [{"attributes": {"itemid": "tag1"}, "label": "tag 1"}]),
    ("outer", "{?tag, label, 'attributes': {?inner 'itemid': ?tag where (?inner = ?tag)} where (label = 'tag 1')}", [{"attributes": {"itemid": "tag1"}, "label": "tag 1"}]),
    ("outer", "{?tag, label, 'attributes': {'itemid': ?tag} where label = 'tag 1'}", [{"attributes": {"itemid": "tag1"}, "label": "tag 1"}]),
    ("outer", "{?tag, label, 'attributes': {'itemlabel': ?tag.label} where label = 'tag 1'}", [{"attributes": {"itemlabel": "tag 1"}, "label": "tag 1"}]),
    ("outer", "{?tag, id, 'attributes': * where id = @tag1}", [{"attributes": {"id": "tag1", "label": "tag 1"}, "id": "tag1"}]),
    ("outer", "{?tag, id, 'shared': ?posts.tags where ({?posts ?tag = tags} and ?tag = @tag1)}", [{"id": "tag1", "shared": "tag1"}]),
    ("outer", "{id, foo where (maybe foo) = null}", []),
    ("many", "{?tag, id, 'shared': ?posts.tags where {?posts ?tag = tags} and ?tag = @tag1}", [{"id": "tag1", "shared": ["tag1", "tag2"]}]),
    ("many", "{?post, id, 'tags': [id where (id=?tag)] where (tags = ?tag and type=@post)}", [{"id": "2", "tags": [["tag1"], ["tag2"]]}]),
    ("many", "{?post, id : [id where (id=?tag)] where (tags = ?tag and type=@post)}", [{"2": [["tag1"], ["tag2"]]}]),
    ("many", "{?post, id, 'tags': {* where (id=?tag)} where (tags = ?tag and type=@post)}", [{"id": "2", "tags": [{"id": "tag1", "label": "tag 1"}, {"id": "tag2", "label": "tag 2"}]}]),
    ("many", "{?post, id, 'tags': {* where (id=?tag and label=\"tag 1\")} where (tags = ?tag and type=@post)}", [{"id": "2", "tags": {"id": "tag1", "label": "tag 1"}}]),
    ("many", "{?post, id, 'tags': {id=?tag and label=\"tag 1\"} where (tags = ?tag and type=@post)}", [{"id": "2", "tags": "tag1"}]),
    ("many", "{?post, id, 'tags': ?tag where (tags = ?tag and type=@post and {id=?tag and label=\"tag 1\"})}", [{"id": "2", "tags": "tag1"}]),
    ("many", "{?posts 'tags': ?tag.id where ?posts.tags = ?tag}", [{"tags": ["tag1", "tag2"]}]),
    ("many", "{?posts 'tags': ?tag.id where tags = ?tag}", [{"tags": ["tag1", "tag2"]}]),
    ("many", "{?posts 'tags': ?tag.id where {?tag ?posts.tags = ?tag} and type = @post}", [{"tags": ["tag1", "tag2"]}]),
    ("many", "{?posts 'tags': {?tag id where ?posts.tags = id} where type = @post}", [{"tags": [{"id": "tag1"}, {"id": "tag2"}]}]),
    ("many", "{id, maybe tags, 'alltags': ?alltags.label where type = @post and {?alltags label}}", [{"alltags": ["tag 1", "tag 2"], "id": "3", "tags": None}, {"alltags": ["tag 1", "tag 2"], "id": "2", "tags": ["tag1", "tag2"]}]),
    ("many", "{?alltags id, 'posts': ?post.id, label where {?post type = @post}}", [{"id": "tag1", "label": "tag 1", "posts": ["2", "3"]}, {"id": "tag2", "label": "tag 2", "posts": ["2", "3"]}]),
    ("many", "{* where {a=1 and b=2}}", []),
    ("subjects", "{?parent, id, 'contains': [{id where(subsumedby = ?parent)}]}", [{"contains": [{"id": "commons"}, {"id": "garden"}], "id": "projects"}, {"contains": [{"id": "toread"}], "id": "actions"}]),
    ("subjects", "{?tag, * where ?tag in (@foo, @commons)}", [{"id": "commons", "label": "commons", "subsumedby": "projects", "type": "Tag"}]),
    ("subjects", "{* where (id = ?tag and ?tag in (@foo, @commons))}", [{"id": "commons", "label": "commons", "subsumedby": "projects", "type": "Tag"}]),
    ("subjects", "{id where (id not in (@foo, @commons) and subsumedby)}", [{"id": "toread"}, {"id": "garden"}]),
    ("subjects", "{'inner': {?foo, id} where (?foo = subject)}", [{"inner": {"id": "commons"}}, {"inner": {"id": "commons"}}, {"inner": {"id": "garden"}}]),
    ("subjects", "{*, 'blah': [{* where(id = ?tag and ?tag = @dd)}] where (subject = ?tag)}", []),
    ("subjects", "{content, 'blah': [{id where(id = ?tag and ?tag = @commons)}] where (subject = ?tag)}", [{"blah": [{"id": "commons"}], "content": "text one"}, {"blah": [{"id": "commons"}], "content": "text two"}]),
    ("subjects", "{content, where ({id = ?tag and ?tag = @commons} and subject = ?tag)}", [{"content": "text one"}, {"content": "text two"}]),
    ("subjects", "{subject, content group by subject}", [{"subject": "commons", "content": ["text one", "text two"]}, {"subject": "garden", "content": "text three"}]),
    ("subjects", "{content group by subject}", [{"content": ["text one", "text two"]}, {"content": "text three"}]),
    ("many", "{id where {type = @post}}", [{"id": k} for k in ("2", "3", "b1", "tag1", "tag2")]),
    ("many", "{?tag * where (?tag = ?item.tags and {id = ?item and type = @post})}", [{"id": "tag1", "label": "tag 1"}, {"id": "tag2", "label": "tag 2"}]),
    ("many", "{?tag * where {id = ?item and type = @post and ?tag = tags}}", [{"id": "tag1", "label": "tag 1"}, {"id": "tag2", "label": "tag 2"}]),
    ("many", "{?tag 'attributes': {id where (id=?tag)}, 'state': 'closed', 'data': label where (label = 'tag 1')}", [{"attributes": {"id": "tag1"}, "data": "tag 1", "state": "closed"}]),
    ("semi", "{id where (tags in {id = 'tag1'})}", [{"id": "1"}, {"id": "2"}, {"id": "3"}]),
    ("semi", "{id where (tags not in {id = 'tag2'})}", [{"id": "1"}, {"id": "3"}]),
    ("semi", "{id where (tags not in {id = 'tag1'})}", []),
    ("semi", "{id where (tags in {label = 'tag 1'})}", [{"id": "1"}, {"id": "2"}, {"id": "3"}]),
    ("semi", "{id where (tags not in {label = 'tag 2'})}", [{"id": "1"}, {"id": "3"}]),
    ("nulls", "{id, maybe values where values = null}", [{"id": "1", "values": [None, None]}, {"id": "2", "values": [None, None]}, {"id": "3", "values": None}, {"id": "4", "values": None}]),
    ("nulls", "{id, maybe values where values}", [{"id": "1", "values": [None, None]}, {"id": "2", "values": [None, None]}]),
    ("halves", "{* where prop1 = prop2/2}", [{"id": "1", "prop1": [1, 2], "prop2": [2, 4]}, {"id": "2", "prop1": [1, 2], "prop2": [2, 4]}]),
    ("alias", "{?a id, prop1, 'prop2': ?b.prop2 where ?a = ?b}", [{"id": "1", "prop1": 1, "prop2": 1}, {"id": "2", "prop1": 2, "prop2": 2}]),
    ("alias", "{* where {?a prop1 = 1} and {?b prop2 = 1} and ?a = ?b}", [{"id": "1", "prop1": 1, "prop2": 1}, {"id": "2", "prop1": 2, "prop2": 2}]),
    ("alias", "{?a * where {?a prop1 = 1} and {?b prop2 = 1} and ?a = ?b}", [{"id": "1", "prop1": 1, "prop2": 1}]),
    ("txn", "{?firsttxn id, createtime where ?firsttxn = ref(?post.txn) and {?post txn}}", [{"createtime": 1, "id": "t2"}, {"createtime": 2, "id": "t1"}]),
    ("txn", "{?post *, 'createtime': ?firsttxn.createtime where {?firsttxn = ref(?post.txn)} order by ?firsttxn.createtime desc}", [{"createtime": 2, "id": "1", "txn": "t1"}, {"createtime": 1, "id": "2", "txn": "t2"}]),
    ("txn", "{id where ?t = ref(txn) order by ?t.createtime}", [{"id": "2"}, {"id": "1"}]),
]


def bare(x):
    if isinstance(x, str):
        return x.removeprefix("@")
    if isinstance(x, dict):
        return {bare(k): bare(v) for k, v in x.items()}
    return sorted((bare(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def stores(spark):
    return {name: Store.from_json(spark, model, REFS) for name, model in MODELS.items()}


@pytest.mark.parametrize(("model", "query", "expected"), CASES, ids=[f"{m}:{q}" for m, q, _ in CASES])
def test_golden(stores, model, query, expected):
    assert bare(stores[model].query(query)) == bare(expected)
