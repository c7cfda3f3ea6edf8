"""Set difference, graph operators and plans over quads on small tables."""

from __future__ import annotations

import pytest

from jsonlake.operators import graph, sets
from jsonlake.plans import compiler
from jsonlake.store import Store


def test_difference_counts_copies_and_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d"), (4, "d")], "k int, v string")
    rows = sorted(map(tuple, sets.difference(old, new).collect()), key=str)
    assert rows == sorted([(1, "a", "removed"), (1, "a", "removed"), (2, None, "removed"), (4, "d", "added"), (4, "d", "added")], key=str)
    assert sets.difference(old, old).isEmpty()
    empty = old.limit(0)
    assert sets.difference(empty, new).count() == 4


def test_components_of_a_long_chain_and_a_ring(spark):
    chain = [(k, k + 1) for k in range(400)]
    ring = [(1000 + k, 1000 + (k + 1) % 7) for k in range(7)]
    comps = dict(map(tuple, graph.components(spark.createDataFrame(chain + ring + [(5000, 5000)], "src int, dst int")).collect()))
    assert {comps[k] for k in range(401)} == {0}
    assert {comps[1000 + k] for k in range(7)} == {1000}
    assert comps[5000] == 5000 and len(comps) == 409


def test_values_that_fail_a_test_leave_before_the_pivot(spark):
    data = [{"id": "a", "t": [1, 5, 9], "n": "x"}, {"id": "b", "t": [1, 2], "n": "y"}, {"id": "c", "n": "z"}]
    store = Store.from_json(spark, data)
    assert store.query("{id, t where t > 4}") == [{"id": "a", "t": [5, 9]}]
    assert store.query("{id, t where t > 4 and t < 2}") == [{"id": "a", "t": [1, 5, 9]}]
    assert sorted(r["id"] for r in store.query("{id, n where n != 'x'}")) == ["b", "c"]
    assert store.query("{* where t > 4}") == [data[0]]


def test_an_unlinked_label_beyond_its_bound_is_refused(spark, monkeypatch):
    store = Store.from_json(spark, [{"id": str(k), "v": k} for k in range(4)] + [{"id": "m", "w": 1}])
    assert sorted(store.query("{w, 'all': ?x.v}")[0]["all"]) == [0, 1, 2, 3]
    monkeypatch.setattr(compiler, "MOST_UNLINKED", 3)
    with pytest.raises(Exception, match="not linked"):
        store.query("{w, 'all': ?x.v}")
