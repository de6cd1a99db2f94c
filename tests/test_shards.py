"""Links chosen for many nodes at once, what shards return, and how often they are searched."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import queries
from nearfield.functions.space import SPACES
from nearfield.operators import exact
from nearfield.operators import graph as g
from nearfield.operators.table import VectorTable


@pytest.mark.parametrize("name", ["l2", "ip"])
def test_links_chosen_together_are_those_chosen_alone(name, monkeypatch):
    r = np.random.default_rng(3)
    x, calls = np.round(r.normal(size=(300, 6)), 1), []
    x[100:120] = x[7]  # ties
    levels = np.minimum(r.geometric(15 / 16, size=300) - 1, 3)

    def bulk(a, b):
        calls.append(len(a))
        return SPACES[name].bulk(a, b)

    links = g.build_shard(replace(SPACES[name], bulk=bulk), x, levels, 8, 40)
    assert len(calls) < 40  # not one for each link of a node
    alone = lambda between, candidates, dist, most: np.array([np.isin(c, g.select(replace(SPACES[name], bulk=None), x, c[c >= 0], d[c >= 0], most)) & (c >= 0) for c, d in zip(candidates, dist, strict=True)])
    monkeypatch.setattr(g, "TOGETHER", 100)  # nothing is looked up in a product of all with all
    exactly = g.build_shard(SPACES[name], x, levels, 8, 40)
    monkeypatch.setattr(g, "select_many", alone)
    assert g.build_shard(SPACES[name], x, levels, 8, 40) == exactly
    assert all(len(node) == level + 1 for node, level in zip(links, levels.tolist(), strict=True))


def test_a_radius_with_a_limit_takes_no_more_than_that_from_a_shard(spark, sf, monkeypatch):
    b, seen = queries.base(spark, sf), []
    q = queries.query_set(b)
    index = queries._graph(b, shard_rows=100)
    ranked = g.ranked
    monkeypatch.setattr(g, "ranked", lambda found, k: seen.append(found) or ranked(found, k))
    for width in (queries.WIDE, 60):
        found = index.radius(q, 1.9, width, 2)
        shards = index.rows.select("cell", "part").distinct().count()
        assert seen[-1].count() <= 2 * q.count() * shards
    found = queries._ranked(index.radius(q, 1.9, queries.WIDE, 2))
    assert sorted(found.collect()) == sorted(exact.radius(b, q, 1.9, 2).select(found.columns).collect())


def test_a_search_that_may_be_short_walks_once(spark, sf):
    b = queries.base(spark, sf)
    found = queries._graph(b).knn(queries.query_set(b), 3, 50)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()


def test_a_first_insertion_joins_with_nothing(spark, sf):
    table = VectorTable.from_rows(queries.base(spark, sf).select("vec_id", "embedding", "label"), "l2", 64)
    assert "Join" not in table.rows._jdf.queryExecution().optimizedPlan().toString()
    assert table.rows.dtypes == [("vec_id", "bigint"), ("embedding", "array<float>"), ("deleted", "boolean"), ("label", "int")]
    assert VectorTable.create(spark, "l2", 64).count() == 0
    assert table.rows.where(F.col("deleted")).count() == 0
