"""Walks of many queries at once, shards that outgrow their size, and distances compared as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import queries
from nearfield.functions.space import SPACES
from nearfield.operators import exact
from nearfield.operators import graph as g
from tests.test_engine import frame


def result(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "dist").collect()))


@pytest.mark.parametrize("share", [None, 0.5, 0.1])
@pytest.mark.parametrize("width", [1, 10, 60, 400, 1 << 20])
def test_walks_together_equal_single_walks(share, width):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(400, 6)), 1)
    x[200:230] = x[3]  # ties
    ids, levels = np.arange(400) * 3, np.minimum(r.geometric(15 / 16, size=400) - 1, 3)
    flat, widths = g._flat(g.build_shard(SPACES["l2"], x, levels, 8, 40), ids, np.arange(400))
    shard = g.Searcher(SPACES["l2"], ids, x, flat, widths, None if share is None else r.random(400) < share)
    q = np.vstack([np.round(r.normal(size=(20, 6)), 1), x[:10]])
    found = shard.beams(q, width, 10)
    for i in range(len(q)):
        shard.hops = shard.distances = 0
        one, mine = shard.beam(q[i], width)[:10], found.query == i
        assert list(zip(found.dist[mine].tolist(), found.node[mine].tolist(), strict=True)) == one
        assert (found.hops[i], found.taken[i]) == (shard.hops, shard.distances)


def test_a_shard_that_grows_is_dealt_to_several(spark):
    x = np.random.default_rng(8).normal(size=(400, 5))
    b = frame(spark, x).withColumn("doc_id", F.col("vec_id") % 7)
    index = g.GraphIndex.build(b.where("vec_id < 10"), shard_rows=50, dim=5, M=4)
    grown = index.apply(b.where("vec_id >= 10").withColumn("op", F.lit("upsert")))
    sizes = [r["count"] for r in grown.rows.groupBy("cell", "part").count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100
    q = exact.as_queries(b.where("vec_id % 20 = 0"))
    assert result(grown.knn(q, 5, 1000).select("query_id", "vec_id", "dist", "rank")) == result(exact.knn(b, q, 5))
    assert all(r.self_links == r.unknown_links == r.repeated_links == r.unlinked == 0 for r in grown.integrity().collect())


def test_exact_queries_look_into_all_cells(spark, sf):
    b = queries.base(spark, sf)
    index = queries._graph(b, shard_rows=20)
    assert len(index.centres) > g.ALL_CELLS
    q = queries.query_set(b)
    assert result(queries._ranked(index.knn(q, 10, queries.WIDE, on_short="partial"))) == result(exact.knn(b, q, 10))
    few = index.knn(q, 3, 3, where="vec_id % 40 = 7").select("query_id", "vec_id", "dist", "rank")
    assert result(few) == result(exact.knn(b, q, 3, where="vec_id % 40 = 7"))
    columns = ["query_id", "vec_id", "label", "dist", "rank"]
    assert result(index.top_docs(q, 3, "label", 1000).select(columns)) == result(exact.top_docs(b, q, 3, "label").select(columns))


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_distances_of_all_pairs_equal_those_of_the_expression(spark, sf, space):
    b = queries.scaled(queries.base(spark, sf))
    q = queries.query_set(b)
    assert result(exact.distances(b, q, [space]).withColumnRenamed(space, "dist")) == result(exact.scored(b, q, space))


def test_the_expression_path_ranks_few_pairs_and_keeps_the_result(spark, sf, monkeypatch):
    monkeypatch.setattr(exact, "BOUND_ROWS", 60)
    b = queries.scaled(queries.base(spark, sf))
    q = queries.query_set(b)
    pairs = exact.scored(b, q, "l2", dim=64)
    assert result(pairs) == result(exact.scored(b, q, "l2"))
    assert exact._scored_near(b, q, 10, SPACES["l2"], 64).count() < 0.7 * pairs.count()
    assert result(exact.knn(b, q, 10, "l2", method="expression")) == result(exact.knn(b, q, 10, "l2"))
