"""Vector search from SQL: distance functions that Catalyst inlines, a table function for neighbours, and views of all pairs with distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from nearfield.functions.vectors import dimension
from nearfield.operators import exact

_FOLD = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (t, z) -> t + z)"
# Bodies of SQL functions over two arrays of doubles, or one.
FUNCTIONS = {
    "l2_distance": "(a array<double>, b array<double>) RETURNS double RETURN " + _FOLD.format("(x - y) * (x - y)"),
    "vector_product": "(a array<double>, b array<double>) RETURNS double RETURN " + _FOLD.format("x * y"),
    "ip_distance": "(a array<double>, b array<double>) RETURNS double RETURN 1D - " + _FOLD.format("x * y"),
    "vector_norm": "(a array<double>) RETURNS double RETURN sqrt(aggregate(a, 0D, (t, z) -> t + z * z))",
    "cosine_distance": "(a array<double>, b array<double>) RETURNS double RETURN 1D - aggregate(zip_with(a, b, (x, y) -> (x / (sqrt(aggregate(a, 0D, (t, z) -> t + z * z)) + 1e-30D)) * (y / (sqrt(aggregate(b, 0D, (t, z) -> t + z * z)) + 1e-30D))), 0D, (t, z) -> t + z)",
}


@udtf(returnType="vec_id bigint, dist double")
class KnnOfPartition:
    """``knn_rows(TABLE(base) ..., query, k)``: the k rows of its partition nearest to ``query`` by squared distance.

    Over a partitioned table, order and limit the union to have the k nearest of all.
    """

    def __init__(self) -> None:
        self.heap, self.k = [], 0

    def eval(self, row, query: list, k: int) -> None:
        self.k = k
        d = 0.0
        for x, y in zip(row["embedding"], query, strict=True):
            d += (x - float(y)) ** 2
        heapq.heappush(self.heap, (-d, -row["vec_id"]))
        if len(self.heap) > k:
            heapq.heappop(self.heap)

    def terminate(self) -> Iterator[tuple]:
        yield from sorted((-v, -d) for d, v in self.heap)


def register(spark: SparkSession, **views: DataFrame) -> None:
    """Makes the functions, ``knn_rows`` and the given views known to ``spark.sql``."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("knn_rows", KnnOfPartition)
    for name, df in views.items():
        df.createOrReplaceTempView(name)


#: The function over two arrays that gives the distance of a space.
OF_SPACE = {"l2": "l2_distance", "ip": "ip_distance", "cosine": "cosine_distance"}


def register_pairs(spark: SparkSession, name: str, base: DataFrame, queries: DataFrame, spaces: list[str]) -> None:
    """Makes a view (query_id, vec_id, a column named for each space) of all pairs known to ``spark.sql``.

    Its distances are those of the SQL functions, bit by bit, without interpreting
    these for each pair: pairs of whole vectors of the usual length are worked out
    in Arrow batches. Where a vector is null, of another length or holds nulls, or a
    key is null, the SQL functions say what comes out.
    """
    register(spark)
    dim = dimension(base) or 0

    def usual(key: str, vector: str) -> Column:
        return F.coalesce(F.col(key).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))

    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    of_base, of_query = usual("vec_id", "embedding"), usual("query_id", "qv")
    pairs = exact.distances(base.where(of_base), queries.where(of_query), spaces, dim)
    odd_queries = queries.where(~of_query)
    sides = [(base.where(~of_base), queries)] if odd_queries.isEmpty() else [(base.where(~of_base), queries), (base.where(of_base), odd_queries)]
    for rows, asked in sides:
        distances = [F.expr(f"{OF_SPACE[s]}(qv, embedding)").alias(s) for s in spaces]
        pairs = pairs.unionByName(rows.crossJoin(asked).select("query_id", "vec_id", *distances))
    pairs.createOrReplaceTempView(name)
