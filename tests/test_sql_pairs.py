"""Distances of all pairs from SQL: by Arrow batches where vectors are usual, by the SQL functions elsewhere."""

from pyspark.sql import functions as F

from nearfield import queries
from nearfield.plans import sql


def ordered(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_pairs_equal_the_sql_functions_whatever_the_vectors(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [0.1, -0.2, 0.3]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0]), (5, [float("nan"), 1.0, 0.0]), (None, [1.0, 2.0, 2.5]), (6, [float("inf"), 1.0, 0.0]), (7, []), (8, [0.0, -0.0, 0.0])]
    b = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = b.where("vec_id % 2 = 0 or vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    sql.register_pairs(spark, "some_pairs", b, q, ["l2", "ip", "cosine"])
    found = spark.sql("SELECT vec_id, query_id, l2, ip, cosine FROM some_pairs")
    assert found.count() == len(rows) * 6
    q.createOrReplaceTempView("some_queries")
    b.createOrReplaceTempView("some_rows")
    assert ordered(found) == ordered(spark.sql("SELECT vec_id, query_id, l2_distance(qv, embedding), ip_distance(qv, embedding), cosine_distance(qv, embedding) FROM some_queries CROSS JOIN some_rows"))


def test_the_query_compares_usual_vectors_in_batches(spark, sf):
    out = queries.sql_functions(spark, sf)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["vec_id", "query_id", "l2", "ip"] and out.count() == 25 * 500
