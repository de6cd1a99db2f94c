"""Checks and conversions of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.storage import materialized

NUMBERS = (T.FloatType, T.DoubleType, T.ShortType, T.IntegerType, T.LongType, T.ByteType)


class VectorError(ValueError):
    """Vectors or keys that an operation can't take."""


def check_schema(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
    """Refuses a table without a whole-number key and a vector of numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    if not isinstance(kinds.get(key), (T.LongType, T.IntegerType, T.ShortType)):
        raise VectorError(f"{key!r} must be a column of whole numbers (keys of 2**63 and more don't fit)")
    v = kinds.get(vector)
    if not isinstance(v, T.ArrayType) or not isinstance(v.elementType, NUMBERS):
        raise VectorError(f"{vector!r} must be a column of arrays of numbers")


def invalid(vector: Column, dim: int) -> Column:
    """Whether a vector is null, has another length or holds null, NaN or infinite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNull() | (F.size(vector) != dim) | odd, F.lit(True))


def check_vectors(df: DataFrame, dim: int, vector: str = "embedding", key: str | None = "vec_id") -> None:
    """Raises ``VectorError`` if any row has an invalid vector or a null key. One pass, one row back."""
    bad = invalid(F.col(vector), dim)
    if key:
        bad = bad | F.col(key).isNull()
    n = df.agg(F.count(F.when(bad, 1)).alias("n")).first()["n"]
    if n:
        raise VectorError(f"{n} rows have no key or no vector of {dim} finite numbers")


def dimension(df: DataFrame, vector: str = "embedding") -> int | None:
    """The length of the first vector, None without any."""
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row[0] if row else None


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) != len(column) * dim:
        raise VectorError(f"a vector hasn't {dim} components")
    return values.reshape(-1, dim)


def from_numpy(spark: SparkSession, vectors: np.ndarray, ids: np.ndarray | int | None = None, key: str = "vec_id") -> DataFrame:
    """A table of the rows of a 2-D array (a 1-D one is one row), with ids 0, 1, ... by default."""
    vectors = np.asarray(vectors, np.float32)
    if vectors.ndim == 1:
        vectors = vectors[None, :]
    if vectors.ndim != 2:
        raise VectorError("vectors must be a 1-D or 2-D array")
    ids = np.arange(len(vectors)) if ids is None else np.atleast_1d(np.asarray(ids))
    if ids.shape != (len(vectors),):
        raise VectorError(f"{len(vectors)} vectors need as many ids, not {ids.shape}")
    rows = pa.table({key: pa.array(ids.astype(np.int64)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float32()))})
    return spark.createDataFrame(rows)


def to_arrays(found: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, ids, dists): neighbours as arrays, closest first."""
    rows = F.array_sort(F.collect_list(F.struct("rank", key, "dist")))
    return found.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.col(f"r.{key}").alias("ids"), F.col("r.dist").alias("dists"))


def with_sequence(df: DataFrame, start: int, name: str = "vec_id") -> DataFrame:
    """``df`` with consecutive numbers from ``start``, in the order of its partitions.

    The rows are written to the shared checkpoint folder first, with their
    partition, so that running a task again can't number them otherwise. They are
    then counted by partition and numbered within each; the counts (one number a
    partition) come to the driver.
    """
    df = materialized(df.withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["n"] for r in df.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    begins, at = {}, start
    for p in sorted(counts):
        begins[p], at = at, at + counts[p]
    schema = T.StructType([T.StructField(name, T.LongType(), False), *(f for f in df.schema if f.name not in (name, "_p"))])
    rest = [f.name for f in df.schema if f.name not in (name, "_p")]

    # the partition is told by its column: in a union, a task's number is another
    def number(batches):
        n = None
        for b in batches:
            if not b.num_rows:
                continue
            n = begins[b.column("_p")[0].as_py()] if n is None else n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + b.num_rows)), *(b.column(c) for c in rest)], [name, *rest])
            n += b.num_rows

    return df.mapInArrow(number, schema)
