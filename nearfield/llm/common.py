"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into one output batch, and the text bytes after which it yields early.
YIELD_ROWS, YIELD_BYTES = 2048, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, dealt to all cores if it comes in fewer partitions, as a file of one row group does."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, its lineage cut; later reads take only the columns they need."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table that a job writes and reads again, in the folder that ``spark.checkpoint.dir`` names."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A folder of this machine stands in only where driver and executors are one process, as in tests; else ``RuntimeError``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="nearfield-")
        context.setCheckpointDir(folder)
    return folder


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Values of a string column, nulls as empty strings."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], sized_by: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most YIELD_ROWS rows and about YIELD_BYTES of ``sized_by``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(sized_by)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > YIELD_BYTES or i - start >= YIELD_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Tasks of a round of components at least, and edges for each one more.
LEAST_PARTS, PART_EDGES = 8, 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(id, component_id)`` for each id in ``edges(a, b)``.

    Alternating large-star and small-star rounds: every round is two
    aggregations and joins over the edge table, which stays within its first
    size, and rounds grow with the logarithm of the longest path. No vertex
    gathers its neighbours in one row, and those of a vertex with very many are
    joined where they stand (``_join_hubs``). ``component_id`` is the smallest id.
    Each round's table goes to the shared checkpoint folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    before = _signature(e)
    e = e.coalesce(max(LEAST_PARTS, before[0] // PART_EDGES))
    if not before[0]:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    parts = max(LEAST_PARTS, before[0] // PART_EDGES)
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        # large star: neighbours above u now point to the smallest of u's neighbourhood
        e = _join_hubs(e.select(F.col("v").alias("u"), F.col("u").alias("w")), low, before[0]).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below point to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        e = _join_hubs(e, low, before[0]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        # rounds over few edges take few tasks, whatever the session deals shuffles to
        e = checkpointed(e.coalesce(parts))
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(tops)


def _join_hubs(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m`` of their ``u``; the few vertices with a large share of all ``n`` edges are broadcast."""
    most = max(HOT_LEAST, n * HOT_SHARE)
    if n <= most:  # no vertex has more edges than there are
        return edges.join(low.drop("degree"), "u")
    hubs = low.where(F.col("degree") > most)
    near = edges.join(F.broadcast(hubs.drop("degree")), "u")
    far = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.where(F.col("degree") <= most).drop("degree"), "u")
    return near.unionByName(far)


#: A key with more than this share of all rows is joined by broadcast; so there are at most 1 / HOT_SHARE such keys.
HOT_SHARE, HOT_LEAST = 1 / 500, 500


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """``rows`` left-joined with ``classes`` (one row a ``key``) by ``key``, whatever share of the rows a key holds.

    ``copies`` of a class says how many rows have its key. The few classes that
    hold more than ``HOT_SHARE`` of all rows, 500 at most, are broadcast, so that
    their rows stay where they are; the rest are joined by a shuffle.
    """
    classes = checkpointed(classes)
    total = classes.agg(F.sum(copies)).first()[0] or 0
    hot = classes.where(F.col(copies) > max(HOT_LEAST, total * HOT_SHARE))
    cold = classes.where(F.col(copies) <= max(HOT_LEAST, total * HOT_SHARE))
    if hot.isEmpty():
        return rows.join(classes, key, "left")
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far)


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
