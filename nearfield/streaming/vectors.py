"""Streams of vectors: upserts into a stored table, and nearest neighbours of arriving queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.exact import knn
from nearfield.operators.table import TableError, VectorTable


class StreamTable:
    """A ``VectorTable`` in versions below ``path``; each batch of a stream makes the next one.

    A version's parameters hold the number of the last batch applied and are
    written after its rows, so a version is either whole or not there, and a
    batch that is replayed changes nothing. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _versions(self) -> dict[int, int]:
        """Whole versions and the batch that made each."""
        try:
            rows = self.spark.read.text(f"{self.path}/log").collect()
        except Exception:
            return {}
        return {x["version"]: x["batch"] for x in (json.loads(r["value"]) for r in rows)}

    def start(self, space: str, dim: int, payload: str = "", **options) -> StreamTable:
        VectorTable.create(self.spark, space, dim, payload, **options).save(f"{self.path}/0", mode="overwrite")
        self._commit(0, -1)
        return self

    def _commit(self, version: int, batch: int) -> None:
        self.spark.createDataFrame([(json.dumps({"version": version, "batch": batch}),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/log")

    def current(self) -> VectorTable:
        versions = self._versions()
        if not versions:
            raise TableError(f"no table at {self.path}")
        return VectorTable.load(self.spark, f"{self.path}/{max(versions)}")

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Upserts a batch, unless it or a later one has been applied. Rows may have ``seq`` and ``op`` ('upsert' or 'delete')."""
        versions = self._versions()
        last = max(versions)
        if versions[last] >= batch_id:
            return False
        table, rows = self.current(), batch
        if "op" in batch.columns:
            if "seq" in batch.columns:
                newest = batch.groupBy("vec_id").agg(F.max_by(F.struct(*batch.columns), "seq").alias("x")).select("x.*")
                rows = newest
            deleted = rows.where("op = 'delete'").select("vec_id")
            rows = rows.where("op <> 'delete'").drop("op")
            table = table.delete(deleted, strict=False)
        table.upsert(rows).save(f"{self.path}/{last + 1}", mode="overwrite")
        self._commit(last + 1, batch_id)
        return True

    def upsert_stream(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the stream (vec_id, embedding, payload, optionally seq and op)."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def knn_stream(queries: DataFrame, base: DataFrame, k: int, out: str, checkpoint: str, space: str = "l2", **trigger) -> StreamingQuery:
    """Neighbours of arriving (query_id, qv) rows in a stored base, written as Parquet below ``out`` batch by batch.

    Each batch has its own folder, overwritten if the batch is replayed.
    """

    def answer(batch: DataFrame, n: int) -> None:
        knn(base, batch, k, space).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
