"""Vectors under ids of any kind: a column ``ext_id`` beside the whole-number keys of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import VectorError, with_sequence
from nearfield.operators.table import VectorTable


class ObjectTable:
    """A ``VectorTable`` whose rows are known by ``ext_id``; keys are given by the table's sequence and stay hidden."""

    def __init__(self, table: VectorTable) -> None:
        if "ext_id" not in table.rows.columns:
            raise VectorError("the table needs a column 'ext_id'")
        self.table = table

    @classmethod
    def create(cls, spark, space: str, dim: int, kind: str = "string", **options) -> ObjectTable:
        return cls(VectorTable.create(spark, space, dim, f"ext_id {kind}", **options))

    def _keys(self) -> DataFrame:
        return self.table.rows.select("ext_id", "vec_id")

    def add(self, df: DataFrame) -> ObjectTable:
        """Inserts or updates rows (ext_id, embedding and payload); of rows with one ``ext_id``, ``seq`` says which is last."""
        if "seq" in df.columns:
            last = Window.partitionBy("ext_id").orderBy(F.desc("seq"))
            df = df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")
        elif df.groupBy("ext_id").count().where("count > 1").limit(1).count():
            raise VectorError("an id comes twice in one batch; give a 'seq' column to say which row is last")
        if df.where("ext_id is null").limit(1).count():
            raise VectorError("every row needs an ext_id")
        known = df.join(self._keys(), "ext_id")
        new = with_sequence(df.join(self._keys(), "ext_id", "left_anti").sort("ext_id"), self.table.parameters.next_id)
        n = new.count()
        table = self.table.upsert(known.select(new.columns).unionByName(new))
        return ObjectTable(table._with(next_id=self.table.parameters.next_id + n))

    def delete(self, objects: DataFrame, strict: bool = True) -> ObjectTable:
        """Marks rows of (ext_id) as deleted."""
        keys = objects.select("ext_id").distinct().join(self._keys(), "ext_id", "left")
        if strict and (n := keys.where("vec_id is null").count()):
            raise KeyError(f"{n} ids aren't in the table")
        return ObjectTable(self.table.delete(keys.where("vec_id is not null").select("vec_id"), strict))

    def get(self, objects: DataFrame) -> DataFrame:
        return objects.select("ext_id").join(self.table.live, "ext_id").drop("vec_id")

    def knn(self, queries: DataFrame, k: int = 1, **options) -> DataFrame:
        """(query_id, ext_id, dist, rank)."""
        found = self.table.knn(queries, k, **options)
        return found.join(self._keys(), "vec_id").select("query_id", "ext_id", "dist", "rank")

    def save(self, path: str) -> None:
        self.table.save(path)

    @classmethod
    def load(cls, spark, path: str) -> ObjectTable:
        return cls(VectorTable.load(spark, path))
