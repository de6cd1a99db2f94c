"""A table of vectors with the life cycle of an index: insert, update, soft delete, restore, replace, save and load.

A ``VectorTable`` is an immutable snapshot: every change returns a new one, so
readers keep what they hold. Keys are unique at all times.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearfield.functions.space import SPACES, Space
from nearfield.functions.storage import materialized
from nearfield.functions.vectors import check_schema, check_vectors, with_sequence
from nearfield.operators import exact
from nearfield.operators.graph import SHARD, GraphIndex

FORMAT = 1
#: The most links of a node that are taken; the default beam width.
MOST_LINKS, DEFAULT_EF = 10_000, 10


class TableError(RuntimeError):
    """An operation that the table's state doesn't allow."""


@dataclass(frozen=True)
class Parameters:
    space: str
    dim: int
    max_elements: int | None = None
    M: int = 16
    ef_construction: int = 200
    ef: int = DEFAULT_EF
    random_seed: int = 100
    allow_replace_deleted: bool = False
    next_id: int = 0
    version: int = FORMAT

    def __post_init__(self) -> None:
        if self.space not in SPACES:
            raise ValueError(f"there is no space {self.space!r}; known ones are {', '.join(SPACES)}")
        if self.dim < 1 or self.M < 1 or self.ef < 1 or self.ef_construction < 1:
            raise ValueError("dim, M, ef and ef_construction must be 1 or more")
        object.__setattr__(self, "M", min(self.M, MOST_LINKS))
        object.__setattr__(self, "ef_construction", max(self.ef_construction, self.M))


class VectorTable:
    """Rows of ``vec_id, embedding, deleted`` and any payload columns, with parameters and, once ``index`` is called, a graph that follows every change."""

    def __init__(self, rows: DataFrame, parameters: Parameters, path: str | None = None, graph: GraphIndex | None = None) -> None:
        self.rows, self.parameters, self.path, self.graph = rows, parameters, path, graph

    # --- making -----------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, space: str, dim: int, payload: str = "", **options) -> VectorTable:
        """An empty table; ``payload`` are further columns as DDL, such as ``'doc_id bigint'``."""
        ddl = "vec_id bigint, embedding array<float>, deleted boolean" + (f", {payload}" if payload else "")
        # an empty relation that the optimiser knows to be one, so that a first insertion joins with nothing
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)]
        return cls(spark.range(0).where(F.lit(False)).select(*none), Parameters(space, dim, **options))

    @classmethod
    def from_rows(cls, df: DataFrame, space: str, dim: int, **options) -> VectorTable:
        """A table of the rows of ``df`` (vec_id, embedding and payload)."""
        check_schema(df)
        ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("vec_id", "embedding", "deleted")]
        return cls.create(df.sparkSession, space, dim, ", ".join(ddl), **options).upsert(df)

    def _with(self, rows: DataFrame | None = None, graph: GraphIndex | None = None, **changes) -> VectorTable:
        return VectorTable(self.rows if rows is None else rows, replace(self.parameters, **changes), None, graph or (self.graph if rows is None else None))

    def _followed(self, rows: DataFrame, new: DataFrame | None = None, gone: DataFrame | None = None) -> VectorTable:
        """The table of ``rows``; its graph takes in the rows ``new`` and lets the keys ``gone`` go."""
        if self.graph is None:
            return self._with(rows)
        changes, rows = None, materialized(rows)
        if new is not None:
            changes = new.withColumn("op", F.lit("upsert"))
        if gone is not None:
            out = gone.select("vec_id").withColumn("op", F.lit("remove"))
            changes = out if changes is None else changes.unionByName(out, allowMissingColumns=True)
        return self._with(rows, self.graph.apply(changes))

    def index(self, shard_rows: int = SHARD, probes: int | None = None) -> VectorTable:
        """The table with a graph of its rows, made by its ``M``, ``ef_construction`` and ``random_seed``.

        ``knn`` then walks the graph with the table's ``ef``; inserts, updates,
        deletions, restorations, replacements and removals change the graph too.
        """
        p, rows = self.parameters, materialized(self.rows)  # read several times
        return self._with(rows, GraphIndex.build(rows, p.space, p.M, p.ef_construction, p.ef, p.random_seed, shard_rows, p.dim, probes))

    def clone(self) -> VectorTable:
        return VectorTable(self.rows, self.parameters, self.path, self.graph)

    def __getstate__(self) -> dict:
        """A table that was loaded is pickled as its path; others have to be saved first."""
        if self.path is None:
            raise TableError("only a loaded table can be pickled: save and load it first")
        return {"path": self.path, "version": FORMAT}

    def __setstate__(self, state: dict) -> None:
        if set(state) != {"path", "version"} or state["version"] != FORMAT:
            raise TableError("this isn't the state of a table")
        self.__dict__.update(VectorTable.load(SparkSession.active(), state["path"]).__dict__)

    # --- reading ----------------------------------------------------------

    @property
    def live(self) -> DataFrame:
        return self.rows.where(~F.col("deleted")).drop("deleted")

    @property
    def max_elements(self) -> int | None:
        return self.parameters.max_elements

    def count(self, include_deleted: bool = True) -> int:
        return (self.rows if include_deleted else self.live).count()

    def deleted_count(self) -> int:
        return self.rows.where("deleted").count()

    def ids(self, include_deleted: bool = True) -> DataFrame:
        return (self.rows if include_deleted else self.live).select("vec_id")

    def is_deleted(self, keys: DataFrame) -> DataFrame:
        return self._strictly(keys, None, "aren't in the table").select("vec_id", "deleted")

    def get(self, ids: DataFrame | None = None, normalized: bool = False, strict: bool = True, ordered: bool = True) -> DataFrame:
        """Rows of the given ``vec_id``, deleted ones not counting, in the order asked; all live rows without ``ids``.

        Repeated ids give repeated rows. Ids that aren't there raise ``KeyError`` if
        ``strict``. Without ``ordered`` neither the ids are numbered nor the rows sorted.
        """
        found = self.live
        if ids is not None:
            if strict and (n := ids.join(found, "vec_id", "left_anti").count()):
                raise KeyError(f"{n} ids aren't in the table")
            if ordered:
                found = with_sequence(ids.select("vec_id"), 0, "_asked").join(found, "vec_id").orderBy("_asked").drop("_asked")
            else:
                found = ids.select("vec_id").join(found, "vec_id")
        if normalized:
            found = found.withColumn("embedding", Space.parse(self.parameters.space).prepare_column(F.col("embedding")))
        return found

    def describe(self) -> dict:
        return asdict(self.parameters) | {"element_count": self.count(), "deleted_count": self.deleted_count()}

    def __repr__(self) -> str:
        return f"VectorTable(space={self.parameters.space!r}, dim={self.parameters.dim})"

    # --- changing ---------------------------------------------------------

    def add(self, df: DataFrame, replace_deleted: bool = False) -> VectorTable:
        """Inserts or updates rows; without a ``vec_id`` column, ids follow the table's sequence.

        The sequence moves on by the rows of ``df`` in either case.
        """
        n = df.count()
        start = self.parameters.next_id
        if "vec_id" not in df.columns:
            df = with_sequence(df, start)
        out = self.replace_deleted(df) if replace_deleted else self.upsert(df)
        return out._with(next_id=start + n)

    def _batch(self, df: DataFrame) -> DataFrame:
        check_schema(df)
        check_vectors(df, self.parameters.dim)
        df = df.withColumn("vec_id", F.col("vec_id").cast("long"))
        if "seq" in df.columns and "seq" not in self.rows.columns:
            last = Window.partitionBy("vec_id").orderBy(F.desc("seq"))
            df = df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")
        elif df.groupBy("vec_id").count().where("count > 1").limit(1).count():
            raise TableError("a key comes twice in one batch; give a 'seq' column to say which row is last")
        new = df.withColumn("deleted", F.lit(False))
        return new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.rows.schema))

    def _capacity(self, rows: DataFrame) -> None:
        most = self.parameters.max_elements
        if most is not None and (n := rows.count()) > most:
            raise TableError(f"{n} elements are more than max_elements = {most}")

    def upsert(self, df: DataFrame) -> VectorTable:
        """Rows by key: new ones are inserted, known ones replaced and, if deleted, restored.

        With ``allow_replace_deleted``, a deleted key can't be updated (its place
        may be given away): restore it first. A column ``seq`` orders versions
        within a batch.
        """
        new = self._batch(df)
        if self.parameters.allow_replace_deleted:
            gone = self.rows.where("deleted").select("vec_id")
            if not new.join(gone, "vec_id", "left_semi").limit(1).isEmpty():
                raise TableError("a deleted key can't be updated while its place may be replaced")
        rows = self.rows.join(new, "vec_id", "left_anti").select(self.rows.columns).unionByName(new)
        self._capacity(rows)
        return self._followed(rows, new)

    def replace_deleted(self, df: DataFrame) -> VectorTable:
        """As ``upsert``, but each new key takes the place of a deleted one, the smallest first, which is then gone."""
        if not self.parameters.allow_replace_deleted:
            raise TableError("the table wasn't made with allow_replace_deleted")
        new = self._batch(df)
        fresh = new.join(self.rows, "vec_id", "left_anti").count()
        # the smallest keys are taken off in one distributed order and limit
        replaced = self.rows.where("deleted").join(new, "vec_id", "left_anti").select("vec_id").orderBy("vec_id").limit(fresh)
        rows = self.rows.join(replaced, "vec_id", "left_anti").join(new, "vec_id", "left_anti").select(self.rows.columns).unionByName(new)
        self._capacity(rows)
        return self._followed(rows, new, replaced)

    def _strictly(self, keys: DataFrame, state: bool | None, why: str, strict: bool = True) -> DataFrame:
        """The rows of ``keys``; ``KeyError`` or ``TableError`` if some are missing or in the other state."""
        keys = keys.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
        if strict:
            found = keys.join(self.rows.select("vec_id", "deleted"), "vec_id", "left").groupBy("deleted").count().collect()
            by = {r["deleted"]: r["count"] for r in found}
            if by.get(None):
                raise KeyError(f"{by[None]} keys aren't in the table")
            if state is not None and by.get(state):
                raise TableError(f"{by[state]} keys {why}")
        return self.rows.join(keys, "vec_id", "left_semi")

    def delete(self, keys: DataFrame, strict: bool = True) -> VectorTable:
        """Marks keys as deleted; unknown or deleted ones raise if ``strict`` and are passed over if not."""
        return self._mark(keys, True, "are deleted already", strict)

    def undelete(self, keys: DataFrame, strict: bool = True) -> VectorTable:
        """Restores deleted keys; unknown or live ones raise if ``strict``."""
        return self._mark(keys, False, "aren't deleted", strict)

    def _mark(self, keys: DataFrame, state: bool, why: str, strict: bool) -> VectorTable:
        self._strictly(keys, state, why, strict)
        marked = keys.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(state).alias("_to")).distinct()
        rows = self.rows.join(marked, "vec_id", "left").withColumn("deleted", F.coalesce("_to", "deleted")).select(self.rows.columns)
        return self._with(rows) if self.graph is None else self._with(materialized(rows), self.graph.mark(keys, state))

    def remove(self, keys: DataFrame) -> VectorTable:
        """Removes rows for good; unknown keys are passed over."""
        return self._followed(self.rows.join(keys, "vec_id", "left_anti"), gone=self.rows.join(keys, "vec_id", "left_semi"))

    def resize(self, max_elements: int) -> VectorTable:
        if max_elements < (n := self.count()):
            raise TableError(f"the table holds {n} elements")
        return self._with(max_elements=max_elements)

    def set_ef(self, ef: int) -> VectorTable:
        """The table with another beam width of searches in its graph."""
        return self._with(ef=ef)

    # --- searching --------------------------------------------------------

    def _searched(self, where: Column | str | None) -> DataFrame:
        return self.live if where is None else self.live.where(where)

    def knn(self, queries: DataFrame, k: int = 1, where: Column | str | None = None, method: str = "auto", on_short: str = "partial") -> DataFrame:
        """(query_id, vec_id, dist, rank): by the graph (``method`` 'graph', or 'auto' if there is one), else exact.

        Where the graph finds fewer than ``k`` of enough rows, it is asked again
        exactly; ``on_short`` says what to do where there are too few.
        """
        if method == "graph" and self.graph is None:
            raise TableError("the table has no graph: call index() first")
        if method == "graph" or method == "auto" and self.graph is not None:
            found = self.graph.knn(queries, k, self.parameters.ef, where).select("query_id", "vec_id", "dist", "rank")
            if on_short == "error" and (n := queries.join(found.where(F.col("rank") == k), "query_id", "left_anti").count()):
                raise exact.ShortResult(f"{n} queries have fewer than {k} neighbours")
            return found
        return exact.knn(self._searched(where), queries, k, self.parameters.space, None, method, on_short, self.parameters.dim)

    def radius(self, queries: DataFrame, eps: float, max_results: int | None = None, where: Column | str | None = None) -> DataFrame:
        return exact.radius(self._searched(where), queries, eps, max_results, self.parameters.space, dim=self.parameters.dim)

    def top_docs(self, queries: DataFrame, num_docs: int, doc: str = "doc_id", where: Column | str | None = None) -> DataFrame:
        return exact.top_docs(self._searched(where), queries, num_docs, doc, self.parameters.space, dim=self.parameters.dim)

    # --- storing ----------------------------------------------------------

    def save(self, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
        """Writes the table below ``path``: rows as Parquet, the graph if there is one, parameters with the row count as one JSON line, last."""
        rows = self.rows.repartition(partitions) if partitions else self.rows
        rows.write.mode(mode).parquet(f"{path}/rows")
        spark = rows.sparkSession
        if self.graph is not None:
            self.graph.save(f"{path}/graph")
        meta = asdict(self.parameters) | {"rows": spark.read.parquet(f"{path}/rows").count(), "graph": self.graph is not None}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str, max_elements: int | None = None) -> VectorTable:
        """A saved table; ``TableError`` if it isn't there, isn't whole or has another format."""
        try:
            meta = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
            rows = spark.read.parquet(f"{path}/rows")
        except (AnalysisException, TypeError, ValueError) as e:
            raise TableError(f"no table can be opened at {path}") from e
        n, graph = meta.pop("rows", None), meta.pop("graph", False)
        if meta.get("version") != FORMAT or rows.count() != n or not {"vec_id", "embedding", "deleted"} <= {*rows.columns}:
            raise TableError(f"{path} holds no whole table of format {FORMAT}")
        out = cls(rows, Parameters(**meta), path, GraphIndex.load(spark, f"{path}/graph", meta["space"], meta["dim"]) if graph else None)
        return out if max_elements is None else out.resize(max(max_elements, n))

    @staticmethod
    def size_bytes(spark: SparkSession, path: str) -> int:
        """Bytes of a saved table, on any file system that Spark reads."""
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
