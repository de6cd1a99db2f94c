"""Approximate search by cells: rows are kept by their nearest centre, queries look into the nearest ``nprobe`` cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.space import Space
from nearfield.functions.vectors import matrix
from nearfield.operators.exact import SHAPE, Best, _query_blocks, _result, checked, checked_dim, collected, nearest_in, ranked

#: Rows that centres are fitted on at most: those with the smallest hash of their key.
SAMPLE = 65_536


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return d.argmin(1)[:, None] if n == 1 else np.argsort(d, 1, kind="stable")[:, :n]


def fit_centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 100) -> np.ndarray:
    """Lloyd's rounds from rows far apart; the same rows give the same centres."""
    r = np.random.default_rng(seed)
    cells = min(cells, len(np.unique(x, axis=0)))
    centres = x[[int(r.integers(len(x)))]]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, cells):
        centres = np.vstack([centres, x[r.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        cell = _nearest(x, centres)[:, 0]
        n = np.bincount(cell, minlength=cells)
        sums = np.stack([np.bincount(cell, column, cells) for column in x.T], axis=1)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres


@dataclass
class CellIndex:
    """``rows`` have a column ``cell``; store them partitioned by it, so that cells no query probes aren't read."""

    rows: DataFrame
    centres: np.ndarray
    space: Space
    dim: int

    @classmethod
    def build(cls, base: DataFrame, cells: int, space: str | Space = "l2", dim: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Centres come from a bounded sample; every row gets the cell of its nearest centre in one narrow pass."""
        s = Space.parse(space)
        dim = checked_dim(base, dim)
        taken = base.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        x = s.prepare(matrix(taken["embedding"], dim))
        centres = fit_centres(x, cells)
        kept = base.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = _nearest(s.prepare(matrix(b.column("embedding"), dim)), centres)[:, 0] if b.num_rows else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*kept, "cell"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "cell int"])
        return cls(base.mapInArrow(place, schema), centres, s, dim)

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist(), self.space.name) for i, c in enumerate(self.centres)], "cell int, centre array<double>, space string").write.parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark, path: str, space: str | Space | None = None) -> CellIndex:
        """Stored cells; ``ValueError`` if they are of another space. A space of one's own has to be given again."""
        centres = sorted(spark.read.parquet(f"{path}/centres").collect())
        named = centres[0]["space"] if centres else None
        asked = named if space is None else space.name if isinstance(space, Space) else space
        if not centres or asked != named:
            raise ValueError(f"{path} has cells of space {named!r}")
        space = space or named
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r["centre"] for r in centres]), Space.parse(space), len(centres[0]["centre"]))

    def knn(self, queries: DataFrame, k: int, nprobe: int, where: Column | str | None = None) -> DataFrame:
        """(query_id, vec_id, dist, rank) over the rows of each query's ``nprobe`` cells; exact distances.

        ``nprobe`` of all cells gives the exact result. Queries are broadcast in blocks, each against all rows.
        """
        dim, n = checked(queries, self.dim)
        return ranked(_query_blocks(queries, n, dim, lambda q: self._knn_block(q, k, nprobe, where)), k)

    def share_read(self, queries: DataFrame, nprobe: int) -> float:
        """The share of all rows in the cells that a query looks into, on average."""
        _, q = collected(queries, self.dim, self.space)
        sizes = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}
        each = np.array([sizes.get(c, 0) for c in range(len(self.centres))])
        return float(each[_nearest(q, self.centres, nprobe)].sum(1).mean() / max(1, each.sum())) if len(q) else 0.0

    def _knn_block(self, queries: DataFrame, k: int, nprobe: int, where: Column | str | None) -> DataFrame:
        s, dim = self.space, self.dim
        qid, q = collected(queries, dim, s)
        probes = np.zeros((len(q), len(self.centres)), bool)
        if len(q):
            np.put_along_axis(probes, _nearest(q, self.centres, nprobe), True, 1)
        shared = self.rows.sparkSession.sparkContext.broadcast((qid, q, probes))
        used = np.flatnonzero(probes.any(0)).tolist()
        rows = self.rows if len(used) == len(self.centres) else self.rows.where(F.col("cell").isin(used))
        rows = rows.where(where) if where is not None else rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, probes = shared.value
            best = Best(len(q), k)
            for b in batches:
                if not b.num_rows:
                    continue
                ids, cells, x = b.column("vec_id").to_numpy(), b.column("cell").to_numpy(), s.prepare(matrix(b.column("embedding"), dim))
                for c in np.unique(cells):
                    own, mine = cells == c, np.flatnonzero(probes[:, c])
                    part = Best(len(mine), k)
                    part.dist[:], part.ids[:] = best.dist[mine], best.ids[mine]
                    nearest_in(s, ids[own], x[own], q[mine], part)
                    best.dist[mine], best.ids[mine] = part.dist, part.ids
            i, found, dist = best.rows()
            yield _result(qid[i], found, dist)

        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("cell").cast("int").alias("cell"), "embedding").mapInArrow(run, SHAPE)
