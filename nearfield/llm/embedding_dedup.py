"""Near duplicates among embeddings by PCA-ordered tiled comparison.

Vectors are turned to principal axes, largest variance first. Tiles of one label
are compared block by block: the products of the leading dimensions are summed
first, the rest is bounded by the product of the suffix norms, and pairs stop as
soon as their cosine cannot reach the threshold. What is left is decided by the
cosine of the vectors as given, in double precision.

Equal vectors are one class with a count, so a vector that holds a third of all
rows is compared once. A label with more classes than a tile is cut by the
leading two coordinates into cells as wide as the largest distance of a link:
only neighbouring cells are compared, and a cell of many classes in several
tiles. A task is one pair of tiles; it returns one row for each of its vectors
at most, whatever the number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import checkpointed, components, join_by_class

THRESHOLD = 0.98
#: Classes of a tile; leading dimensions that are summed at a time; rows of a tile that are compared at a time.
TILE, STEP, ROWS = 8192, 16, 256
#: Room for the rounding of bounds; decisions are taken without it.
SLACK = 1e-9
#: Lengths of vectors up to which each has a pass of its own.
LENGTHS = 16


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes (columns) by falling variance of the unit vectors, over all rows.

    Each task sums its own second moments; dim * dim sums come to the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            u = _unit(_matrix(batch.column("embedding"), dim))
            n, first, second = n + len(u), first + u.sum(0), second + u.T @ u
        if n:
            sums = np.concatenate([[n], first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int64()), pa.array(sums)], ["i", "x"])

    rows = vectors.select("embedding").mapInArrow(moments, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    if not rows:
        return np.eye(dim)
    sums = np.zeros(1 + dim + dim * dim)
    for r in rows:
        sums[r["i"]] = r["x"]
    n, mean, second = sums[0], sums[1 : 1 + dim] / sums[0], sums[1 + dim :].reshape(dim, dim)
    _, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
    return axes[:, ::-1]


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """Connected components over local numbers; the root is the smallest."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while (p[p] != p).any():
                p[:] = p[p]


def compare_tiles(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, threshold: float, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``a`` with ``b``, or within ``a``) with cosine >= threshold, some rows of ``a`` at a time."""
    ua = _unit(a)
    ub = ua if b is None else _unit(b)
    ra, rb = ua @ axes, ub @ axes
    dim = a.shape[1]
    suffix = lambda r: np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], 1)[:, ::-1]))
    sa, sb = suffix(ra), suffix(rb)
    for top in range(0, len(a), ROWS):
        low = 0 if b is not None else top
        x, part = ra[top : top + ROWS], None
        i = j = None
        for d in range(0, dim, step):
            end = min(dim, d + step)
            if i is None:
                product = x[:, d:end] @ rb[low:, d:end].T
                part = product if part is None else part + product
                rest = np.outer(sa[top : top + ROWS, end], sb[low:, end]) if end < dim else 0
                reach = part + rest >= threshold - SLACK
                if reach.sum() * 8 < reach.size or end == dim:  # few pairs are left: go on with these alone
                    i, j = np.nonzero(reach)
                    part = part[i, j]
            elif len(i):
                part = part + (x[i, d:end] * rb[low + j, d:end]).sum(1)
                rest = sa[top + i, end] * sb[low + j, end] if end < dim else 0
                reach = part + rest >= threshold - SLACK
                i, j, part = i[reach], j[reach], part[reach]
        i, j = i + top, j + low
        if b is None:
            once = i < j
            i, j = i[once], j[once]
        # in pieces, so that a tile of nothing but links needs no more memory
        for k in range(0, len(i), 1 << 17):
            p, q = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            linked = (ua[p] * ub[q]).sum(1) >= threshold
            yield p[linked], q[linked]


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite
    components, vectors of different lengths, and rows without ``vec_id`` link
    with nothing; such rows are kept, each its own component. Rows that repeat a
    ``vec_id`` are vectors of their own and count as links of each other.
    Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", "label", "embedding", F.when(usable, F.md5(F.concat_ws(":", "label", F.col("embedding").cast("string")))).alias("key"))
    classes = keyed.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # classes of one label whose smallest ids are equal would be one node: nodes are numbered by key
    classes = checkpointed(classes.withColumn("dim", F.size("embedding")))
    dims = [r["dim"] for r in classes.select("dim").distinct().limit(LENGTHS + 1).collect()]
    rest = []
    if len(dims) > LENGTHS:  # only lengths that fill a tile in some label have a pass of their own
        sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most"))
        dims = [r["dim"] for r in sizes.where(F.col("most") > tile).collect()]
        rest = [_compare_small(classes.where(~F.col("dim").isin(dims)) if dims else classes, threshold)]
    found = [*(_compare(classes.where(F.col("dim") == d), d, threshold, tile) for d in dims), *rest]
    if found:
        linked = found[0]
        for f in found[1:]:
            linked = linked.unionByName(f)
        linked = checkpointed(linked)
        counts = linked.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        joined = components(linked.select("a", "b").where("a <> b"))
        named = joined.join(classes.select(F.col("key").alias("id"), "rep"), "id")
        lowest = named.groupBy("component_id").agg(F.min("rep").alias("component"))
        of_class = classes.select(F.col("key").alias("id"), "rep", "copies").join(counts.withColumnRenamed("node", "id"), "id", "left").join(joined, "id", "left").join(lowest, "component_id", "left")
        of_class = of_class.select(F.col("id").alias("key"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    else:
        of_class = classes.select("key", "copies", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"))
    out = join_by_class(keyed.select("vec_id", "key"), of_class, "key")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(group: pa.Table, dim: int, axes: np.ndarray, threshold: float, n: int | None = None) -> pa.Table:
    """(a, b, n) of the links inside a group, or of its first ``n`` rows with the others."""
    vectors, keys, copies = _matrix(group["embedding"], dim), group["key"], group["copies"].to_numpy()
    two = n is not None
    counts, forest = np.zeros(len(vectors), np.int64), Forest(len(vectors))
    for i, j in compare_tiles(vectors[:n], vectors[n:] if two else None, axes, threshold):
        j = j + n if two else j
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        forest.link(i, j)
    at = np.nonzero(counts)[0]
    return pa.table([keys.take(pa.array(at)).cast(pa.string()), keys.take(pa.array(forest.parent[at])).cast(pa.string()), pa.array(counts[at])], ["a", "b", "n"])


def _compare_small(classes: DataFrame, threshold: float) -> DataFrame:
    """As ``_compare``, for labels and lengths of a tile's classes at most: one task each, on the axes as given."""

    def run(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        if len(group) == 1:  # links with nothing
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["a", "b", "n"])
        return _links(group, dim, np.eye(dim), threshold)

    return classes.groupBy("label", "dim").applyInArrow(run, "a string, b string, n bigint")


def _compare(classes: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(a, b, n): a class, one that it is connected with (or itself), and how many rows it links with, from each task."""
    axes = principal_axes(classes, dim)
    wide = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = _unit(_matrix(batch.column("embedding"), dim)) @ axes[:, :2]
                cells = [pa.array(np.floor(r[:, min(k, r.shape[1] - 1)] / wide).astype(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cells], ["label", "key", "copies", "embedding", "x", "y"])

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "key", "copies", "embedding").mapInArrow(place, f"label {label}, key string, copies bigint, embedding {classes.schema['embedding'].dataType.simpleString()}, x bigint, y bigint")
    large = classes.groupBy("label").agg((F.count("*") > tile).alias("large"))
    placed = placed.join(large, "label").select("label", "key", "copies", "embedding", *(F.when(F.col("large"), F.col(c)).otherwise(0).alias(c) for c in ("x", "y")))
    cells = placed.groupBy("label", "x", "y").agg(F.count("*").alias("size"))
    tiles = cells.withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    one = tiles.select("label", "x", "y", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    half = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    near = one.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half))).alias("o"))
    near = near.select("label", "x", "y", "t", (F.col("x") + F.col("o.i")).alias("x2"), (F.col("y") + F.col("o.j")).alias("y2"))
    other = one.select(F.col("label").alias("label2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"))
    same = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    pairs = near.join(other.withColumnRenamed("label2", "label"), ["label", "x2", "y2"]).where(~same | (F.col("t") <= F.col("t2")))
    pairs = checkpointed(pairs.select("label", "x", "y", "t", "x2", "y2", "t2", F.xxhash64("label", "x", "y", "t", "x2", "y2", "t2").alias("task")))
    held = placed.join(tiles.select("label", "x", "y", "tiles"), ["label", "x", "y"]).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    first = held.join(pairs.select("label", "x", "y", "t", "task", "x2", "y2", "t2"), ["label", "x", "y", "t"]).select("label", "x", "y", "t", "x2", "y2", "t2", F.lit(0).alias("side"), "key", "copies", "embedding")
    alone = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("t") == F.col("t2"))
    back = pairs.where(~alone).select("label", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("t2").alias("t"))
    second = held.join(back, ["label", "x", "y", "t"]).select("label", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("t1").alias("t"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"), F.lit(1).alias("side"), "key", "copies", "embedding")
    dealt = first.unionByName(second)

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["side"].to_numpy(), kind="stable")
        side = group["side"].to_numpy()[order]
        group = group.take(pa.array(order))
        n = int((side == 0).sum())
        two = any(group[c][0].as_py() != group[c + "2"][0].as_py() for c in "xyt")  # even if one has no rows
        return _links(group, dim, axes, threshold, n if two else None)

    return dealt.groupBy("label", "x", "y", "t", "x2", "y2", "t2").applyInArrow(run, "a string, b string, n bigint")
