"""Readers and writers of the binary vector formats of nearest-neighbour benchmarks.

* fbin / bin: ``u32 rows, u32 dim``, then rows of one 4-byte type;
* fvecs / bvecs / ivecs: each record is ``i32 dim`` and its values;
* raw: values alone, the dimension is given.

A path is a file or a folder of part files in the order of their names, on any
file system that Arrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a mounted
path). Readers cut files into row ranges by their size, without reading them
first; a row's number is its ``vec_id``. Writers write one part file for each
partition, from the executors: a part appears under its name when it is whole, so
a task that runs again replaces it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nearfield.functions.vectors import matrix

# NumPy types of the formats' values, and Spark types that hold them.
KINDS = {"float": ("<f4", "array<float>"), "int": ("<i4", "array<int>"), "uint": ("<u4", "array<bigint>"), "byte": ("u1", "array<smallint>")}
WIDE = {"<f4": np.float32, "<i4": np.int32, "<u4": np.int64, "u1": np.int16}
HEADER, HEADER_BYTES = "<II", 8
#: Bytes of a split, rows of a batch.
SPLIT, BATCH = 64 << 20, 8192
LAYOUTS = ("fbin", "vecs", "raw")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path with their sizes, in the order of their names."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name.startswith("part-"))
    return [(f"{path.rstrip('/')}/{n}", system.get_file_info(f"{at.rstrip('/')}/{n}").size) for n in names]


class Rows(InputPartition):
    """Rows ``first`` to ``first + count`` of all, which start at byte ``at`` of a file."""

    def __init__(self, path: str, at: int, first: int, count: int, dim: int) -> None:
        self.path, self.at, self.first, self.count, self.dim = path, at, first, count, dim


class VectorReader(DataSourceReader):
    def __init__(self, path: str, layout: str, kind: str, dim: int | None) -> None:
        if layout not in LAYOUTS or layout != "fbin" and not dim:
            raise ValueError(f"the layout is one of {', '.join(LAYOUTS)}; vecs and raw need a dimension")
        self.layout, self.numbers, self.rows = layout, KINDS[kind][0], []
        width, prefix, first = np.dtype(self.numbers).itemsize, 4 if layout == "vecs" else 0, 0
        for name, size in _files(path):
            begin, n = 0, None
            if layout == "fbin":
                system, at = opened(name)
                with system.open_input_file(at) as f:
                    head = f.read(HEADER_BYTES)
                if len(head) < HEADER_BYTES:
                    raise ValueError(f"{name} has no header")
                (n, dim), begin = struct.unpack(HEADER, head), HEADER_BYTES
            stride = width * dim + prefix
            if n is None:
                n = size // stride if stride else 0
            if size != begin + n * stride:
                raise ValueError(f"{name} isn't as long as rows of {dim} values make it")
            each = max(1, SPLIT // max(1, stride))
            self.rows += [Rows(name, begin + i * stride, first + i, min(each, n - i), dim) for i in range(0, n, each)]
            first += n
        self.prefix = prefix

    def partitions(self) -> list[Rows]:
        return self.rows or [Rows("", 0, 0, 0, 0)]

    def read(self, p: Rows) -> Iterator[pa.RecordBatch]:
        if not p.count:
            return
        system, at = opened(p.path)
        stride = np.dtype(self.numbers).itemsize * p.dim + self.prefix
        with system.open_input_file(at) as f:
            f.seek(p.at)
            for done in range(0, p.count, BATCH):
                n = min(BATCH, p.count - done)
                raw = np.frombuffer(f.read(n * stride), np.uint8).reshape(n, stride)
                if self.prefix and (np.ascontiguousarray(raw[:, :4]).view("<i4") != p.dim).any():
                    raise ValueError(f"{p.path}: a record hasn't {p.dim} values")
                values = np.ascontiguousarray(raw[:, self.prefix :]).reshape(-1).view(self.numbers)
                yield vectors(np.arange(p.first + done, p.first + done + n), values, p.dim)


class VectorSource(DataSource):
    """``spark.read.format('vectors').option('layout', 'fbin').option('kind', 'float').load(path)`` gives (vec_id, embedding)."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return f"vec_id bigint, embedding {KINDS[self.options.get('kind', 'float')][1]}"

    def reader(self, schema) -> VectorReader:
        dim = self.options.get("dim")
        return VectorReader(self.options["path"], self.options.get("layout", "fbin"), self.options.get("kind", "float"), int(dim) if dim else None)


def vectors(ids: np.ndarray, values: np.ndarray, dim: int) -> pa.RecordBatch:
    """A batch of (vec_id, embedding) from values in a row."""
    values = values.astype(WIDE[values.dtype.str.replace("|", "")], copy=False)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim) if dim else np.zeros(len(ids) + 1), pa.int32()), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["vec_id", "embedding"])


def _read(spark: SparkSession, path: str, layout: str, kind: str, dim: int | None = None) -> DataFrame:
    spark.dataSource.register(VectorSource)
    reader = spark.read.format("vectors").option("layout", layout).option("kind", kind)
    return (reader.option("dim", dim) if dim else reader).load(path)


def read_fbin(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """(vec_id, embedding) of an fbin file of ``kind`` float, int or uint; ``vec_id`` is the row number."""
    return _read(spark, path, "fbin", kind)


def read_vecs(spark: SparkSession, path: str, dim: int, kind: str = "byte") -> DataFrame:
    """(vec_id, embedding) of records with their dimension first: bvecs ('byte'), ivecs ('int', 'uint') or fvecs ('float').

    A record of another dimension raises. Unsigned bytes come as smallint, as Spark has no unsigned type.
    """
    return _read(spark, path, "vecs", kind, dim)


def read_raw(spark: SparkSession, path: str, dim: int, kind: str = "float") -> DataFrame:
    """(vec_id, embedding) of a dump of values without any header."""
    return _read(spark, path, "raw", kind, dim)


def read_truth(spark: SparkSession, path: str, k: int, kind: str = "uint") -> DataFrame:
    """(query_id, rank, vec_id) of an ivecs file of true neighbours."""
    rows = read_vecs(spark, path, k, kind)
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("r", "v")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("v").cast("long").alias("vec_id"))


def read_config(spark: SparkSession, path: str) -> dict[str, int]:
    """The numbers of a ``config.txt``: rows of a batch, batches, queries, dim and k."""
    text = " ".join(r["value"] for r in spark.read.text(path).collect()).split()
    if len(text) < 5:
        raise ValueError(f"{path} needs five numbers")
    return dict(zip(("rows", "batches", "queries", "dim", "k"), map(int, text[:5]), strict=True))


def _write(df: DataFrame, path: str, layout: str, kind: str, dim: int | None) -> int:
    """Rows in the order of ``vec_id``, as part files; how many were written."""
    if dim is None:
        first = df.select(F.size("embedding")).first()
        dim = first[0] if first else 0
    numbers = KINDS[kind][0]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in batches:
            if b.num_rows:
                rows = matrix(b.column("embedding"), dim).astype(numbers)
                if layout == "vecs":
                    rows = np.hstack([np.full((len(rows), 1), dim, "<i4").view(np.uint8).reshape(len(rows), 4), rows.view(np.uint8).reshape(len(rows), -1)])
                blocks.append(rows)
        n = sum(map(len, blocks))
        if n:
            system, at = opened(path)
            system.create_dir(at)
            name = f"{at.rstrip('/')}/part-{TaskContext.get().partitionId():06d}"
            unfinished = f"{at.rstrip('/')}/.{uuid.uuid4()}"
            with system.open_output_stream(unfinished) as f:
                if layout == "fbin":
                    f.write(struct.pack(HEADER, n, dim))
                for rows in blocks:
                    f.write(np.ascontiguousarray(rows).tobytes())
            system.move(unfinished, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = df.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("embedding")
    return sum(r["n"] for r in ordered.mapInArrow(write, "n bigint").collect())


def write_fbin(df: DataFrame, path: str, kind: str = "float", dim: int | None = None) -> int:
    """A folder of fbin files with the rows in the order of ``vec_id``; their number. One partition is held at a time."""
    return _write(df, path, "fbin", kind, dim)


def write_vecs(df: DataFrame, path: str, kind: str = "byte", dim: int | None = None) -> int:
    """A folder of files of records with their dimension first, in the order of ``vec_id``; their number."""
    return _write(df, path, "vecs", kind, dim)


def write_raw(df: DataFrame, path: str, kind: str = "float", dim: int | None = None) -> int:
    """A folder of dumps of values, in the order of ``vec_id``; the number of rows."""
    return _write(df, path, "raw", kind, dim)


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 47) -> DataFrame:
    """(vec_id, embedding) with components uniform in [0, 1) by hashes of key, place and seed: the same on any partitioning."""
    at = lambda i: (F.shiftrightunsigned(F.xxhash64(F.col("id"), i, F.lit(seed)), 40).cast("double") / F.lit(float(1 << 24))).cast("float")
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), at).alias("embedding"))


def unit_batches(spark: SparkSession, rows: int, dim: int, batches: int, queries: int, k: int, seed: int = 1) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Batches of vectors of length 1 with keys 0, 1, ... in each, queries, and the queries' true neighbours in the last batch by inner product.

    Every batch gives the same keys new vectors, as updates do.
    """
    from nearfield.functions.space import normalize
    from nearfield.operators import exact

    unit = lambda n, k: uniform(spark, n, dim, seed * 1000 + k).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") - 0.5)).withColumn("embedding", normalize(F.col("embedding")).cast("array<float>"))
    made = [unit(rows, k) for k in range(batches)]
    q = exact.as_queries(unit(queries, batches))
    return made, q, exact.knn(made[-1], q, k, "ip")
