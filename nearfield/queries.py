"""The registered queries of the vector engine, and the same in DuckDB SQL."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.space import normalize
from nearfield.functions.storage import shared_folder
from nearfield.functions.vectors import from_numpy, matrix, to_arrays
from nearfield.operators import evaluate, exact
from nearfield.operators.graph import CELLS, GraphError, GraphIndex, Stop
from nearfield.operators.ivf import CellIndex
from nearfield.operators.objects import ObjectTable
from nearfield.operators.table import VectorTable
from nearfield.plans import sql
from nearfield.plans.search import nearest
from nearfield.sources import binary
from nearfield.streaming.vectors import StreamTable, knn_stream

#: Queries are all vectors whose id is divisible by this; they are searched among all rows.
EACH, K = 20, 10
DIM = 64

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def registered(text: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if text is not None:
            _sql[f.__name__] = text
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- tables ---------------------------------------------------------------


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def scaled(df: DataFrame) -> DataFrame:
    """Vectors of different lengths, so that the spaces differ: all stored ones are of length 1."""
    return df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)))


def query_set(df: DataFrame) -> DataFrame:
    return exact.as_queries(df.where(F.col("vec_id") % EACH == 0))


def as_bytes(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("short")))


def times(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn("embedding", F.transform("embedding", lambda x: (x * F.lit(factor).cast("float")).cast("float")))


# --- SQL ------------------------------------------------------------------

_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_IP = f"1 - {_DOT}"
_UNIT = "list_transform({0}, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-30))"
_SCALED = "SELECT * REPLACE (list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS embedding) FROM embeddings"


def _pairs_sql(rows: str = "SELECT * FROM embeddings", dist: str = _L2, q: str | None = None) -> str:
    """b, q and d(query_id, vec_id, label, dist) of all pairs."""
    q = q or f"SELECT vec_id AS query_id, embedding AS qv FROM b WHERE vec_id % {EACH} = 0"
    return f"WITH b AS ({rows}), q AS ({q}), d AS (SELECT query_id, vec_id, label, {dist.format('qv', 'embedding')} AS dist FROM q, b)"


def _top_sql(with_d: str, k: int | None = K, where: str = "true") -> str:
    ranks = f"SELECT query_id, vec_id, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d WHERE {where}"
    return f"{with_d} SELECT * FROM ({ranks})" + (f" WHERE rank <= {k}" if k else "")


_RAW_QUERIES = f"SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % {EACH} = 0"
KNN_L2 = _top_sql(_pairs_sql())
COSINE = _IP.format(_UNIT.format("qv"), _UNIT.format("embedding"))

# --- nearest neighbours ---------------------------------------------------


@registered(KNN_L2)
def knn_l2(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K)


@registered(KNN_L2)
def knn_expression(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, method="expression")


@registered(KNN_L2)
def knn_tiles(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, method="tiles")


@registered(_top_sql(_pairs_sql(q="SELECT vec_id AS query_id, embedding AS qv FROM b"), 3))
def knn_blocked(spark, sf_dir):
    """Every vector as a query."""
    b = base(spark, sf_dir)
    return exact.knn(b, exact.as_queries(b), 3)


@registered(_top_sql(_pairs_sql(_SCALED, _IP)))
def knn_ip_scaled(spark, sf_dir):
    b = scaled(base(spark, sf_dir))
    return exact.knn(b, query_set(b), K, "ip")


@registered(_top_sql(_pairs_sql(_SCALED, COSINE)))
def knn_cosine_scaled(spark, sf_dir):
    b = scaled(base(spark, sf_dir))
    return exact.knn(b, query_set(b), K, "cosine")


@registered(_top_sql(_pairs_sql("SELECT * REPLACE (list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)) AS embedding) FROM embeddings")))
def knn_bytes(spark, sf_dir):
    """Components of 0 to 255."""
    b = as_bytes(base(spark, sf_dir))
    return exact.knn(b, query_set(b), K, "l2_bytes")


@registered(_top_sql(_pairs_sql(dist="list_max(list_transform(list_zip({0}, {1}), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))")))
def knn_custom_space(spark, sf_dir):
    """A space of one's own: the largest difference."""
    from nearfield.functions.space import Space

    largest = Space("linf", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))), lambda a, b: abs(a - b).max(-1))
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, largest)


@registered(_top_sql(_pairs_sql("SELECT * REPLACE (17 + 3 * vec_id AS vec_id) FROM embeddings", q=_RAW_QUERIES)))
def knn_offset_ids(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b.withColumn("vec_id", 17 + 3 * F.col("vec_id")), query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="label = 3 AND vec_id % 97 = 0"))
def knn_fewer_than_k(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, where="label = 3 and vec_id % 97 = 0")


@registered(_top_sql(_pairs_sql(), where="vec_id % 3 = 0"))
def knn_filter_mod(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, where=F.col("vec_id") % 3 == 0)


@registered(_top_sql(_pairs_sql(), where="vec_id IN (11, 24, 58, 83)"))
def knn_filter_set(spark, sf_dir):
    b = base(spark, sf_dir)
    allowed = spark.createDataFrame([(11,), (24,), (58,), (83,)], "vec_id bigint")
    return exact.knn(b.join(F.broadcast(allowed), "vec_id", "left_semi"), query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="false"))
def knn_filter_none(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, where=F.lit(False))


@registered(_top_sql(_pairs_sql(), where="label = 3 AND vec_id >= 100"))
def knn_filter_payload(spark, sf_dir):
    """A predicate on another column than the key."""
    b = base(spark, sf_dir)
    return exact.knn(b, query_set(b), K, where="label = 3 and vec_id >= 100")


@registered(f"SELECT query_id, list(vec_id ORDER BY rank) AS ids, list(dist ORDER BY rank) AS dists FROM ({KNN_L2}) GROUP BY query_id")
def knn_arrays(spark, sf_dir):
    """Neighbours as two arrays a query, closest first."""
    return to_arrays(knn_l2(spark, sf_dir))


@registered("SELECT CAST(1 AS DOUBLE) AS recall")
def knn_self(spark, sf_dir):
    """Every vector is its own nearest neighbour."""
    b = base(spark, sf_dir)
    return evaluate.self_recall(exact.knn(b, exact.as_queries(b), 1))


# --- radius and documents -------------------------------------------------


@registered(_top_sql(_pairs_sql(), 5, "dist <= 1.3"))
def radius_l2(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.radius(b, query_set(b), 1.3, 5)


@registered(_top_sql(_pairs_sql(), None, "dist <= 1.5"))
def radius_all(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.radius(b, query_set(b), 1.5)


@registered(_top_sql(_pairs_sql(_SCALED, COSINE), None, "dist <= 0.7 AND vec_id % 2 = 0"))
def radius_cosine_filtered(spark, sf_dir):
    b = scaled(base(spark, sf_dir))
    return exact.radius(b, query_set(b), 0.7, space="cosine", where="vec_id % 2 = 0")


def _docs_sql(pairs: str, n: int) -> str:
    return f"""{pairs}, m AS (SELECT query_id, label, min(dist) AS low FROM d GROUP BY ALL),
c AS (SELECT query_id, low AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY low) AS n FROM m) WHERE n = {n + 1})
SELECT query_id, vec_id, label, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank
FROM d LEFT JOIN c USING (query_id) WHERE cutoff IS NULL OR dist < cutoff"""


@registered(_docs_sql(_pairs_sql(), 3))
def top_docs_l2(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.top_docs(b, query_set(b), 3, "label")


@registered(_docs_sql(_pairs_sql(_SCALED, _IP), 2))
def top_docs_ip(spark, sf_dir):
    b = scaled(base(spark, sf_dir))
    return exact.top_docs(b, query_set(b), 2, "label", "ip")


@registered(_docs_sql(_pairs_sql(), 3))
def top_docs_expression(spark, sf_dir):
    b = base(spark, sf_dir)
    return exact.top_docs(b, query_set(b), 3, "label", method="expression")


@registered(f"SELECT query_id, count(DISTINCT label) AS docs FROM ({_docs_sql(_pairs_sql(), 3)}) GROUP BY query_id")
def documents_found(spark, sf_dir):
    return evaluate.documents_found(top_docs_l2(spark, sf_dir), "label")


# --- life cycle -----------------------------------------------------------


def _table(df: DataFrame, **options) -> VectorTable:
    return VectorTable.from_rows(df.select("vec_id", "embedding", "label"), "l2", DIM, **options)


@registered(_top_sql(_pairs_sql(), where="vec_id % 5 <> 0"))
def tombstone_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b).delete(b.where("vec_id % 5 = 0")).knn(query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="vec_id % 5 <> 0 OR vec_id % 10 = 0"))
def undelete_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b).delete(b.where("vec_id % 5 = 0")).undelete(b.where("vec_id % 10 = 0")).knn(query_set(b), K)


_TIMES = "list_transform(embedding, lambda x: (x * CAST({} AS FLOAT))::FLOAT)"


@registered(_top_sql(_pairs_sql(f"SELECT * REPLACE (CASE WHEN vec_id % 10 = 0 THEN {_TIMES.format(-1)} ELSE embedding END AS embedding) FROM embeddings UNION ALL SELECT vec_id + 500000, {_TIMES.format(0.5)}, label FROM embeddings WHERE vec_id % 20 = 0", q=_RAW_QUERIES)))
def upsert_knn(spark, sf_dir):
    """New versions of every tenth vector, and new vectors."""
    b = base(spark, sf_dir)
    new = times(b.where("vec_id % 10 = 0"), -1).unionByName(times(b.where("vec_id % 20 = 0"), 0.5).withColumn("vec_id", F.col("vec_id") + 500000))
    return _table(b).upsert(new).knn(query_set(b), K)


# Every fifth key is deleted; as many of these as there are new keys, the smallest first, give their places away.
_PLACES = "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 5 = 0) WHERE n <= (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0)"


def _replaced(b: DataFrame) -> VectorTable:
    new = times(b.where("vec_id % 20 = 0"), 0.5).withColumn("vec_id", F.col("vec_id") + 500000)
    return _table(b, allow_replace_deleted=True).delete(b.where("vec_id % 5 = 0")).replace_deleted(new)


@registered(_top_sql(_pairs_sql(f"SELECT * FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id + 500000, {_TIMES.format(0.5)}, label FROM embeddings WHERE vec_id % 20 = 0", q=_RAW_QUERIES)))
def replace_deleted_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _replaced(b).knn(query_set(b), K)


@registered(f"SELECT vec_id, vec_id % 5 = 0 AS deleted FROM embeddings WHERE vec_id NOT IN ({_PLACES}) UNION ALL SELECT vec_id + 500000, false FROM embeddings WHERE vec_id % 20 = 0")
def replace_deleted_ids(spark, sf_dir):
    """Which keys a replacement leaves."""
    return _replaced(base(spark, sf_dir)).rows.select("vec_id", "deleted")


@registered(_top_sql(_pairs_sql(), where="vec_id % 4 <> 0"))
def remove_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b).remove(b.where("vec_id % 4 = 0").select("vec_id")).knn(query_set(b), K)


@registered("SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(vec_id) AS BIGINT) AS lowest, CAST(max(vec_id) AS BIGINT) AS highest FROM (SELECT row_number() OVER () - 1 AS vec_id FROM (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id % 20 = 0))")
def add_by_sequence(spark, sf_dir):
    """Ids that follow the table's own sequence, over two batches."""
    b = base(spark, sf_dir)
    table = VectorTable.create(spark, "l2", DIM).add(b.select("embedding")).add(b.where("vec_id % 20 = 0").select("embedding"))
    return table.rows.agg(F.count("*").alias("n"), F.min("vec_id").alias("lowest"), F.max("vec_id").alias("highest"))


@registered("SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0")
def get_items(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b).get(b.where("vec_id % 20 = 0").select("vec_id"))


@registered("SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0")
def ids_live(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b).delete(b.where("vec_id % 5 = 0")).ids(include_deleted=False)


@registered("SELECT count(*) AS elements, count(*) FILTER (vec_id % 5 = 0) AS deleted, count(*) FILTER (vec_id % 5 <> 0) AS live FROM embeddings")
def counts(spark, sf_dir):
    b = base(spark, sf_dir)
    rows = _table(b).delete(b.where("vec_id % 5 = 0")).rows
    return rows.agg(F.count("*").alias("elements"), F.count(F.when(F.col("deleted"), 1)).alias("deleted"), F.count(F.when(~F.col("deleted"), 1)).alias("live"))


@registered(_top_sql(_pairs_sql(), where="vec_id % 5 <> 0"))
def save_load_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    path = shared_folder(spark, "table")
    _table(b).delete(b.where("vec_id % 5 = 0")).save(path)
    return VectorTable.load(spark, path).knn(query_set(b), K)


# --- evaluation -----------------------------------------------------------


@registered("SELECT CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS overall")
def recall_exact_vs_blocked(spark, sf_dir):
    return evaluate.mean_recall(knn_l2(spark, sf_dir), knn_expression(spark, sf_dir), K)


@registered(f"WITH t AS ({KNN_L2}), f AS ({_top_sql(_pairs_sql(), where='vec_id % 2 = 0')}) SELECT t.query_id, count(f.vec_id) AS hits, count(f.vec_id) / {K}.0::DOUBLE AS recall FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.vec_id = f.vec_id GROUP BY t.query_id")
def recall_of_half(spark, sf_dir):
    """Recall of each query when every other vector is refused."""
    b = base(spark, sf_dir)
    return evaluate.recall(exact.knn(b, query_set(b), K, where="vec_id % 2 = 0"), knn_l2(spark, sf_dir), K)


# --- approximate search ---------------------------------------------------


@registered(KNN_L2)
def ivf_all_cells(spark, sf_dir):
    """With every cell probed, the result is exact."""
    b = base(spark, sf_dir)
    return CellIndex.build(b, 16).knn(query_set(b), K, 16)


@registered()
def ivf_recall(spark, sf_dir):
    """Recall by the share of rows that a query looks at."""
    b = base(spark, sf_dir)
    q, index = query_set(b), CellIndex.build(b, 16)
    truth, out = exact.knn(b, q, K), None
    for nprobe in (2, 4, 8, 12):
        row = evaluate.mean_recall(index.knn(q, K, nprobe), truth, K).select(F.lit(nprobe).alias("nprobe"), F.lit(index.share_read(q, nprobe)).alias("share_read"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


#: A beam that is wider than any shard visits all that can be reached: every node, if the graph is whole.
#: The results are to equal exact search, so queries look into all cells, however many there are.
WIDE, ALL = 1 << 20, CELLS


def _graph(b: DataFrame, **options) -> GraphIndex:
    return GraphIndex.build(b, **({"shard_rows": 1000, "probes": ALL} | options))


def _indexed(df: DataFrame, **options) -> VectorTable:
    return _table(df, ef=WIDE, **options).index(shard_rows=1000, probes=ALL)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", "dist", "rank")


@registered("SELECT true AS reached")
def graph_recall(spark, sf_dir):
    """Recall of a narrow beam against exact search."""
    b = base(spark, sf_dir)
    return evaluate.mean_recall(_graph(b).knn(query_set(b), K, 100), knn_l2(spark, sf_dir), K).select((F.col("recall") >= 0.95).alias("reached"))


@registered("SELECT vec_id AS query_id, true AS walked FROM embeddings WHERE vec_id % 20 = 0")
def graph_counters(spark, sf_dir):
    """Hops and distances that a search took: no more distances than rows and steps down the layers allow."""
    b = base(spark, sf_dir)
    found = _graph(b).knn(query_set(b), K, 60)
    fits = (F.min("hops") > 0) & (F.min("distances") >= K) & (F.max("distances") < b.count() + 10_000)
    return found.groupBy("query_id").agg(fits.alias("walked"))


@registered(KNN_L2)
def graph_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _ranked(_graph(b).knn(query_set(b), K, WIDE, on_short="partial"))


@registered(_top_sql(_pairs_sql(), where="vec_id % 3 = 0"))
def graph_filtered_knn(spark, sf_dir):
    """Refused rows are walked through."""
    b = base(spark, sf_dir)
    return _ranked(_graph(b).knn(query_set(b), K, WIDE, where="vec_id % 3 = 0", on_short="partial"))


@registered(_top_sql(_pairs_sql(), where="vec_id % 97 = 0"))
def graph_short_knn(spark, sf_dir):
    """A narrow beam and a filter that leaves few rows: what comes up short is answered exactly."""
    b = base(spark, sf_dir)
    return _ranked(_graph(b).knn(query_set(b), K, K, where="vec_id % 97 = 0"))


@registered("SELECT true AS raised")
def graph_short_error(spark, sf_dir):
    b = base(spark, sf_dir)
    try:
        _graph(b).knn(query_set(b), K, where="vec_id < 5", on_short="error")
        raised = False
    except exact.ShortResult:
        raised = True
    return spark.range(1).select(F.lit(raised).alias("raised"))


@registered(_top_sql(_pairs_sql(), 5, "dist <= 1.3"))
def graph_radius(spark, sf_dir):
    b = base(spark, sf_dir)
    return _ranked(_graph(b).radius(query_set(b), 1.3, WIDE, 5))


@registered(_docs_sql(_pairs_sql(), 3))
def graph_top_docs(spark, sf_dir):
    """All documents are collected, so none can be missed."""
    b = base(spark, sf_dir)
    return _graph(b).top_docs(query_set(b), 3, "label", 1000)


class NearestEver(Stop):
    """A condition of one's own: nothing ends the walk, the ``K`` nearest are kept."""

    endless = True

    def ends(self, dist: float, found: list) -> bool:
        return False

    def trim(self, found: list) -> None:
        if len(found) > K:
            heapq.heappop(found)


@registered(KNN_L2)
def graph_stop_condition(spark, sf_dir):
    b = base(spark, sf_dir)
    return _ranked(_graph(b).search_until(query_set(b), NearestEver)).where(F.col("rank") <= K)


@registered("SELECT 0 AS layer, count(*) AS nodes, CAST(0 AS BIGINT) AS self_links, CAST(0 AS BIGINT) AS unknown_links, CAST(0 AS BIGINT) AS repeated_links, CAST(0 AS BIGINT) AS unlinked FROM embeddings")
def graph_integrity(spark, sf_dir):
    """The lowest layer holds every row, and its links are sound."""
    rows = _graph(base(spark, sf_dir)).integrity().where("layer = 0")
    return rows.select("layer", "nodes", "self_links", "unknown_links", "repeated_links", "unlinked")


@registered(_top_sql(_pairs_sql(), where="vec_id % 5 <> 0"))
def graph_tombstone_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _indexed(b).delete(b.where("vec_id % 5 = 0")).knn(query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="vec_id % 5 <> 0 OR vec_id % 10 = 0"))
def graph_undelete_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _indexed(b).delete(b.where("vec_id % 5 = 0")).undelete(b.where("vec_id % 10 = 0")).knn(query_set(b), K)


@registered(_sql["upsert_knn"])
def graph_upsert_knn(spark, sf_dir):
    """New versions and new vectors, inserted into the graph by its construction beam."""
    b = base(spark, sf_dir)
    new = times(b.where("vec_id % 10 = 0"), -1).unionByName(times(b.where("vec_id % 20 = 0"), 0.5).withColumn("vec_id", F.col("vec_id") + 500000))
    return _indexed(b).upsert(new).knn(query_set(b), K)


@registered(_sql["replace_deleted_knn"])
def graph_replace_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    new = times(b.where("vec_id % 20 = 0"), 0.5).withColumn("vec_id", F.col("vec_id") + 500000)
    return _indexed(b, allow_replace_deleted=True).delete(b.where("vec_id % 5 = 0")).replace_deleted(new).knn(query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="vec_id % 4 <> 0"))
def graph_remove_knn(spark, sf_dir):
    """Removed nodes leave the graph; their neighbours are linked anew."""
    b = base(spark, sf_dir)
    return _indexed(b).remove(b.where("vec_id % 4 = 0").select("vec_id")).knn(query_set(b), K)


@registered(KNN_L2)
def graph_grown_knn(spark, sf_dir):
    """A graph that grew by one batch of insertions from a hundredth of the rows; beyond 2000 rows its shard is dealt to several."""
    b = base(spark, sf_dir)
    return _indexed(b.where("vec_id % 100 = 0")).upsert(b.where("vec_id % 100 <> 0").select("vec_id", "embedding", "label")).knn(query_set(b), K)


@registered(KNN_L2)
def graph_set_ef_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b, ef=1).index(shard_rows=1000, probes=ALL).set_ef(WIDE).knn(query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="vec_id % 5 <> 0"))
def graph_save_load_knn(spark, sf_dir):
    b, path = base(spark, sf_dir), shared_folder(spark, "indexed")
    _indexed(b).delete(b.where("vec_id % 5 = 0")).save(path)
    return VectorTable.load(spark, path).knn(query_set(b), K)


@registered("SELECT true AS refused")
def graph_load_checked(spark, sf_dir):
    """A stored graph can't be opened as one of another space or dimension."""
    path, refused = shared_folder(spark, "graph"), []
    _graph(base(spark, sf_dir)).save(path)
    for other in ({"space": "ip"}, {"dim": DIM + 1}):
        try:
            GraphIndex.load(spark, path, **other)
            refused.append(False)
        except GraphError:
            refused.append(True)
    return spark.createDataFrame([(all(refused),)], "refused boolean")


# --- functions, SQL and streams -------------------------------------------


@registered(f"SELECT vec_id, {_UNIT.format('embedding')} AS unit FROM ({_SCALED})")
def normalize_vectors(spark, sf_dir):
    return scaled(base(spark, sf_dir)).select("vec_id", normalize(F.col("embedding")).alias("unit"))


@registered(f"{_pairs_sql(_SCALED, _L2, f'SELECT vec_id AS query_id, embedding AS qv FROM b WHERE vec_id % 20 = 0')}, i AS (SELECT query_id, vec_id, {_IP.format('qv', 'embedding')} AS ip, {COSINE} AS cosine FROM q, b) SELECT query_id, vec_id, dist AS l2, ip, cosine FROM d JOIN i USING (query_id, vec_id)")
def pairwise_distance(spark, sf_dir):
    b = scaled(base(spark, sf_dir))
    return exact.distances(b, query_set(b), ["l2", "ip", "cosine"])


@registered(f"SELECT vec_id, query_id, {_L2.format('qv', 'embedding')} AS l2, {_IP.format('qv', 'embedding')} AS ip FROM (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), embeddings")
def sql_functions(spark, sf_dir):
    b = base(spark, sf_dir)
    sql.register_pairs(spark, "nearfield_pairs", b, query_set(b), ["l2", "ip"])
    return spark.sql("SELECT vec_id, query_id, l2, ip FROM nearfield_pairs")


@registered(_top_sql(_pairs_sql(f"SELECT * REPLACE (CASE WHEN vec_id % 10 = 0 THEN {_TIMES.format(-1)} ELSE embedding END AS embedding) FROM embeddings WHERE vec_id % 7 <> 1", q=_RAW_QUERIES)))
def stream_upsert_knn(spark, sf_dir):
    """Three batches of a stream: inserts, new versions, deletions; the second is replayed."""
    b = base(spark, sf_dir).select("vec_id", "embedding", "label")
    table = StreamTable(spark, shared_folder(spark, "stream")).start("l2", DIM, "label int")
    batches = [b.withColumn("op", F.lit("upsert")), times(b.where("vec_id % 10 = 0"), -1).withColumn("op", F.lit("upsert")), b.where("vec_id % 7 = 1").withColumn("op", F.lit("delete"))]
    for n in (0, 1, 1, 2):
        table.apply(batches[n], n)
    return table.current().knn(query_set(b), K)


@registered(KNN_L2)
def stream_knn(spark, sf_dir):
    """Neighbours of queries that arrive as a stream of files."""
    b, path = base(spark, sf_dir), shared_folder(spark, "queries")
    query_set(b).repartition(3).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema("query_id bigint, qv array<float>").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    knn_stream(arriving, b, K, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("query_id", "vec_id", "dist", "rank")


# --- ids of any kind, planner, files --------------------------------------


@registered(f"SELECT query_id, 'v' || vec_id AS ext_id, dist, rank FROM ({KNN_L2})")
def object_ids_knn(spark, sf_dir):
    """Vectors known by strings; a second batch only updates."""
    b = base(spark, sf_dir)
    named = b.select(F.concat(F.lit("v"), "vec_id").alias("ext_id"), "embedding")
    table = ObjectTable.create(spark, "l2", DIM).add(times(named, 2)).add(named)
    return table.knn(query_set(b), K)


@registered(_top_sql(_pairs_sql(), where="label = 3"))
def planned_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    return nearest(b, query_set(b), K, where="label = 3")[0]


@registered(KNN_L2)
def fbin_knn(spark, sf_dir):
    """The base through fbin files and back."""
    b, path = base(spark, sf_dir), shared_folder(spark, "fbin")
    binary.write_fbin(b, path)
    return exact.knn(binary.read_fbin(spark, path), query_set(b), K)


@registered("SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1) * 127.5) AS SMALLINT)) AS embedding FROM embeddings")
def bvecs_rows(spark, sf_dir):
    """Bytes through bvecs files and back."""
    path = shared_folder(spark, "bvecs")
    binary.write_vecs(as_bytes(base(spark, sf_dir)), path)
    return binary.read_vecs(spark, path, DIM)


@registered("SELECT vec_id, embedding FROM embeddings")
def raw_rows(spark, sf_dir):
    """Values without any header, whose shape a config file tells."""
    b, path = base(spark, sf_dir).select("vec_id", "embedding"), shared_folder(spark, "raw")
    n = binary.write_raw(b, f"{path}/batch")
    spark.createDataFrame([(f"{n} 1 0 {DIM} 10",)], "value string").coalesce(1).write.text(f"{path}/config")
    shape = binary.read_config(spark, f"{path}/config")
    return binary.read_raw(spark, f"{path}/batch", shape["dim"]).where(F.col("vec_id") < shape["rows"])


@registered(f"SELECT query_id, rank, vec_id FROM ({KNN_L2})")
def ivecs_truth(spark, sf_dir):
    """True neighbours through ivecs files and back."""
    b, path = base(spark, sf_dir), shared_folder(spark, "ivecs")
    found = to_arrays(knn_l2(spark, sf_dir)).select((F.col("query_id") / EACH).cast("long").alias("vec_id"), F.col("ids").alias("embedding"))
    binary.write_vecs(found, path, "uint")
    return binary.read_truth(spark, path, K).withColumn("query_id", F.col("query_id") * EACH)


@registered(KNN_L2)
def numpy_knn(spark, sf_dir):
    """Queries that come as a NumPy array with ids."""
    b = base(spark, sf_dir)
    q = query_set(b).toArrow()
    return exact.knn(b, exact.as_queries(from_numpy(spark, matrix(q["qv"], DIM), q["query_id"].to_numpy())), K)


@registered("SELECT vec_id, vec_id % 5 = 0 AS deleted FROM embeddings WHERE vec_id % 10 IN (0, 1)")
def deleted_marks(spark, sf_dir):
    b = base(spark, sf_dir)
    return _table(b).delete(b.where("vec_id % 5 = 0")).is_deleted(b.where("vec_id % 10 < 2"))


@registered("SELECT 'l2' AS space, 64 AS dim, count(*) AS element_count, count(*) FILTER (vec_id % 5 = 0) AS deleted_count, count(*) + 7 AS max_elements, 33 AS ef, 16 AS M FROM embeddings")
def described_table(spark, sf_dir):
    """Properties after a deletion, a larger capacity and another beam width."""
    b = base(spark, sf_dir)
    found = _table(b, max_elements=b.count()).delete(b.where("vec_id % 5 = 0")).resize(b.count() + 7).set_ef(33).describe()
    return spark.createDataFrame([found]).select("space", F.col("dim").cast("int").alias("dim"), "element_count", "deleted_count", "max_elements", F.col("ef").cast("int").alias("ef"), F.col("M").cast("int").alias("M"))


@registered("SELECT true AS stored, true AS pickled")
def stored_size(spark, sf_dir):
    """Bytes of a stored table, and a table that went through pickle."""
    b, path = base(spark, sf_dir), shared_folder(spark, "table")
    _table(b).save(path)
    again = pickle.loads(pickle.dumps(VectorTable.load(spark, path)))
    return spark.createDataFrame([(VectorTable.size_bytes(spark, path) > 4 * DIM * b.count() // 4, again.count() == b.count())], "stored boolean, pickled boolean")


@registered("SELECT 4 AS batches, 100 AS vectors, true AS unit, true AS truth")
def unit_batches(spark, sf_dir):
    """Generated batches of vectors of length 1, with true neighbours in the last one."""
    batches, q, truth = binary.unit_batches(spark, 100, 8, 4, 5, 3)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    rows = batches[-1].agg(F.count("*").cast("int").alias("vectors"), (F.max(F.abs(length - 1)) < 1e-6).alias("unit"))
    return rows.select(F.lit(len(batches)).alias("batches"), "vectors", "unit", F.lit(truth.count() == 15 and q.count() == 5).alias("truth"))


@registered("SELECT vec_id AS query_id, len(embedding) AS dim, CAST(1 AS DOUBLE) AS recall, 1 AS hits FROM embeddings WHERE vec_id % 20 = 0")
def self_recall_by_query(spark, sf_dir):
    b = base(spark, sf_dir)
    q = query_set(b)
    truth = q.select("query_id", F.col("query_id").alias("vec_id"), F.lit(1).alias("rank"))
    return evaluate.recall(exact.knn(b, q, 1), truth, 1).join(q.select("query_id", F.size("qv").alias("dim")), "query_id")


@registered("SELECT * FROM (VALUES (10, true), (40, true), (160, true)) AS t(setting, reached)")
def graph_ef_sweep(spark, sf_dir):
    """Recall by beam width: a tenth, half and nineteen of twenty at least."""
    b, path = base(spark, sf_dir), shared_folder(spark, "graph")
    _graph(b).save(path)
    index, q = GraphIndex.load(spark, path, "l2", DIM), query_set(b)
    rows = evaluate.sweep(lambda ef: index.knn(q, K, ef), exact.knn(b, q, K), K, [10, 40, 160])
    return rows.select("setting", (F.col("recall") >= F.element_at(F.create_map(F.lit(10), F.lit(0.1), F.lit(40), F.lit(0.5), F.lit(160), F.lit(0.95)), F.col("setting"))).alias("reached"))
