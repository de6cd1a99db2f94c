"""One entrance to all search paths: the planner chooses, the chosen operator runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.space import Space
from nearfield.functions.storage import materialized
from nearfield.operators import exact
from nearfield.operators.evaluate import mean_recall
from nearfield.operators.graph import GraphIndex
from nearfield.operators.ivf import CellIndex
from nearfield.plans.planner import Plan, plan


#: Queries, those with the smallest hash of their id, by which a width is measured; widths that are tried.
MEASURED, WIDTHS = 64, (16, 32, 64, 128, 256, 512, 1024)


def measured_width(search: Callable[[DataFrame, int], DataFrame], base: DataFrame, queries: DataFrame, k: int, space: str | Space, where: Column | str | None, recall: float, widths: Sequence[int]) -> int | None:
    """The least of ``widths`` by which a bounded sample of the queries has the recall asked for; None if none has."""
    some = materialized(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED))
    truth = materialized(exact.knn(base, some, k, space, where))
    for w in widths:
        if (mean_recall(search(some, w), truth, k).first()["recall"] or 0.0) >= recall:
            return w
    return None


def nearest(base: DataFrame, queries: DataFrame, k: int = 1, space: str | Space = "l2", where: Column | str | None = None, recall: float = 1.0, graph: GraphIndex | None = None, cells: CellIndex | None = None) -> tuple[DataFrame, Plan]:
    """(query_id, vec_id, dist, rank) and the plan that gave it.

    Rows, rows that the predicate leaves and queries are counted first. With
    ``recall`` below 1 an index may answer, by the least width whose recall on
    ``MEASURED`` queries, against exact search, is what is asked for; if no width
    has it, search is exact.
    """
    rows = base.count()
    left = base.where(where).count() if where is not None else rows
    dim, n = exact.checked(queries, None)
    chosen = plan(rows, n, max(dim, 1), recall, left / rows if rows else 1.0, graph is not None, cells is not None)
    if chosen.method in ("graph", "cells"):
        if chosen.method == "graph":
            search, widths = (lambda q, w: graph.knn(q, k, w, where).select("query_id", "vec_id", "dist", "rank")), WIDTHS
        else:
            every = len(cells.centres)
            search, widths = (lambda q, w: cells.knn(q, k, w, where)), sorted({max(1, every * s // 16) for s in (1, 2, 4, 8, 12, 16)})
        width = measured_width(search, base, queries, k, space, where, recall, widths)
        if width is not None:
            return search(queries, width), Plan(chosen.method, f"{chosen.why}, width {width}")
        chosen = plan(rows, n, max(dim, 1), 1.0)
    return exact.knn(base, queries, k, space, where, chosen.method), chosen
