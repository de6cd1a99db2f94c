"""Choice of a search path from sizes, the share of rows that a filter leaves and the recall asked for."""

from __future__ import annotations

from dataclasses import dataclass

from nearfield.operators.exact import choose

#: Pairs of a query and a row up to which exact search by blocks is taken even if less recall would do.
EXACT_PAIRS = 2_000_000_000
#: Share of rows below which a filtered search is exact: a graph would mostly walk through refused rows.
SELECTIVE = 0.1


@dataclass(frozen=True)
class Plan:
    method: str
    why: str


def plan(base_rows: int, queries: int, dim: int, recall: float = 1.0, share: float = 1.0, has_graph: bool = False, has_cells: bool = False) -> Plan:
    """``expression``, ``blocked`` or ``tiles`` (exact), ``cells`` or ``graph`` (approximate, if there is such an index)."""
    pairs = int(base_rows * share) * queries
    exact = choose(pairs, queries * (dim * 8 + 8))
    if recall >= 1:
        return Plan(exact, "every neighbour is asked for")
    if share < SELECTIVE:
        return Plan(exact, "the filter leaves few rows")
    if pairs <= EXACT_PAIRS or not (has_graph or has_cells):
        return Plan(exact, "few pairs" if has_graph or has_cells else "there is no index")
    return Plan("graph", "a graph") if has_graph and queries <= 4096 else Plan("cells", "cells") if has_cells else Plan("graph", "a graph")
