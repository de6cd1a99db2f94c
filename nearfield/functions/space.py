"""Distance spaces: a Catalyst expression and a NumPy kernel of each, equal bit by bit.

Both sum from the first dimension to the last in double precision, so the
expression path, the blocked path and plain SQL give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm before dividing by it, so that a zero vector stays zero.
TINY = 1e-30
#: Pairs of rows up to which one call sums the terms of all dimensions.
AT_ONCE = 8192


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences; null if the lengths differ."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def normalize(v: Column) -> Column:
    """``v`` over its norm plus ``TINY``: the zero vector stays zero."""
    # the norm as an element of an array, so that it is worked out once and not for each component
    return F.flatten(F.transform(F.array(norm(v) + F.lit(TINY)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def _summed(a: np.ndarray, b: np.ndarray, term: Callable[..., np.ndarray]) -> np.ndarray:
    """Terms (of two arrays, into a third if given) of the last axis added from the first to the last: by a running sum where it is short, as ``sum`` adds in pairs."""
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    if a.shape[-1] and math.prod(shape) <= AT_ONCE:
        return np.cumsum(term(a, b), axis=-1, dtype=np.float64)[..., -1] + 0.0
    total, held = np.zeros(shape), np.empty(shape)
    for k in range(a.shape[-1]):
        total += term(a[..., k], b[..., k], held)
    return total


def _squared(x: np.ndarray, y: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    d = np.subtract(x, y, out=out)
    return np.multiply(d, d, out=out)


def _dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, np.multiply)


def _l2_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, _squared)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt(_dot_rows(x, x)) + TINY)[:, None]


@dataclass(frozen=True)
class Space:
    """A way to compare vectors; smaller is closer.

    ``expression`` and ``rows`` give the distance of two vectors (as columns; of
    rows of two matrices). ``bulk`` gives all distances of two matrices up to
    rounding, at the speed of a matrix product, or None. ``prepare`` is applied
    to matrices first (normalising), ``prepare_column`` to columns.
    """

    name: str
    expression: Callable[[Column, Column], Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bulk: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    prepare: Callable[[np.ndarray], np.ndarray] = lambda x: x
    prepare_column: Callable[[Column], Column] = lambda c: c
    #: The summand of a dimension and what becomes of the sum, where ``expression`` is one.
    term: Callable[[Column, Column], Column] | None = None
    finish: Callable[[Column], Column] = lambda c: c

    @staticmethod
    def parse(space: str | Space) -> Space:
        if isinstance(space, Space):
            return space
        if space not in SPACES:
            raise ValueError(f"space must be one of {', '.join(SPACES)}, or a Space; not {space!r}")
        return SPACES[space]

    def distance(self, a: Column, b: Column) -> Column:
        return self.expression(self.prepare_column(a), self.prepare_column(b))

    def candidates(self, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All distances of prepared matrices up to rounding, and a bound of the rounding by pair of rows."""
        if self.bulk is None:
            return self.rows(q[:, None, :], b[None, :, :]), np.zeros((len(q), 1))
        big = (q * q).sum(1)[:, None] + (b * b).sum(1).max(initial=0.0)
        return self.bulk(q, b), (2 * q.shape[1] + 16) * np.finfo(float).eps * (big + 1)


def _bulk_l2(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (q @ b.T)


def _bulk_ip(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - q @ b.T


_SQUARE = lambda x, y: (x - y) * (x - y)
_PRODUCT = lambda x, y: x * y
_LESS = lambda c: F.lit(1.0) - c
SPACES = {
    "l2": Space("l2", squared_l2, _l2_rows, _bulk_l2, term=_SQUARE),
    "ip": Space("ip", lambda a, b: F.lit(1.0) - inner_product(a, b), lambda a, b: 1 - _dot_rows(a, b), _bulk_ip, term=_PRODUCT, finish=_LESS),
    "cosine": Space("cosine", lambda a, b: F.lit(1.0) - inner_product(a, b), lambda a, b: 1 - _dot_rows(a, b), _bulk_ip, unit_rows, normalize, _PRODUCT, _LESS),
    # components of 0 to 255 in arrays of short: integer sums, exact in doubles
    "l2_bytes": Space("l2_bytes", lambda a, b: _fold(a, b, _SQUARE).cast("long").cast("double"), _l2_rows, _bulk_l2, term=_SQUARE, finish=lambda c: c.cast("long").cast("double")),
}
