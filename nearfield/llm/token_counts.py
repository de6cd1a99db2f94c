"""Token counts by prefix dynamic programming.

The encoding of a text's first ``i`` characters ends in one piece ``t``, and what
is before it is the encoding of the first ``i - len(t)`` characters: so
``n[i] = n[i - len(t)] + 1``, where ``t`` is the one piece that may follow the
last piece there. Two pieces may stand side by side if no merge joins them, which
the order of the merges inside both tells (``Merges``); nothing is encoded for it.
No piece crosses the border of a chunk (see ``piece_codec``), so the recurrence is
solved once for each distinct chunk, and a text's counts at every prefix are the
running sums of its chunks' differences. Totals, truncation and budgets are
look-ups in that table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import slices, strings
from nearfield.llm.piece_codec import MARK, ChunkTable, marked_chunks, model_path

#: Chunks whose differences are summed at a time; pairs of pieces that are remembered.
BLOCK, PAIRS = 1 << 16, 1 << 20
#: Distinct chunks whose differences a worker holds; pieces by which a model is probed.
COUNTED, PROBED = 500_000, 500
#: Characters of a chunk's head, and heads whose solution is remembered.
HEAD, HEADS = 6, 1 << 15
_NEVER = float("-inf")


class Merges:
    """Which pieces of a BPE model arise, and which may stand side by side.

    Merges are taken by score, the leftmost of equals first. A piece's own merges
    are in the same order wherever it stands, so their order gives, for each side,
    the outermost symbol at every time. Two pieces stay apart if at no time the
    pair of symbols at their border is a piece of a higher score than both sides'
    next merges.
    """

    def __init__(self, sp) -> None:
        n = sp.get_piece_size()
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.first_unknown = n  # single characters that are no piece follow
        if not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the model has no byte pieces for unknown characters")
        #: Pieces by their characters from the last to the first; "" leads to a piece's id.
        self.endings: dict = {}
        for p, i in self.ids.items():
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.pieces = {i: p for p, i in self.ids.items()}
        self.sides: dict[int, tuple | None] = {}
        self.apart: dict[int, bool] = {}
        self.heads: dict[str, tuple[list, list]] = {}

    def _text(self, i: int) -> str:
        return self.pieces[i] if i < self.first_unknown else chr(i - self.first_unknown)

    def _sides(self, i: int) -> tuple | None:
        """(first symbols, last symbols, scores of the next merges) over time; None if merging doesn't give the piece."""
        if i not in self.sides:
            piece = self._text(i)
            s, first, last, scores = list(piece), [piece[0]], [piece[-1]], []
            while len(s) > 1:
                best, at = _NEVER, -1
                for k in range(len(s) - 1):
                    score = self.scores.get(s[k] + s[k + 1], _NEVER)
                    if score > best:
                        best, at = score, k
                if at < 0:
                    break
                s[at : at + 2] = [s[at] + s[at + 1]]
                first.append(s[0]), last.append(s[-1]), scores.append(best)
            scores.append(_NEVER)
            self.sides[i] = (first, last, scores) if len(s) == 1 else None
        return self.sides[i]

    def arises(self, i: int) -> bool:
        return self._sides(i) is not None

    def may_follow(self, i: int, j: int) -> bool:
        """Whether piece ``j`` may stand right after piece ``i``, -1 for nothing."""
        key = i << 24 | j
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            found = self.apart[key] = self.arises(j) if i < 0 else self._stay_apart(self._sides(i), self._sides(j))
        return found

    def _stay_apart(self, a: tuple | None, b: tuple | None) -> bool:
        if a is None or b is None:
            return False
        p = q = 0
        while True:
            left, right = a[2][p], b[2][q]
            border = self.scores.get(a[1][p] + b[0][q], _NEVER)
            if border > left and border >= right and border > _NEVER:
                return False
            if left == right == _NEVER:
                return True
            if left >= right:
                p += 1
            else:
                q += 1

    def prefixes(self, chunk: str) -> list[int] | None:
        """Tokens of every prefix of a chunk, 0 characters included, in time linear in its length; None if some prefix has no encoding."""
        endings, apart, may_follow = self.endings, self.apart, self.may_follow
        head = chunk[:HEAD]
        if len(chunk) > HEAD and head in self.heads:  # chunks that begin alike are solved alike
            n, last = map(list.copy, self.heads[head])
        else:
            n, last = [0], [-1]  # tokens of each prefix, and its last piece
        for i in range(len(n), len(chunk) + 1):
            if i == HEAD + 1 and head not in self.heads:
                if len(self.heads) > HEADS:
                    self.heads.clear()
                self.heads[head] = n.copy(), last.copy()
            node, at, found = endings, i, []
            while at:
                at -= 1
                node = node.get(chunk[at])
                if node is None:
                    break
                if "" in node:
                    found.append((at, node[""]))
            for at, t in reversed(found):
                fits = apart.get(last[at] << 24 | t)
                if fits is None:
                    fits = may_follow(last[at], t)
                if fits:
                    n.append(n[at] + 1)
                    last.append(t)
                    break
            else:
                c = chunk[i - 1]
                if c in self.ids:
                    return None
                n.append(n[i - 1] + len(c.encode("utf-8", "surrogatepass")))
                last.append(self.first_unknown + ord(c))
        return n


class CountTable(ChunkTable):
    """Entries: by how many tokens each character of a chunk changes the count, as 32-bit integers.

    The recurrence is held to the library once, on pieces from all over the model,
    and on pairs of them: ``ValueError`` if the model doesn't merge by score.
    """

    def __init__(self, path: str, size: int = COUNTED) -> None:
        super().__init__(path, size)
        self.merges = Merges(self.sp)
        pieces = [p for p in self.merges.ids if MARK not in p][:: max(1, len(self.merges.ids) // PROBED)]
        probes = [MARK + p + q for p, q in zip(pieces, pieces[1:] + pieces[:1], strict=True)]
        if [(n or [-1])[-1] for n in map(self.merges.prefixes, probes)] != list(map(len, self.ids(probes))):
            raise ValueError(f"{path}: the model doesn't merge by score")

    def segmented(self, chunks: list[str]) -> list[bytes]:
        out = []
        for n in map(self.merges.prefixes, chunks):
            if n is None:
                raise ValueError("a chunk has no encoding")
            out.append(array("i", map(sub, n[1:], n)).tobytes())
        return out

    def prefixes(self, text: str) -> PrefixCounts:
        return PrefixCounts(self._sums(marked_chunks(text)), text)

    def _sums(self, chunks: list[str]) -> np.ndarray:
        parts, base = [np.zeros(1, np.int64)], 0
        for at in range(0, len(chunks), BLOCK):
            parts.append(np.cumsum(np.frombuffer(b"".join(self.entries(chunks[at : at + BLOCK])), np.int32), dtype=np.int64) + base)
            base = parts[-1][-1]
        return np.concatenate(parts)


class PrefixCounts:
    """Exact token counts of all prefixes of one text (without begin or end ids), stored."""

    def __init__(self, marked: np.ndarray, text: str) -> None:
        # the marked text has one character more, which an empty prefix lacks
        self.counts = np.concatenate([marked[:1], marked[2:]]) if text else marked[:1]

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``."""
        return int(self.counts[min(max(chars, 0), len(self.counts) - 1)])

    def every(self) -> list[int]:
        """``[at(0), ..., at(len(text))]``."""
        return self.counts.tolist()

    def fit(self, budget: int) -> int:
        """The longest prefix, in characters, of at most ``budget`` tokens (0 also for a negative budget); a longer prefix may have fewer tokens than a shorter one."""
        return len(self.counts) - 1 if self.total <= budget else int(np.flatnonzero(self.counts <= max(budget, 0))[-1])


@lru_cache(1)
def _counter(path: str) -> CountTable:
    """A worker's table, which its next task goes on with."""
    return CountTable(path)


def count_tokens(docs: DataFrame, text: str = "text", budget: int | None = None, model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``n_tokens`` (long) and, if ``budget`` is given, ``fit_chars`` (long).

    ``n_tokens`` is the library's count of the whole text without begin or end
    ids; ``fit_chars`` the longest prefix within the budget. A null or empty
    text has 0 tokens. Repeated rows stay, an empty table stays empty, input
    columns of these names are replaced. One narrow pass without shuffle.
    """
    path = model or model_path()
    added = ["n_tokens", *(["fit_chars"] if budget is not None else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*keep, *([text] if text not in keep else []))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches, text):
            total, fit = [], []
            for x in strings(batch.column(text)):
                counts = counter.prefixes(x)
                total.append(counts.total)
                if budget is not None:
                    fit.append(counts.fit(budget))
            more = [pa.array(x, pa.int64()) for x in ([total] if budget is None else [total, fit])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], [*keep, *added])

    return source.mapInArrow(run, schema)


def report(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``fit_chars``, the longest prefix within ``limit``.

    A null text is empty: no bytes, no tokens. Repeated rows and rows without
    ``doc_id`` are reported each; an empty table gives no rows.
    """
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, budget=limit, model=model, keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
