"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to 3 characters of
lower-cased words with a blank at either end), most frequent first. A document's
own profile is compared with each language's by out-of-place distance: the sum
over the document's n-grams of how far their ranks differ, or of the largest
distance where the language's profile lacks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import slices, strings

#: n-grams of a language's and of a document's profile; documents that a language's profile is learned from at most.
PROFILE_SIZE, DOCUMENT_SIZE, TRAIN_DOCS = 500, 300, 2000
UNKNOWN = "und"
#: Characters that are counted at a time.
BLOCK = 1 << 20
SPACE = 32

Profiles = dict[str, list[int]]


@cache
def _letters() -> np.ndarray:
    """By code point: the code point if it is a letter, a blank otherwise."""
    points = np.arange(0x110000, dtype=np.int64)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, SPACE)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, and how often each occurs; empty if it has no letter.

    An n-gram is an integer: its code points in base 2**21. Blocks are counted
    one by one, with two characters of overlap that no n-gram counts twice.
    """
    lower, seen = text.lower(), []
    for start in range(0, len(lower), BLOCK):
        with_before = lower[max(0, start - 2) : start + BLOCK]
        c = _letters()[np.frombuffer(with_before.encode("utf-32-le", "surrogatepass"), "<u4")]
        fresh = start - max(0, start - 2)  # n-grams are counted where their last character is
        if start == 0:
            c, fresh = np.concatenate([[SPACE], c]), 1
        if start + BLOCK >= len(lower):
            c = np.append(c, SPACE)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)  # runs of blanks count as one
        fresh, c = int(keep[:fresh].sum()), c[keep]
        two, three = (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        whole = c[1:-1] != SPACE  # no word's end and the next one's start together
        grams = [c[fresh:][c[fresh:] != SPACE], two[max(0, fresh - 1) :], three[max(0, fresh - 2) :][whole[max(0, fresh - 2) :]]]
        seen.append(np.unique(np.concatenate(grams), return_counts=True))
    if not seen:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(seen) == 1:
        values, counts = seen[0]
    else:
        values, back = np.unique(np.concatenate([v for v, _ in seen]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([n for _, n in seen])).astype(np.int64)
    return (values, counts) if (values != SPACE).any() and not (values <= SPACE).all() else (values[:0], counts[:0])


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by value."""
    return values[np.lexsort((values, -counts))[:size]]


class Classifier:
    def __init__(self, profiles: Profiles, size: int = DOCUMENT_SIZE) -> None:
        self.names, self.size = sorted(profiles), size
        self.sorted = []
        for name in self.names:
            p = np.array(profiles[name], np.int64)
            order = np.argsort(p)
            self.sorted.append((p[order], order))
        self.far = max([PROFILE_SIZE, *map(len, profiles.values())])

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 - its distance over the largest one."""
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        ranks, best = np.arange(len(own)), (UNKNOWN, np.inf)
        for name, (values, places) in zip(self.names, self.sorted, strict=True):
            if not len(values):
                continue
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            distance = np.where(values[at] == own, np.abs(places[at] - ranks), self.far).sum()
            if distance < best[1]:
                best = name, float(distance)
        return best[0], max(0.0, 1 - best[1] / (self.far * len(own)))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = PROFILE_SIZE, documents: int = TRAIN_DOCS) -> Profiles:
    """Profiles from whole texts of at most ``documents`` rows a language: those with the smallest hash of ``key``.

    The sample is the bounded one that a classifier may be fitted on: a hash of
    the key, compared with the count of the language, picks it without ranking
    all rows, and n-gram counts are summed before they are shuffled. Rows without
    key are told apart by their text; rows that repeat a key are taken or left
    together. What is broadcast has a row a language, or ``documents``. Rows
    without language or text teach nothing. The result has one short list
    for each language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).agg(F.count("*").alias("_rows"))
    # a hash between 0 and 1 lets about a fifth more than needed of each language through; these few are ranked
    rows = rows.withColumn("_own", F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)))
    place = F.pmod("_own", F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.select(lang, key, "_own", place.alias("_place")).join(F.broadcast(counts), lang).where(F.col("_place") * F.col("_rows") <= 1.2 * documents + 50)
    order = Window.partitionBy(lang).orderBy("_place", key)
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= documents).select(lang, key, "_own").distinct()
    sample = rows.select(lang, key, "_own", text).join(F.broadcast(chosen), (rows[lang] == chosen[lang]) & (rows["_own"] == chosen["_own"]) & rows[key].eqNullSafe(chosen[key]), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for name, x in zip(batch.column(lang).to_pylist(), strings(batch.column(text)), strict=True):
                by.setdefault(name, []).append(ngrams(x))
            for name, found in by.items():
                values, back = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n for _, n in found]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    counted = sample.select(F.col(lang), F.col(text)).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in best.collect():  # size rows a language
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {name: [g for _, g in sorted(found)] for name, found in profiles.items()}


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A text that is null or has no letters is ``und`` with score 0, as is every
    text where there are no profiles. Repeated rows stay, an empty table stays
    empty, input columns of these names are replaced. One narrow pass.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = docs.select(*keep, *([text] if text not in keep else []))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles).predict
        for batch in slices(batches, text):
            found = [classify(x) for x in strings(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """``doc_id``, whether it was held out of learning, ``lang_pred`` and ``score``, for every row."""
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles, keep=["doc_id", "held_out"])
