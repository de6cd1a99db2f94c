"""Repeated byte strings, by longest-previous-factor arrays in suffix order.

A position is covered if a string of ``length`` bytes over it also starts
elsewhere. All suffixes of a corpus can't be sorted at once, so suffixes are
brought together by anchors:

1. Every string of ``length`` bytes has an anchor: its substring of ``GRAM`` bytes
   with the least hash, the first of equals. Equal strings have equal anchors at
   the same place. Strings of a document with one anchor form a run.
2. Runs are counted by anchor and by the digest of their bytes, in parts on each
   task first, so that a passage of very many documents is one row a task. Runs
   of one digest repeat as a whole. Anchors that occur with several contents may
   repeat in part: one run of each content is looked at byte by byte.
3. Their contents are joined to one text for each slice of anchors. Prefix
   doubling sorts its suffixes, cut to ``length`` bytes; common prefixes of
   neighbours and, for each suffix, the previous and the next one in suffix order
   that start at a smaller position give the longest previous factor of every
   position and where it started before. A string whose factor has ``length``
   bytes is a later copy; its source is an earlier one. ``keep_first`` removes the
   later copies only, else the sources go too.

Anchors with more than ``HOT`` contents are dealt string by string instead, by the
strings' digests, so that no task needs to hold them; the first of equal strings
by place is then the one without a previous factor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import HOT_LEAST, HOT_SHARE, checkpointed, join_by_class, slices, strings, written
from nearfield.llm.shingles import mix

LENGTH, GRAM = 200, 32
#: Bytes that are hashed at a time, bytes of contents that are ranked at a time.
BLOCK, RANKED = 1 << 20, 1 << 20
#: Contents of one anchor beyond which its strings are counted by hash.
HOT = 20_000
_LOW = np.uint64((1 << 24) - 1)


_R = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            inverse = pow(_R, -1, 1 << 64)
            self.up, self.down = (np.full(size, r, np.uint64) for r in (_R, inverse))
            for table in (self.up, self.down):
                table[0] = 1
                np.cumprod(table, out=table)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _prefix_sums(b: np.ndarray) -> np.ndarray:
    up, _ = _powers.upto(len(b) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    out, have = keys, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(keys) - width + 1], out[width - have :]) if width > have else out


def anchored_runs(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, strings, anchor's hash) of each run."""
    sums = _prefix_sums(b)
    at = np.arange(len(b) - gram + 1)
    grams = _hashes(sums, at, at + gram)
    anchor = (_least((grams & ~_LOW) | at.astype(np.uint64), length - gram + 1) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(first, len(anchor)))
    return first, size, grams[anchor[first]]


#: Kinds of rows that are dealt: a run, one run for several equal ones of its slice, and a span that the others cover.
ALONE, FIRST, SPAN = 0, 1, 2


def runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, hash, fp, content, start, size, kind) of every run of every document of ``id, hash, text``.

    Equal runs of one slice of documents repeat whatever other slices hold: only
    the first, by id, hash and start, is dealt by its anchor. The others are
    spans already, joined where they touch, so that a string of very many
    documents is a row for each slice, not for each document. ``content`` is the
    MD5 digest of a run's bytes; a span has neither anchor nor content, and
    ``size`` is its length.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, parts, digests = [], [], []
            for i, text in enumerate(strings(batch.column("text"))):
                data = text.encode("utf-8", "surrogatepass")
                b = np.frombuffer(data, np.uint8)
                for top in range(0, max(0, len(b) - length + 1), BLOCK):
                    first, size, fp = anchored_runs(b[top : top + BLOCK + length - 1], length, gram)
                    parts.append((first + top, size, fp))
                    row.append(np.full(len(first), i))
                    digests += [hashlib.md5(data[x:y]).digest() for x, y in zip((first + top).tolist(), (first + top + size - 1 + length).tolist(), strict=True)]
            if not parts:
                continue
            first, size, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            content = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            row = np.concatenate(row)
            place = np.empty(batch.num_rows, np.int64)
            keys = pa.table([batch.column("id"), batch.column("hash")], ["id", "hash"])
            place[pc.sort_indices(keys, [("id", "ascending"), ("hash", "ascending")], null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
            order = np.lexsort((first, place[row], content[:, 1], content[:, 0]))
            again = np.concatenate([[False], (content[order][1:] == content[order][:-1]).all(1)])
            what = np.full(len(first), ALONE, np.int8)
            what[order[:-1][again[1:]]] = FIRST
            what[order[again]] = SPAN
            kept, gone = np.flatnonzero(what != SPAN), np.flatnonzero(what == SPAN)
            # spans come by document and start; their ends rise with their starts
            end = first[gone] + size[gone] - 1 + length
            opens = np.concatenate([[True], (row[gone][1:] != row[gone][:-1]) | (first[gone][1:] > end[:-1])])[: len(gone)]
            start_at = np.flatnonzero(opens)
            end = end[np.append(start_at[1:], len(gone)) - 1] if len(gone) else end
            spans = gone[start_at]
            at = pa.array(np.concatenate([row[kept], row[spans]]))
            none = [None] * len(spans)
            columns = [
                pa.array(fp[kept].view(np.int64).tolist() + none, pa.int64()),
                pa.array([digests[i] for i in kept.tolist()] + none, pa.binary()),
                pa.array(np.concatenate([first[kept], first[spans]])),
                pa.array(np.concatenate([size[kept], end - first[spans]])),
                pa.array(np.concatenate([what[kept], what[spans]])),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("hash").take(at), *columns], ["id", "hash", "fp", "content", "start", "size", "kind"])

    return docs.mapInArrow(run, f"id {kind}, hash bigint, fp bigint, content binary, start bigint, size bigint, kind tinyint")


class SuffixOrder:
    """Ranks of a text's suffixes cut to 8, 16, 32 ... and ``length`` bytes, by prefix doubling (those near the end are padded)."""

    def __init__(self, text: np.ndarray, length: int) -> None:
        self.length, n = length, len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.words = np.zeros(n, np.uint64)
        have = min(8, length)
        for k in range(have):
            self.words |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.levels = [(have, np.unique(self.words, return_inverse=True)[1].astype(np.int32))]
        while have < length:
            step, rank = min(have, length - have), self.levels[-1][1].astype(np.int64)
            ahead = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n]
            values = rank * (n + 1) + ahead + 1
            order = np.argsort(values)
            ordered = values[order]
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            have += step
            self.levels.append((have, rank.astype(np.int32)))

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1][1]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``p`` and ``q`` have in common, ``length`` at most."""
        out, last = np.zeros(len(p), np.int64), len(self.words) - 1
        same = self.rank[p] == self.rank[q]
        for size, rank in reversed(self.levels[:-1]):
            more = rank[np.minimum(p + out, last)] == rank[np.minimum(q + out, last)]
            out += size * more
        differ = self.words[np.minimum(p + out, last)] ^ self.words[np.minimum(q + out, last)]
        for k in range(1, 8):
            out += differ >> np.uint64(64 - 8 * k) == 0
        return np.where(same, self.length, np.minimum(out, self.length - 1))


def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, source) of each suffix, as they are sorted in ``order`` (their positions).

    ``common[i]`` are the bytes that suffixes ``i - 1`` and ``i`` share. The nearest
    suffix before and the nearest after with a smaller position share most with a
    suffix, of all that start before it; ``source`` is the position of the better
    one, -1 without any. Both are found by jumps over suffixes that are jumped
    over themselves, with the least common prefix of each jump.
    """

    def nearest_smaller(at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to, least = np.arange(-1, len(at) - 1), shared.copy()
        open_ = np.flatnonzero((to >= 0) & (at[to] > at))
        while len(open_):
            over = to[open_]
            least[open_], to[open_] = np.minimum(least[open_], least[over]), to[over]
            open_ = open_[(to[open_] >= 0) & (at[to[open_]] > at[open_])]
        return np.where(to >= 0, at[to], -1), np.where(to >= 0, least, 0)

    before, shares = nearest_smaller(order, common)
    after, shares_after = nearest_smaller(order[::-1], np.concatenate([[0], common[:0:-1]]))
    after, shares_after = after[::-1], shares_after[::-1]
    better = shares_after > shares
    return np.where(better, shares_after, shares), np.where(better, after, before)


def repeated(contents: list[bytes], length: int, keep_first: bool) -> list[np.ndarray]:
    """For each content, which of its strings of ``length`` bytes also occur in another place of ``contents``, or before."""
    text = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes) - sizes
    strings_of = np.maximum(0, sizes - length + 1)
    at = np.repeat(begin - (np.cumsum(strings_of) - strings_of), strings_of) + np.arange(strings_of.sum())
    suffixes = SuffixOrder(text, length)
    order = at[np.argsort(suffixes.rank[at], kind="stable")]
    common = np.concatenate([[0], suffixes.common(order[:-1], order[1:])])
    factor, source = longest_previous_factors(order, common)
    later = factor >= length
    flags = np.zeros(len(text), bool)
    flags[order[later]] = True
    if not keep_first:
        flags[source[later]] = True
    return np.split(flags[at], np.cumsum(strings_of)[:-1])


def _spans(id_, hash_, start: int, flags: np.ndarray, length: int) -> list[tuple]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(id_, hash_, start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _contents(cands: DataFrame, packed_docs: DataFrame, length: int) -> DataFrame:
    """``cands`` with the bytes of each run."""
    lists = cands.groupBy("id", "hash").agg(F.collect_list(F.struct("fp", "start", "size", "hot")).alias("runs"))
    joined = packed_docs.join(lists, _same(packed_docs, lists)).select(lists["id"], lists["hash"], "data", "runs")
    kind = cands.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in slices(batches, "data"):
            row, found = [], []
            for i, (data, taken) in enumerate(zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                text = opened.decompress(data)
                for r in taken:
                    row.append(i)
                    found.append((r["fp"], r["start"], r["hot"], text[r["start"] : r["start"] + r["size"] - 1 + length]))
                if len(found) > 8192 or i == batch.num_rows - 1 and found:
                    fp, start, hot, content = zip(*found, strict=True)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("hash").take(at), pa.array(fp, pa.int64()), pa.array(start, pa.int64()), pa.array(hot, pa.bool_()), pa.array(content, pa.binary())], ["id", "hash", "fp", "start", "hot", "content"])
                    row, found = [], []

    return joined.mapInArrow(run, f"id {kind}, hash bigint, fp bigint, start bigint, hot boolean, content binary")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])


def _partial_spans(contents: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of runs that repeat in part: each slice of whole anchors is ranked as one text."""
    rows = contents.repartition("fp").sortWithinPartitions("fp", "id", "hash", "start")
    kind = contents.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "fp", "start", "content")), strict=True):
                if size > RANKED and row[2] != last:
                    yield from ranked(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[2]
        if held:
            yield from ranked(held)

    def ranked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for (i, h, _, start, _), flags in zip(rows, repeated([r[4] for r in rows], length, keep_first), strict=True):
            if flags.any():
                out += _spans(i, h, start, flags, length)
        if out:
            i, h, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, id_type(rows)), pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "hash", "start", "end"])

    def id_type(rows: list[tuple]) -> pa.DataType | None:
        return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)

    return rows.select("id", "hash", "fp", "start", "content").mapInArrow(run, f"id {kind}, hash bigint, start bigint, end bigint")


def _hot_spans(contents: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for anchors of very many contents: their strings are counted by two hashes, in parts on each task first."""
    each = F.transform(F.sequence(F.lit(0), F.octet_length("content") - length), lambda k: F.struct(k.alias("k"), F.md5(F.substring(F.col("content"), k + 1, F.lit(length))).alias("w")))
    rows = contents.select("id", "hash", "start", F.explode(each).alias("x")).select("id", "hash", (F.col("start") + F.col("x.k")).alias("start"), F.col("x.w").alias("w"))
    first = F.min(F.struct("id", "hash", "start"))
    counted = rows.groupBy("w").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    found = rows.join(counted, "w")
    if keep_first:
        found = found.where(F.struct("id", "hash", "start") > F.col("first"))
    return found.select("id", "hash", F.col("start").cast("long").alias("start"), (F.col("start") + length).cast("long").alias("end"))


def _packed(docs: DataFrame) -> DataFrame:
    """(id, hash, data): the texts' bytes, compressed, as they are shuffled."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            data = [closed.compress(t.encode("utf-8", "surrogatepass")) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(data, pa.binary())], ["id", "hash", "data"])

    return docs.mapInArrow(run, f"id {kind}, hash bigint, data binary")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """(id, hash, start, end) byte spans, which may overlap, that strings of ``length`` bytes with another start cover.

    With ``keep_first``, only strings that started before, in the order of key,
    hash of the text and position. ``hash`` is xxhash64 of the text.
    """
    if not 0 < gram <= length < 4096:
        raise ValueError("0 < gram <= length < 4096")
    source = _keyed(docs, text, key)
    return _found(source, _packed(source), length, gram, keep_first, hot)


def _found(source: DataFrame, packed_docs: DataFrame, length: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    every = written(runs(source, length, gram), "runs")
    spans = every.where(F.col("kind") == SPAN).select("id", "hash", "start", (F.col("start") + F.col("size")).alias("end"))
    single = every.where(F.col("kind") != SPAN)
    # most anchors occur once and go no further
    anchors = single.groupBy("fp").agg(F.count("*").alias("copies"), F.max("kind").alias("most")).where((F.col("copies") > 1) | (F.col("most") == FIRST))
    anchors = written(anchors.select("fp", "copies"), "anchors")
    most = max(HOT_LEAST, (anchors.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE)
    common = anchors.where(F.col("copies") > most)
    if keep_first or common.isEmpty():  # which copy is the first takes an order of all of them
        rows = _told_apart(single.join(anchors.select("fp"), "fp"))
    else:
        rare = single.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(anchors.where(F.col("copies") <= most).select("fp"), "fp")
        rows = _told_apart(rare).unionByName(_told_apart_in_place(single.join(F.broadcast(common.select("fp")), "fp")))
    rows = written(rows, "told")
    whole = rows.where("nth > 1" if keep_first else "again").select("id", "hash", "start", (F.col("start") + F.col("size") - 1 + length).alias("end")).unionByName(spans)
    cands = rows.where("contents > 1 and nth = 1").select("id", "hash", "fp", "start", "size", (F.col("contents") > hot).alias("hot"))
    bytes_of = _contents(cands, packed_docs, length)
    if cands.where("hot").isEmpty():
        return whole.unionByName(_partial_spans(bytes_of, length, keep_first))
    bytes_of = checkpointed(bytes_of)
    return whole.unionByName(_partial_spans(bytes_of.where("not hot"), length, keep_first)).unionByName(_hot_spans(bytes_of.where("hot"), length, keep_first))


def _told_apart(rows: DataFrame) -> DataFrame:
    """(id, hash, fp, start, size, again, nth, contents) of runs: whether their content repeats, the how many-th of it they are, and how many contents their anchor has."""
    of_anchor, of_content = Window.partitionBy("fp"), Window.partitionBy("fp", "content")
    rows = rows.withColumn("again", (F.count("*").over(of_content) > 1) | (F.max("kind").over(of_content) == FIRST))
    rows = rows.withColumn("nth", F.row_number().over(of_content.orderBy("id", "hash", "start")))
    return rows.withColumn("contents", F.sum((F.col("nth") == 1).cast("long")).over(of_anchor)).select("id", "hash", "fp", "start", "size", "again", "nth", "contents")


def _told_apart_in_place(rows: DataFrame) -> DataFrame:
    """The same for the runs of anchors with a large share of all runs, which stay where they are; ``nth`` is 1 for the first and 2 for others."""
    place = F.struct("id", "hash", "start")
    contents = rows.groupBy("fp", "content").agg(F.count("*").alias("copies"), F.max("kind").alias("most"), F.min(place).alias("first"))
    contents = checkpointed(contents)
    several = F.broadcast(contents.groupBy("fp").agg(F.count("*").alias("contents")))  # no more rows than there are such anchors
    told = join_by_class(rows.select("id", "hash", "fp", "start", "size", "content"), contents.drop("fp"), "content").join(several, "fp")
    again = (F.col("copies") > 1) | (F.col("most") == FIRST)
    return told.select("id", "hash", "fp", "start", "size", again.alias("again"), F.when(place == F.col("first"), 1).otherwise(2).alias("nth"), "contents")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, hot: int = HOT, kept_bytes: bool = True) -> DataFrame:
    """One row for each row of ``docs``: key, ``n_bytes``, ``spans`` (maximal removed runs), ``kept_sha256`` and ``kept``.

    ``kept`` are the bytes outside the spans, joined (left out if ``kept_bytes``
    is false). Null texts are empty. Texts shorter than ``length`` lose nothing;
    rows that repeat key and text repeat each other. An empty table gives no rows;
    other columns are ignored. Texts are shuffled once, compressed; besides them
    only hashes and the contents of runs that repeat in part are.
    """
    source = _keyed(docs, text, key)
    packed_docs = _packed(source)
    spans = _found(source, packed_docs, length, gram, keep_first, hot)
    lists = spans.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = packed_docs.join(lists, _same(packed_docs, lists), "left").select(packed_docs["id"], "data", "spans")
    kind = source.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in slices(batches, "data"):
            out = []
            for data, taken in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                b = opened.decompress(data)
                gone = merged([(s["start"], s["end"]) for s in taken or ()])
                rest = b"".join(b[x:y] for (_, x), (y, _) in zip([(0, 0), *gone], [*gone, (len(b), 0)], strict=True)) if gone else b
                out.append((len(b), [{"start": x, "end": y} for x, y in gone], hashlib.sha256(rest).hexdigest(), rest if kept_bytes else None))
            n, gone, sha, rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, span), pa.array(sha, pa.string()), pa.array(rest, pa.binary())], ["id", "n_bytes", "spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(run, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", key)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, as ``remove_repeats`` decides; null texts have no bytes, an empty table gives no rows."""
    rows = remove_repeats(docs, kept_bytes=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
