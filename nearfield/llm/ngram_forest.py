"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Each text's shingle set gets a signature; texts of one set are one class.
2. Each of ``tries`` prefix tries holds the classes sorted by their signature's
   ``MAX_DEPTH`` minhashes of that trie. A trie is dealt by its shortest prefix
   (``depth_for``: by which any pair at the threshold meets with the target
   recall, whatever the data are), and the sorted order tells at which depth
   neighbours part. An edge joins two classes below one node, with the node's
   depth; edges of a depth or more connect all that meet there. A short sketch
   drops node mates that are far apart, with a margin of six standard deviations.
3. The longest prefixes come first: what their edges connect is a group, and every
   pair of a group is decided by the exact intersection of its sets of words. The
   similarities found tell, by the chance of each to meet at that depth, how many
   links shorter prefixes would still find. While that is more than the target
   allows, prefixes are shortened and the groups that grew are verified anew.

Large groups' sets meet in tiles. No step makes one row for each pair: a task
returns link counts, the edges that connect its classes and a histogram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import checkpointed, components, join_by_class, slices, strings, written
from nearfield.llm.embedding_dedup import Forest
from nearfield.llm.shingles import WORDS, WordTable, exact_sets, hashed_sets, mix, split_words

THRESHOLD, TARGET = 0.8, 0.99999
TRIES, MAX_DEPTH = 24, 8
#: Levels below the shortest prefix, each 16 bits of a row's tail; recall at the threshold with which prefixes are first taken.
LEVELS, FIRST = 4, 0.9
#: Minhashes of a sketch, of which it keeps four bits each.
SKETCH = 64
#: Members of a node beyond which they are joined as they are sorted, without their sketches: all meet in the verification.
NODE = 16384
#: Shingles and classes of a tile, about; classes for which a group has one more tile, up to so many; cells of a product's block; sets that hold a shingle for it to be in the product.
TILE, TILE_CLASSES, SPLIT, SPLITS, CELLS, FREQUENT = 1_500_000, 3000, 200, 12, 1 << 23, 24
#: Bins of similarity from the threshold to 1.
BINS = 40


def meeting(similarity: float, depth: int, tries: int = TRIES) -> float:
    """The chance that a pair shares a prefix of ``depth`` minhashes in some trie."""
    return 1 - (1 - similarity**depth) ** tries


def depth_for(threshold: float, tries: int = TRIES, max_depth: int = MAX_DEPTH, target: float = TARGET) -> int:
    """The deepest prefix by which pairs at the threshold still meet with the target recall."""
    for depth in range(max_depth, 1, -1):
        if meeting(threshold, depth, tries) >= target:
            return depth
    return 1


def first_depth(threshold: float, floor: int, tries: int = TRIES) -> int:
    """The deepest prefix to begin with; at most ``LEVELS`` below the shortest one."""
    return max(d for d in range(floor, min(MAX_DEPTH, floor + LEVELS) + 1) if d == floor or meeting(threshold, d, tries) >= FIRST)


def needed_depth(links: list[int], depth: int, floor: int, threshold: float, tries: int = TRIES, target: float = TARGET) -> int:
    """The deepest prefix, ``depth`` at most, that leaves no more than 1 - target of all links unmet.

    ``links`` are those found at ``depth`` by bin of similarity. A link that meets
    with chance p stands for 1/p links; the lower end of each bin counts. One link
    more, at the threshold, is taken as given, so that few links don't make sure.
    """
    low = [threshold + (1 - threshold) * i / BINS for i in range(BINS)]
    every = [n / meeting(s, depth, tries) for n, s in zip(links, low, strict=True)]
    every[0] += 1
    for d in range(depth, floor, -1):
        if sum(n * (1 - meeting(s, d, tries)) for n, s in zip(every, low, strict=True)) <= (1 - target) * sum(every):
            return d
    return floor


def _multipliers(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(hashes: np.ndarray, cut: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minima of each set, all of them not empty, under each hash function: (sets, functions)."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(multipliers[0]), len(cut) - 1), np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    for k, (m, a) in enumerate(zip(*multipliers, strict=True)):
        np.multiply(low, m, out=x)
        np.add(x, a, out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x85EBCA6B), out=x)
        np.minimum.reduceat(x, cut[:-1], out=out[k])
    return out.T


def _least_share(threshold: float) -> int:
    """Equal places of two sketches below which a pair is dropped."""
    share = threshold + (1 - threshold) / 16
    return int(np.floor(SKETCH * share - 6 * np.sqrt(SKETCH * share * (1 - share))))


def _hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def digests(docs: DataFrame, text: str, key: str, floor: int, tries: int, words: int) -> DataFrame:
    """(id, hash, node, size, keys, tails, sketch, data): ``node`` is the digest of the shingle set, null without shingles; ``hash`` that of the text, ``data`` its words, compressed.

    ``keys`` name each trie's shortest prefix, ``tails`` hold 16 bits of each minhash below it, the next one uppermost.
    """
    source = docs.select(F.col(key).alias("id"), _hash(text).alias("hash"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    deep = floor + LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, table, closed = _multipliers(max(tries * deep, SKETCH)), WordTable(), zstandard.ZstdCompressor(level=1)
        with np.errstate(over="ignore"):
            weights = mix(np.arange(1, floor + 1, dtype=np.uint64)) | np.uint64(1)
            names = mix(np.arange(1, tries + 1, dtype=np.uint64) * np.uint64(977))
            for batch in slices(batches, "text"):
                split = [split_words(t) for t in strings(batch.column("text"))]
                found, cut = hashed_sets(split, words, table)
                size = np.diff(cut)
                node, keys, tails, sketch, data = ([None] * batch.num_rows for _ in range(5))
                some = np.flatnonzero(size)
                if len(some):
                    m = signatures(np.ascontiguousarray(found[:, 0]), np.append(cut[some], len(found)), multipliers)
                    t = mix(m[:, : tries * deep].reshape(-1, tries, deep).astype(np.uint64))
                    prefix = mix((t[:, :, :floor] * weights).sum(2, dtype=np.uint64) + names).view(np.int64)
                    tail = np.zeros(t.shape[:2], np.uint64)
                    for k in range(LEVELS):
                        tail |= (t[:, :, floor + k] & np.uint64(0xFFFF)) << np.uint64(48 - 16 * k)
                    nibbles = (mix(m[:, :SKETCH].astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
                    nibbles = nibbles[:, ::2] | nibbles[:, 1::2] << 4
                    for r, i in enumerate(some.tolist()):
                        node[i], data[i] = hashlib.md5(found[cut[i] : cut[i + 1]].tobytes()).digest(), closed.compress(b" ".join(split[i]))
                        keys[i], tails[i], sketch[i] = prefix[r], tail[r].view(np.int64), nibbles[r].tobytes()
                longs = pa.list_(pa.int64())
                columns = [pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, longs), pa.array(tails, longs), pa.array(sketch, pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *columns], ["id", "hash", "node", "size", "keys", "tails", "sketch", "data"])

    return source.mapInArrow(run, f"id {kind}, hash bigint, node binary, size bigint, keys array<bigint>, tails array<bigint>, sketch binary, data binary")


def _near(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether sketches (four bits a place, in 64-bit words) share ``least`` places or more."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return x.shape[-1] * 16 - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64) >= least


def shared_levels(tails: np.ndarray) -> np.ndarray:
    """How many levels each tail, as they are sorted, shares with the one before (-1 for the first)."""
    x = tails.view(np.uint64)
    differ = x[1:] ^ x[:-1]
    return np.concatenate([[-1], sum((differ >> np.uint64(64 - 16 * k) == 0).astype(np.int64) for k in range(1, LEVELS)) + (differ == 0)])


def trie_edges(tails: np.ndarray, sketches: np.ndarray, least: int) -> tuple[list[int], list[int], list[int]]:
    """(i, j, levels): a forest over the sorted members of a shortest prefix.

    Edges of ``l`` levels or more connect just the members of each node at that
    level, those with distant sketches left apart. Deepest nodes come first.
    """
    n, shared = len(tails), shared_levels(tails)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    root = np.arange(n)
    for level in range(LEVELS, -1, -1):
        if level and not (shared == level).any():
            continue
        heads = np.flatnonzero(shared < level)
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True):
            if e - s < 2 or not (shared[s + 1 : e] == level).any():
                continue
            if n > NODE:
                for x in np.flatnonzero(root[s + 1 : e] != root[s]) + s + 1:
                    if root[x] == x:
                        out[0].append(int(x)), out[1].append(int(root[s])), out[2].append(level)
                root[s:e] = root[s]
                continue
            mine = root[s:e]
            for i in range(e - s - 1):
                if (mine == mine[0]).all():
                    break
                other = mine[i + 1 :] != mine[i]
                near = np.flatnonzero(other) + i + 1
                near = near[_near(sketches[s + near], sketches[s + i], least)]
                for met in np.unique(mine[near]).tolist():
                    if met != mine[i]:
                        low, high = min(met, int(mine[i])), max(met, int(mine[i]))
                        out[0].append(high), out[1].append(low), out[2].append(level)
                        mine[mine == high] = low
    return out


def candidate_edges(classes: DataFrame, threshold: float, floor: int) -> DataFrame:
    """(a, b, depth) edges of nodes that lie below one trie node, each with the deepest prefix that joins them so."""
    least = _least_share(threshold)
    rows = classes.select("node", "sketch", F.explode(F.arrays_zip("keys", "tails")).alias("x")).select("node", "sketch", "x.keys", "x.tails")
    rows = rows.repartition("keys").sortWithinPartitions("keys", "tails", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("keys").to_numpy()
            # the last key may go on in the next batch
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from edges([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from edges(held)

    def edges(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        keys = rows["keys"].to_numpy()
        if len(keys) < 2:
            return
        tails = rows["tails"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(keys), -1)
        size = np.diff(cut)
        two = cut[:-1][size == 2]  # most prefixes: one comparison
        two = two[_near(sketches[two], sketches[two + 1], least)]
        a, b = [two + 1], [two]
        level = [np.array([shared_levels(tails[i : i + 2])[1] for i in two.tolist()], np.int64)]
        for s, e in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist(), strict=True):
            i, j, k = trie_edges(tails[s:e], sketches[s:e], least)
            a.append(np.array(i, np.int64) + s), b.append(np.array(j, np.int64) + s), level.append(np.array(k, np.int64))
        nodes = rows["node"]
        a, b, level = (np.concatenate(x) for x in (a, b, level))
        if len(a):
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)).combine_chunks(), nodes.take(pa.array(b)).combine_chunks(), pa.array(level + floor, pa.int32())], ["a", "b", "depth"])

    return rows.mapInArrow(run, "a binary, b binary, depth int").groupBy("a", "b").agg(F.max("depth").alias("depth"))


def intersections(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Sizes of the intersections of the first ``n`` sets with the others, or of all with all if there are no others.

    Shingles of many sets are summed as a product of incidence blocks, those of
    few sets by their pairs of sets, those of one set not at all.
    """
    m = len(sets) - n if n < len(sets) else n
    base = n if n < len(sets) else 0
    out = np.zeros((n, m))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(column, minlength=len(values))
    order = np.argsort(column, kind="stable")
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    begin = np.cumsum(frequency) - frequency
    for f in range(2, FREQUENT + 1):
        at = begin[frequency == f]
        if not len(at):
            continue
        held = rows[at[:, None] + np.arange(f)]  # rising in each row, as the order is stable
        for a in range(f):
            for b in range(f):
                i, j = held[:, a], held[:, b] - base
                fits = (i < n) & (j >= 0) if base else slice(None)
                if a != b or not base:
                    np.add.at(out, (i[fits], j[fits]), 1.0)
    often = np.flatnonzero(frequency > FREQUENT)
    width = max(64, CELLS // len(sets))
    for start in range(0, len(often), width):
        part = often[start : start + width]
        block = np.zeros((len(sets), len(part)), np.float32)
        count = frequency[part]
        where = np.repeat(begin[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        block[rows[where], np.repeat(np.arange(len(part)), count)] = 1
        out += block[:n] @ block[base:].T
    return out


def verify(groups: DataFrame, threshold: float, words: int) -> DataFrame:
    """(group, tiles, a, b, n, bin) of each task.

    ``a`` is a class, ``b`` one that links connect it with, ``n`` the rows that it
    links with there; or, with ``bin``, ``n`` are the task's links between classes
    of that bin of similarity. ``groups``: (group, node, copies, data, tile, tiles);
    tasks are pairs of tiles of one group.
    """
    partners = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("p"), F.greatest("tile", t).alias("q")))
    dealt = groups.withColumn("x", F.explode(partners)).select("group", "tiles", "x.p", "x.q", (F.col("tile") != F.col("x.p")).cast("int").alias("side"), "node", "copies", "data")
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
    names = ["group", "tiles", "a", "b", "n", "bin"]

    def run(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        group, side = group.take(pa.array(order)), side[order]
        n, alone = int((side == 0).sum()), group["p"][0].as_py() == group["q"][0].as_py()
        if len(group) == 1 or not alone and n in (0, len(group)):  # the other tile has no rows
            return pa.table([pa.array([], k) for k in kinds], names)
        nodes, copies = group["node"], group["copies"].to_numpy()
        opened = zstandard.ZstdDecompressor()
        sets = exact_sets([opened.decompress(x).split() for x in group["data"].to_pylist()], words)
        sizes = np.array([len(s) for s in sets], np.float64)
        counts, forest, bins = np.zeros(len(sets), np.int64), Forest(len(sets)), np.zeros(BINS, np.int64)
        base = 0 if alone else n
        inter = intersections(sets, n)
        for top in range(0, n, 256):
            part = inter[top : top + 256]
            union = sizes[top : top + len(part), None] + sizes[None, base:] - part
            i, j = np.nonzero(part >= threshold * union - 1e-6)
            similarity = part[i, j] / union[i, j]
            i, j = i + top, j + base
            if alone:
                once = i < j
                i, j, similarity = i[once], j[once], similarity[once]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            forest.link(i, j)
            at = np.minimum(BINS - 1, np.maximum(0, (similarity - threshold) / max(1e-9, 1 - threshold) * BINS)).astype(np.int64)
            bins += np.bincount(at, minlength=BINS)
        at, full = np.flatnonzero(counts), np.flatnonzero(bins)
        none = [None] * len(full)
        size = len(at) + len(full)
        columns = [group["group"].slice(0, 1).to_pylist() * size, group["tiles"].slice(0, 1).to_pylist() * size, nodes.take(pa.array(at)).to_pylist() + none, nodes.take(pa.array(forest.parent[at])).to_pylist() + none, [*counts[at].tolist(), *bins[full].tolist()], [None] * len(at) + full.tolist()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return dealt.groupBy("group", "p", "q").applyInArrow(run, "group binary, tiles int, a binary, b binary, n bigint, bin int")


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS, tries: int = TRIES, target: float = TARGET, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs``: ``key, class_id, n_links, component_id, kept``.

    Rows link if the Jaccard similarity of their word shingles is at least
    ``threshold``. ``class_id`` is the smallest key of the rows with the same
    shingle set, ``n_links`` how many other rows the row links with (the same set
    included), ``component_id`` the smallest key reachable by links, ``kept``
    whether that is the row's own. Texts without words (null, empty) link with
    nothing, nor do rows without key; they are kept. Repeated rows link with each
    other and are all kept or not, having one key. An empty table gives no rows.
    """
    return _decided(docs, text, key, threshold, words, tries, target, tile).drop("hash")


def _decided(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS, tries: int = TRIES, target: float = TARGET, tile: int = TILE) -> DataFrame:
    """``jaccard_join`` with the hash of each row's text."""
    floor = depth_for(threshold, tries, target=target)
    every = written(digests(docs, text, key, floor, tries, words), "digests")
    usable = every.where("node is not null and id is not null")
    classes = usable.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("tails").alias("tails"), F.first("sketch").alias("sketch"))
    classes = written(classes.select("node", "rep.*", "copies", "size", "keys", "tails", "sketch").withColumnRenamed("id", "rep"), "classes")
    verified = linked_classes(every, classes, threshold, words, tries, target, tile, floor)
    links = verified.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    # a group in one tile is settled by its task; others' parts are joined
    joined = verified.where("tiles = 1").select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    tiled = verified.where("tiles > 1 and a <> b").select("a", "b")
    if not tiled.isEmpty():
        joined = joined.unionByName(components(tiled).withColumnRenamed("id", "node"))
    lowest = joined.join(classes.select("node", "rep"), "node").groupBy("component_id").agg(F.min("rep").alias("component"))
    named = joined.join(lowest, "component_id").select("node", "component")
    result = classes.select("node", "rep", "copies").join(links, "node", "left").join(named, "node", "left")
    result = result.select("node", "rep", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = every.select("id", "hash", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    out = join_by_class(out, result, "node")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("rep", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "hash")


def linked_classes(every: DataFrame, classes: DataFrame, threshold: float, words: int, tries: int, target: float, tile: int, floor: int) -> DataFrame:
    """(tiles, a, b, n) of ``verify`` over the groups of the longest prefixes that meet the target.

    A depth's histogram of links comes to the driver: ``BINS`` numbers.
    """
    edges = checkpointed(candidate_edges(classes, threshold, floor))
    held = written(_with_words(every, classes, edges), "candidates")
    depth, before, verified = first_depth(threshold, floor, tries), None, None
    while True:
        grouped = components(edges.where(F.col("depth") >= depth).select("a", "b")).withColumnRenamed("id", "node").withColumnRenamed("component_id", "group")
        members = grouped.join(held.select("node", "size"), "node")
        # groups whose members are those of one group before are decided
        members = members.withColumn("old", F.lit(None).cast("binary")) if before is None else members.join(before, "node", "left")
        members = checkpointed(members)
        groups = members.groupBy("group").agg(F.count("*").alias("copies"), F.sum("size").alias("size"), F.count("old").alias("then"), F.min("old").alias("one"), F.max("old").alias("other"))
        weight = F.greatest(F.col("size") / tile, F.col("copies") / TILE_CLASSES, F.least(F.lit(SPLITS), F.floor(F.col("copies") / SPLIT)))
        settled = F.coalesce((F.col("copies") == F.col("then")) & (F.col("one") == F.col("other")), F.lit(False))
        groups = checkpointed(groups.select("group", "copies", F.ceil(weight).cast("int").alias("tiles"), settled.alias("settled")))
        fresh = join_by_class(members.select("node", "group"), groups, "group").where("not settled")
        tiled = fresh.select("node", "group", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
        found = verify(held.select("node", "copies", "data").join(tiled, "node"), threshold, words)
        if verified is not None:
            found = found.unionByName(join_by_class(verified, groups.select("group", "copies", "settled"), "group").where("settled").select(found.columns))
        verified = checkpointed(found)
        bins = {r["bin"]: r["n"] for r in verified.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
        need = needed_depth([bins.get(i, 0) for i in range(BINS)], depth, floor, threshold, tries, target)
        if need == depth:
            return verified.where("bin is null").select("tiles", "a", "b", "n")
        depth, before = need, members.select("node", F.col("group").alias("old"))


def _with_words(every: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, copies, size, data) of the classes that edges join, with the words of a class's first row."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    taken = nodes.join(classes.select("node", "rep", "hash", "copies", "size"), "node")
    first = every.select(F.col("id").alias("rep"), "hash", "data").join(taken, ["rep", "hash"])
    return first.select("node", "copies", "size", "data").dropDuplicates(["node"])  # repeated rows


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, once if rows repeat it with its text."""
    decided = _decided(docs, text, key, **options).select(F.col(key).alias("_id"), F.col("hash").alias("_hash"), "kept")
    decided = checkpointed(decided)
    same = lambda other: docs[key].eqNullSafe(other["_id"]) & (_hash(text) == other["_hash"])
    dropped = decided.where("not kept").select("_id", "_hash").distinct()
    out = docs.join(dropped, same(dropped), "left_anti")
    repeated = checkpointed(decided.where("kept and _id is not null").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash"))
    if repeated.isEmpty():
        return out
    once = out.join(repeated, same(repeated), "left_semi").dropDuplicates([key, text])
    return out.join(repeated, same(repeated), "left_anti").unionByName(once)
