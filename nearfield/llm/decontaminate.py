"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only.

An item's windows of ``WINDOW`` words must occur whole, so the prefix of a window
that any match has to share is a single word; taken in the order of rarity over
all documents, it is the window's rarest. Document words join windows by that
word and the one beside it, the word's place in the window bounds where the window
would start and end, and the words in between are compared.

Windows of up to ``BLOCK_BYTES`` are broadcast, and documents aren't shuffled.
Beyond that, words are counted and joined by shuffles: a document's word then
travels with the words around it that a window could hold. Either way there are
two passes over the documents, whatever the number of windows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import checkpointed

WINDOW = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows that are broadcast at most.
BLOCK_BYTES = 8 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN, -1), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, win, win_id): the windows of each item; an item of fewer words is one window, of none has none."""
    w = F.col("w")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.slice(w, i, size))
    per = F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(w)).otherwise(F.array().cast("array<array<string>>"))
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.explode(per).alias("win"))
    return rows.select(F.col("item_id").cast("string").alias("item_id"), "win", F.md5(F.concat_ws(" ", "win")).alias("win_id")).distinct()


def occurrences(docs: DataFrame, windows: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every place of a document where a window occurs: (_id, _hash, start, size, win_id), starts from 0.

    ``windows`` are (win, win_id) rows, whose size is measured. Null texts have no
    words; rows that repeat key and text have the same places, each once a row.
    """
    wins = windows.select("win", "win_id").distinct()
    size = F.size("win")
    row = wins.agg(F.sum(F.octet_length(F.concat_ws(" ", "win")) + 120).alias("bytes"), F.max(size).alias("longest"), F.min(size).alias("shortest")).first()
    small, longest = (row["bytes"] or 0) <= block_bytes, row["longest"] or 1
    held = F.broadcast if small else (lambda df: df)
    exploded = docs.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"), words(F.col(text)).alias("w"))

    vocabulary = wins.select(F.explode("win").alias("v")).distinct()
    seen = exploded.select(F.explode_outer("w").alias("word"))  # outer: no filter that repeats the expression
    if small:
        counts = seen.join(F.broadcast(vocabulary), F.col("word") == F.col("v")).groupBy("v").agg(F.count("*").alias("n"))
    else:  # counted in parts on each task first
        counts = seen.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, F.col("word") == F.col("v")).select("v", "n")

    placed = wins.select("win_id", F.posexplode("win").alias("off", "v")).join(counts, "v", "left")
    rarest = placed.groupBy("win_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "v", "off")).alias("r"))
    # a word that no document has can't lead to a match; the pair of words that is looked for begins at the rarest, or before it if it is the last
    first = F.greatest(F.lit(0), F.least(F.col("r.off"), size - 2))
    keyed = wins.join(rarest.where("r.n > 0"), "win_id").select("win_id", "win", first.alias("off"))
    keyed = checkpointed(keyed.select("*", F.element_at("win", F.col("off") + 1).alias("rare"), F.get("win", F.col("off") + 1).alias("beside")))

    around = 2 * longest - 1
    at = exploded.select("_id", "_hash", F.size("w").alias("n"), "w", F.posexplode_outer("w").alias("pos", "word")).withColumn("next", F.get("w", F.col("pos") + 1))
    if small:
        at = at.withColumn("from", F.lit(0))
    else:
        rare = keyed.select(F.col("rare").alias("word")).distinct()
        near = F.greatest(F.lit(0), F.col("pos") - (longest - 1))
        at = at.select("_id", "_hash", "n", F.slice("w", near + 1, around).alias("w"), "pos", "word", "next", near.alias("from")).join(rare, "word", "left_semi")
    begin = F.col("pos") - F.col("off")
    fits = (F.col("word") == F.col("rare")) & (begin >= 0) & (begin + size <= F.col("n")) & (F.slice("w", begin - F.col("from") + 1, size) == F.col("win"))
    take = lambda df: df.select("_id", "_hash", begin.alias("start"), size.alias("size"), "win_id")
    found = take(at.join(held(keyed.where(size > 1)), fits & (F.col("next") == F.col("beside"))))
    if (row["shortest"] or 2) == 1:  # items of one word have none beside it
        found = found.unionByName(take(at.join(held(keyed.where(size == 1)), fits)))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each distinct (key, text) with a hit: ``_id``, ``_hash``, ``n_hit`` words and ``items`` (sorted strings).

    A word is hit if it lies in any occurrence of a window; overlapping
    occurrences count once, by a running maximum of their ends. Null texts and
    items have no words and no hits; repeated rows share their result, repeated
    items are one. Windows of an item without ``item_id`` are hits as all others
    are, but it can't be named: ``items`` leaves it out and may be empty. Tables
    without rows give no rows.
    """
    items = checkpointed(item_windows(benchmark, size))
    found = occurrences(docs, items, text, key, block_bytes).distinct()
    found = checkpointed(found)
    spans = found.groupBy("_id", "_hash", "start").agg((F.col("start") + F.max("size")).alias("end"))
    earlier = Window.partitionBy("_id", "_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    hit = spans.select("_id", "_hash", fresh.alias("n")).groupBy("_id", "_hash").agg(F.sum("n").alias("n_hit"))
    named = found.select("_id", "_hash", "win_id").distinct().join(items.select("win_id", "item_id"), "win_id").groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    same = hit["_id"].eqNullSafe(named["_id"]) & (hit["_hash"] == named["_hash"])
    return hit.join(named, same).select(hit["_id"], hit["_hash"], "n_hit", "items")


def _joined(docs: DataFrame, found: DataFrame, text: str, key: str, how: str) -> DataFrame:
    return docs.join(found, docs[key].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["_hash"]), how)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: words, hit words, items with occurring windows and their digest.

    Null texts have no words and are clean; repeated rows and rows without
    ``doc_id`` are reported each; an empty benchmark leaves all clean, an empty
    table gives no rows. Other columns are ignored.
    """
    counted = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = contamination(docs, benchmark)
    rows = counted.join(found, counted["doc_id"].eqNullSafe(found["_id"]) & (counted["_h"] == found["_hash"]), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return rows.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns; repeated rows stay or go together, null texts stay."""
    return _joined(docs, contamination(docs, benchmark, text, key), text, key, "left_anti")
