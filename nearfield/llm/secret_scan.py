"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong patterns (the base) are always reported. Weak ones, such as an account
name, a random-looking string or an address, say nothing alone; they are
reported only where the complementary parts of a credential lie in one scope: an
interval of ``SCOPE`` code points to either side. The interval join of
identifiers, secrets and endpoints is one range frame over the parts of a
document in the order of their starts, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns of the base, in the order of kinds; a value of the last column is the shortest that counts.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Parts that count only together; a value must hold digits, capitals and small letters.
WEAK = [
    ("identifier", r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 4),
    ("value", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{32,}+", 0, 32),
    ("endpoint", r"(?i)\b(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@%&+=-]+", 0, 10),
]
KINDS = [name for name, *_ in BASE + WEAK]
IDENTIFIERS, SECRETS = ("access", "identifier"), ("assign", "hex", "value")
SCOPE = 300
MASK = "[SECRET]"


def _matches(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """Every match as (kind's order, number, characters since the last match, its length, whether it counts)."""
    found, apart = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size(found) - 1).alias("i"), F.slice(apart, 1, F.size(found)).alias("gap"), found.alias("match"), value.alias("value"))
    made = F.transform(zipped, lambda x: F.struct(F.lit(order).alias("kind"), x["i"].alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), (F.length(x["value"]) >= least).alias("counts")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,counts:boolean>>"))


def find_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``key``, ``copies`` and ``spans`` (array of kind, start, end by start, then kind) for each distinct (key, text).

    ``copies`` is how many rows were equal in key and text; starts and ends are
    code points, ends exclusive. Null texts are empty and have no spans; null
    keys are a key. One shuffle, of match positions only: one row for each
    document and one for each match. Weak parts that overlap a base span are left out.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    base = [_matches(F.col("_t"), k, p, g, n) for k, (_, p, g, n) in enumerate(BASE)]
    weak = [_matches(F.col("_t"), len(BASE) + k, p, g, n) for k, (_, p, g, n) in enumerate(WEAK)]
    linkable = F.col("_t").rlike(BASE[1][1]) | F.col("_t").rlike(WEAK[0][1])
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,counts:boolean>>")
    parts = docs.select(F.col(key).alias("_id"), source.alias("_t")).select("_id", F.xxhash64("_t").alias("_hash"), F.concat(*base, F.when(linkable, F.concat(*weak)).otherwise(none)).alias("_parts"))
    rows = parts.select("_id", "_hash", F.explode_outer("_parts").alias("p")).select("_id", "_hash", "p.*").repartition("_id", "_hash")
    rows = rows.groupBy("_id", "_hash", "kind", "i", "gap", "size", "counts").agg(F.count("*").alias("copies"))
    run = Window.partitionBy("_id", "_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(run)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # matches that don't count stay as rows without kind, as a document may have no others
    rows = rows.withColumn("kind", F.when(F.col("counts"), F.col("kind")))

    names = {n: k for k, n in enumerate(KINDS)}
    strong = F.col("kind") < len(BASE)
    near = Window.partitionBy("_id", "_hash").orderBy("start").rangeBetween(-scope, scope)
    before = Window.partitionBy("_id", "_hash").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_id", "_hash").orderBy("start", "kind").rowsBetween(0, Window.unboundedFollowing)
    is_in = lambda kinds: F.col("kind").isin([names[k] for k in kinds])
    rows = rows.withColumn("covered", F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
    rows = rows.where(F.col("kind").isNull() | strong | ~F.col("covered"))
    rows = rows.withColumn("ids", F.max(is_in(IDENTIFIERS)).over(near)).withColumn("secrets", F.max(is_in(SECRETS)).over(near))
    linked = F.when(is_in(["identifier"]), F.col("secrets")).when(is_in(["value"]), F.col("ids")).otherwise(F.col("ids") & F.col("secrets"))
    span = F.when(F.col("kind").isNotNull() & (strong | linked), F.struct("start", "kind", "end"))
    out = rows.groupBy("_id", "_hash").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(span)).alias("s"))
    kinds = F.array(*map(F.lit, KINDS))
    return out.select(F.col("_id").alias(key), F.col("_hash").alias("text_hash"), "copies", F.transform("s", lambda x: F.struct(kinds[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base kinds, the digest of base spans and all spans.

    Null texts are empty and have none; repeated rows and rows without ``doc_id``
    are reported each, an empty table gives no rows, other columns are ignored.
    """
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin([k for k, *_ in BASE]))
    rows = find_spans(docs).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_linked"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", mask: str = MASK) -> DataFrame:
    """``docs`` with every span of ``find_spans`` replaced by ``mask``; spans that touch or overlap become one mask.

    Only rows with spans are joined, by key and hash of the text; the columns stay
    as they are. Null texts stay null; repeated rows are masked alike and all stay.
    """
    spans = find_spans(docs, text, key).where(F.size("spans") > 0).select(F.col(key).alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    found = spans["_spans"]
    joined = docs.join(spans, docs[key].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == spans["_hash"]), "left")
    state = "struct<at:long,out:array<string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        kept = F.when((x["start"] > s["at"]) | (s["at"] == 0), F.concat(s["out"], F.array(gap))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), kept.alias("out"))

    rest = lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(F.col(text))))), mask)
    masked = F.when(found.isNotNull(), F.aggregate(found, start, step, rest)).otherwise(F.col(text))
    return joined.select(*(masked.alias(c) if c == text else docs[c] for c in docs.columns))
