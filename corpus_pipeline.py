"""A corpus pipeline over ``documents``: five stages, each a training-data operator at work.

Every stage takes (spark, docs, sf_dir) and returns what it keeps, with the
columns of ``documents`` but for the last. ``run`` writes each stage's result as
Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, language_id, ngram_forest, piece_codec, secret_scan
from nearfield.llm.common import shared_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: no text or no letters.

    A language is learned from rows that have ``lang``; without any such row
    nothing is dropped. A low score alone is no ground: short texts have one.
    """
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    if not profiles:
        return docs
    return language_id.identify(docs, profiles).where(F.col("lang_pred") != language_id.UNKNOWN).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles with a similarity of 0.8 connect."""
    return ngram_forest.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all documents stay, and ``n_chars`` follows the text."""
    out = secret_scan.redact(docs)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to."""
    coded = piece_codec.encode_decode(docs, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])
    rest = [c for c in coded.columns if c not in ("ids", "decoded")]
    return coded.select(*rest, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]
#: SQL can't express the stages' models; the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    path = shared_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
