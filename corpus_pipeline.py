"""From raw documents to token ids: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents. Rows without an id or a text go through all
stages like others; their text counts as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.bpe import encode_decode
from driftline.llm.common import checkpoint, table, training_sample
from driftline.llm.crf import LONGEST, SAMPLE, classify
from driftline.llm.decontam import contaminated
from driftline.llm.lines import kept_lines, line_bitmaps
from driftline.llm.neardup import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go; where no labelled row is there to train it, all stay."""
    labelled, labels = docs.select("doc_id", "text"), table(spark, sf_dir, "labels")
    if training_sample(labelled, labels, "quality", SAMPLE, LONGEST).isEmpty():
        return docs
    scored = classify(docs, labelled, labels)
    return scored.where("predicted = 1").select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars follows the text."""
    kept = kept_lines(docs, line_bitmaps(docs))
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return one_of_each(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    row = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    hit = contaminated(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id.*").distinct().toDF("__d", "__t")
    th = f"__th_{uuid.uuid4().hex}"  # no column of docs is called so
    own = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(hit, own["doc_id"].eqNullSafe(hit["__d"]) & (own[th] == hit["__t"]), "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and digests of the ids and the decoded text."""
    out = encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("line_dedup", without_common_lines),
    ("near_dedup", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: SQL expresses neither the trained classifier nor the classes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
