"""Exact deduplication with built-in functions only.

Method: rows are grouped by a 128-bit hash of their normalised text (A-Z
lower-cased), here the first half of its SHA-256. Inside a hash the bytes are
compared: grouping by (hash, text) is combined before the shuffle, so that a text
that a third of all rows hold leaves each task once, and a hash with more than
one text is a collision. Hashes of one text give their size and the id that
stays back to the rows by (hash, salt of the id): the narrow verdict is copied to
the salts, at most SALTS a hash, and no hot hash meets its rows in one task. Rows
of collided hashes, if there are any, are told apart by the text itself.

Cases: a null text is an empty one, and all of these are equal; a null id is
never the one that stays unless all ids of the group are null; rows that repeat
both id and text each count in group_size and share their verdict in
`exact_groups`, and `without_copies` leaves one of them; a text of any length is
compared whole; an empty table gives an empty result; other columns are not read
by `exact_groups`, whatever they are called, and are kept by `without_copies`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import stored, table
from driftline.llm.lines import ascii_lower

SALTS = 64


def half_digest(text: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def exact_groups(docs: DataFrame, largest: bool = True, hashed: Callable[[Column], Column] = half_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    largest: whether the largest or the smallest id of equal texts stays; hashed: the hash of a normalised text.
    """
    chosen = F.max if largest else F.min
    base = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    base = base.select("doc_id", "norm", hashed(F.col("norm")).alias("key"))
    texts = base.groupBy("key", "norm").agg(F.count("*").alias("n"), chosen("doc_id").alias("id"))
    groups = stored(texts.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), chosen("id").alias("id")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"), F.lit(0))
    rows = base.select("doc_id", "key", salt.alias("salt"), F.unhex(F.sha2("norm", 256)).alias("digest")).repartition("key", "salt")
    met = rows.select("key", "salt").distinct()
    verdict = met.join(groups.where("texts = 1"), "key")
    out = rows.join(verdict.select("key", "salt", "n", "id"), ["key", "salt"]).select("doc_id", "digest", "n", "id")
    collided = groups.where("texts > 1").select("key")
    if not collided.isEmpty():
        own = base.join(collided, "key", "left_semi")
        told = own.groupBy("key", "norm").agg(F.count("*").alias("n"), chosen("doc_id").alias("id"))
        out = out.unionByName(own.join(told, ["key", "norm"]).select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), "n", "id"))
    return out.select(
        "doc_id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of docs that stay, one for each text, with all their columns."""
    held, told = f"__i_{uuid.uuid4().hex}", f"__s_{uuid.uuid4().hex}"  # no column of docs is called so
    own = docs.withColumn(told, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    stay = exact_groups(docs, largest).where("kept").select(F.col("keep_id").alias(held), F.col("text_sha256").alias(f"{told}_")).distinct()
    left = own.join(stay, own["doc_id"].eqNullSafe(stay[held]) & (own[told] == stay[f"{told}_"]), "left_semi")
    return left.dropDuplicates([told]).select(*docs.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
