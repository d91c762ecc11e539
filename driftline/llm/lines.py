"""Line deduplication with built-in functions only.

Method: each line's key is hashed to 128 bits, and the hashes with document and
position, not the texts, are range-partitioned by (hash, salt of the document),
so that a key that stands in a third of all lines takes many ranges. Inside a
range the rows are sorted by document and position, and one pass marks the first
occurrence in each document. Counts of the salts of a key are added up; the
verdict goes back to the salts first and then to their lines, so that a frequent
key never meets it in one task. The decisions go back to the documents as
run-length compressed bitmaps of the lines that stay.

Cases: a null or empty text is one empty line; a row repeated with the same
doc_id and text counts as one document; rows that share an id but not the text
are told apart by the text's hash but count as one document; other columns of
the input are not read by `line_bitmaps` and are kept by `kept_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import keyed, table

#: White space stripped from a key.
BLANK = " \t\n\x0b\x0c\r"
SALTS = 256


def ascii_lower(s: Column) -> Column:
    """A-Z only; lower() does that where all letters are ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.translate(s, upper, upper.lower())).otherwise(F.lower(s))


def line_bitmaps(docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, th, keep_runs (array of [first, last] positions of lines that stay): documents that lose lines.

    min_docs: keys of at least min_chars code points found in so many documents lose all their lines;
    None: every line but a key's first, by document and position, goes.
    """
    split = keyed(docs).select("doc_id", "th", F.split("text", "\n").alias("lines"))
    lines = (
        split.select("doc_id", "th", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "th", "n", "pos", F.btrim("line", F.lit(BLANK)).alias("line"))
        .where(F.length("line") >= min_chars).withColumn("key", ascii_lower(F.col("line")))
        .select("doc_id", "th", "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"), F.lit(0)).alias("salt"))
    )
    # Neither hash nor salt can be null, which keeps a null test of the join below from standing in only one of both readers.
    ranged = lines.repartitionByRange("h1", "salt", "h2")
    place = F.struct("doc_id", "th", "pos")
    # n takes no part in the order, but so both readers of `ranged` read the same columns and Spark makes it once.
    by_doc = W.partitionBy("h1", "salt", "h2").orderBy("doc_id", "th", "pos", "n")
    marked = ranged.withColumn("first", F.coalesce(~F.lag("doc_id").over(by_doc).eqNullSafe(F.col("doc_id")), F.lit(True)) | (F.row_number().over(by_doc) == 1))
    salted = marked.groupBy("h1", "salt", "h2").agg(F.sum(F.col("first").cast("int")).alias("docs"), F.min(place).alias("place"))
    of_key = W.partitionBy("h1", "h2")  # SALTS rows at most
    if min_docs is None:
        verdict = salted.select("h1", "salt", "h2", F.min("place").over(of_key).alias("kept"))
    else:
        verdict = salted.select("h1", "salt", "h2", F.sum("docs").over(of_key).alias("n_docs")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    hit = ranged.join(verdict, ["h1", "salt", "h2"])
    if min_docs is None:
        hit = hit.where(~place.eqNullSafe(F.col("kept")))
    return hit.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.max("n").alias("n")).select("doc_id", "th", keep_runs("gone", "n").alias("keep_runs"))


def keep_runs(gone: str, n: str) -> Column:
    """Runs [first, last] of the positions below n that are not in the sorted array `gone`: what lies between two that are."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(F.transform(gone, lambda p: p - 1), F.array(F.col(n) - 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.array(a, b))
    return F.filter(runs, lambda r: r[0] <= r[1])


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of docs with the kept lines as text, and n_lines and n_dropped."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(*(F.col(c).alias(f"in_{c}") for c in names))
    own = own.withColumn("__th", F.xxhash64(F.coalesce("in_text", F.lit(""))))
    runs = bitmaps.select("doc_id", "th", F.col("keep_runs").alias("__runs"))
    joined = own.join(runs, own["in_doc_id"].eqNullSafe(runs["doc_id"]) & (own["__th"] == runs["th"]), "left")
    # A column that lambdas name is one of the step before: an expression would be evaluated again for each element.
    split = joined.withColumn("__lines", F.split(F.coalesce("in_text", F.lit("")), "\n")).withColumn("__n", F.size("__lines"))
    left = F.flatten(F.transform("__runs", lambda r: F.sequence(r[0], r[1])))
    text = F.when(F.col("__runs").isNull(), F.col("in_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    dropped = F.coalesce(F.col("__n") - F.aggregate("__runs", F.lit(0), lambda n, r: n + r[1] - r[0] + 1), F.lit(0))
    return split.select(*(text.alias(c) if c == "text" else F.col(f"in_{c}").alias(c) for c in names), F.col("__n").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = kept_lines(docs, line_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
