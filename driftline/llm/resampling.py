"""Importance resampling towards a target distribution by hashed n-grams.

Method: a position table of words (posexplode), in which lead() over each
document's positions appends the following words for every order; the n-grams
are hashed into BUCKETS buckets and written as a narrow table, which both
the counts of the buckets and the sums of gains read. A bucket's gain is the log
ratio of its smoothed shares in the target and in the corpus; the gains (one row
a bucket, BUCKETS at most) are joined to the n-grams, and a document's weight is
their sum, combined before the shuffle. Documents of MIN_WORDS words or more are
drawn without replacement by Gumbel keys: the noise is a function of the id. The
rank comes from a range partition by score: rows before a part are counted for
each part, rows inside a part are numbered, so that no task sorts all rows.

Cases: A-Z only are lower-cased; a null or empty text has no words, weight 0 and
its own score, and is never drawn with a minimum of one word or more; a row
repeated with the same id and text counts as often as it stands there and has as
many rows in the result, with ranks of their own; a null id draws the noise of an
empty one and comes last among ties; an empty target or corpus has counts of 0; a
text of any length is used whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import discarded, stored, table
from driftline.llm.lines import ascii_lower

#: What separates words, the seed of the noise.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEED = 2024
BUCKETS, MIN_WORDS, PERCENT = 10_000, 20, 10


def ngram_buckets(texts: DataFrame, keys: list[str], orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """keys, first, words, bucket: a row for each n-gram of 1 to `orders` words, one with a null bucket for a text without words.

    first: whether the row is its text's first one; words: of the n-gram. Rows that repeat all keys must have equal texts.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), BREAK), lambda w: w != "")
    at = texts.select(*keys, F.posexplode_outer(words).alias("pos", "word"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    hashed = lambda gram: (F.crc32(gram.cast("binary")) % buckets).cast("int")
    if orders == 1:  # no word follows in an n-gram of one word: no window, no shuffle
        return at.select(*keys, first.alias("first"), F.lit(1).alias("words"), hashed(F.col("word")).alias("bucket"))
    by_text = W.partitionBy(*keys, "copy").orderBy("pos")
    # Rows that repeat all keys are told apart by a number among equal positions; both windows live on one shuffle by the keys.
    at = at.repartition(*keys).withColumn("copy", F.row_number().over(W.partitionBy(*keys, "pos").orderBy("pos")))
    next_words = [f"next_{k}" for k in range(1, orders)]
    led = at.select(*keys, first.alias("first"), "word", *(F.lead("word", k).over(by_text).alias(c) for k, c in enumerate(next_words, 1)))
    grams, gram = [F.struct(F.lit(1).alias("words"), F.col("word").alias("gram"))], F.col("word")
    for k, c in enumerate(next_words, 2):
        gram = F.concat(gram, F.lit(" "), F.col(c))  # null where the text ends before
        grams.append(F.struct(F.lit(k).alias("words"), gram.alias("gram")))
    each = led.select(*keys, "first", F.explode(F.array(*grams)).alias("g")).where("g.words = 1 OR g.gram IS NOT NULL")
    return each.select(*keys, (F.col("first") & (F.col("g.words") == 1)).alias("first"), F.col("g.words").alias("words"), hashed(F.col("g.gram")).alias("bucket"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain (long): of the buckets that occur."""
    s = corpus.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("s"))
    t = target.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("t"))
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    of_all = W.partitionBy()  # over a row for each bucket
    ratio = (F.col("t") + 1) * (F.sum("s").over(of_all) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(of_all) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel variable, as a function of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn): one row for each row of docs.

    docs: doc_id, text; target: text.
    """
    if buckets > 1 << 20:
        raise ValueError("the gains are broadcast: at most 2^20 buckets")
    own = docs.select("doc_id", "text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    grams = stored(ngram_buckets(own, ["doc_id", "th"], orders, buckets))
    wanted = target.select("text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    gains = bucket_gains(grams, ngram_buckets(wanted, ["th"], orders, buckets), buckets)
    summed = grams.join(F.broadcast(gains), "bucket", "left").groupBy("doc_id", "th").agg(
        F.sum(F.col("first").cast("int")).alias("rows"), F.count("bucket").alias("n"), F.count(F.when(F.col("words") == 1, F.col("bucket"))).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain")
    )
    share = lambda c: F.expr(f"{c} div rows")  # noqa: E731  the rows that repeat a document are equal, so this is exact
    scored = summed.select("doc_id", share("n").alias("n_features"), (share("n_words") >= min_words).alias("able"), share("gain").alias("weight"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    scored = scored.select("doc_id", "n_features", "able", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = stored(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    discarded(grams)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row for each partition
    parts = ranged.groupBy("part").agg(F.sum(F.col("able").cast("long")).alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    drawn = F.when(F.col("able") & (place <= percent * total // 100), place).cast("long")
    return ranged.join(F.broadcast(parts), "part").select("doc_id", F.col("n_features").cast("long"), F.col("weight").cast("long"), F.col("score").cast("long"), drawn.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), hashed AS (
  SELECT w, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda j: ('0x' || substr(hex(w), 2 * j + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM wanted), crc
), s AS (
  SELECT bucket, count(*) AS s FROM words JOIN hashed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM scored)
"""
