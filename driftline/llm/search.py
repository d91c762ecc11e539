"""Ranked lexical search: the best documents for each item of a benchmark.

Method: the documents are cut into shards of at most SHARD_DOCS documents that
hold a term of the items (and about SHARD_POSTINGS postings). A shard is a row of
arrays, its postings by term in compressed sparse rows, written to the shared
folder. Document frequencies and lengths are added up over all shards; then each
shard turns its counts into integer impacts once, and takes an item term by term,
adding a term's impacts to a dense accumulator of the shard's documents. The best
k are found by partition; among equal scores at the cut those with the smallest
ids stay. The shards' lists meet in two steps, by item and part of the shards
first, so that none is longer than k times the shards of a part.

The benchmark is read in blocks of about BLOCK_CHARS characters; each is a
vocabulary of bounded size that is broadcast, and one pass over the documents.

Scores are 64-bit integers, with div rounding down: a term of weight
floor(1000 ln((2N + 2) / (2 df + 1))) that occurs tf times in a document of n
words adds weight * (10^9 tf div (1000 tf + 20 m)), where m = 50 + (50 n N div L).

Cases: words are letters, digits and everything outside ASCII, A-Z lower-cased;
a null or empty text or item has no term and no row; an item's term counts once;
a row repeated with the same id and text is a row of its own; items that repeat
both id and text are one, items that share an id only are ranked each by itself;
equal scores are in order of the id, null ids last; a text of any length is read
whole; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import shipped, slices, stored, table, word_hashes

TOP = 50
BLOCK_CHARS, SHARD_DOCS, SHARD_POSTINGS, PARTS = 4 << 20, 16_384, 1 << 20, 64
#: Bytes of words, and lower-case letters for upper-case ones.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SHARD = "part int, n_docs long, n_words long, ids array<bigint>, lengths array<bigint>, terms array<int>, starts array<bigint>, docs array<int>, counts array<int>"
NO_ID = np.iinfo(np.int64).max


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, starts and ends of words, and each text's first word (one more entry at the end)."""
    data = LOWER[data]
    edges = np.zeros(len(data) + 2, bool)  # a word ends where a text does
    edges[offsets] = True
    inside = np.concatenate([[False], IS_WORD[data], [False]])
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edges[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edges[1:-1])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


class Vocabulary:
    """The terms of one block of items, and which of them each item holds."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        data, starts, ends, first = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
        number: dict[bytes, int] = {}
        words = data.tobytes()
        held = np.array([number.setdefault(words[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        self.items = [np.unique(held[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.size = len(number)
        self.sizes = np.array([len(t) for t in number], np.int64)
        self.data = np.frombuffer(b"".join(number), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        h = word_hashes(self.data, self.at[:-1], self.at[1:])
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def terms(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which term each of these is: by hash, then byte by byte."""
        none = np.empty(0, np.int64)
        if not (len(starts) and self.size):
            return none, none
        h = word_hashes(data, starts, ends)
        left = np.searchsorted(self.hashes, h, "left")
        right = np.searchsorted(self.hashes, h, "right")
        words, found = [none], [none]
        while len(at := np.flatnonzero(left < right)):  # once, but for terms whose hashes are equal
            term = self.order[left[at]]
            size = ends[at] - starts[at]
            same = size == self.sizes[term]
            at_same, term_same, size = at[same], term[same], size[same]
            if len(at_same):
                before = np.concatenate([[0], np.cumsum(size)[:-1]])
                step = np.arange(size.sum()) - np.repeat(before, size)
                equal = data[np.repeat(starts[at_same], size) + step] == self.data[np.repeat(self.at[term_same], size) + step]
                whole = np.logical_and.reduceat(equal, before)
                words.append(at_same[whole])
                found.append(term_same[whole])
            left[at] += 1
        return np.concatenate(words), np.concatenate(found)


class Shard:
    """Postings of documents as they come in, in the order of the documents."""

    def __init__(self) -> None:
        self.n_docs = self.n_words = self.held = self.postings = 0
        self.ids, self.lengths, self.terms, self.docs, self.counts = [], [], [], [], []

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, size: int) -> None:
        """ids, lengths: of some documents; doc, term: the document and the number of each word that is a term."""
        self.n_docs += int((lengths > 0).sum())
        self.n_words += int(lengths.sum())
        both, counts = np.unique(doc * size + term, return_counts=True)
        docs, local = np.unique(both // max(size, 1), return_inverse=True)
        self.ids.append(ids[docs])
        self.lengths.append(lengths[docs])
        self.terms.append(both % max(size, 1))
        self.docs.append(local + self.held)
        self.counts.append(counts)
        self.held += len(docs)
        self.postings += len(both)

    def row(self, part: int) -> pa.RecordBatch:
        join = lambda xs: np.concatenate([np.empty(0, np.int64), *xs])
        terms, docs, counts = join(self.terms), join(self.docs), join(self.counts)
        by_term = np.argsort(terms, kind="stable")
        present, starts = np.unique(terms[by_term], return_index=True)
        one = lambda xs, kind: pa.ListArray.from_arrays(pa.array([0, len(xs)], pa.int32()), pa.array(xs, kind))
        columns = [
            pa.array([part], pa.int32()), pa.array([self.n_docs], pa.int64()), pa.array([self.n_words], pa.int64()), one(join(self.ids), pa.int64()), one(join(self.lengths), pa.int64()),
            one(present, pa.int32()), one(np.append(starts, len(terms)), pa.int64()), one(docs[by_term], pa.int32()), one(counts[by_term], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARD.split(", ")])


def shards(docs: DataFrame, vocabulary) -> DataFrame:
    """A row of SHARD for each shard. docs: doc_id (long), text; vocabulary: a broadcast Vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, part = vocabulary.value, Shard(), TaskContext.get().partitionId() % PARTS
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch):
                data, starts, ends, first = words_of(data, offsets)
                at, term = known.terms(data, starts, ends)
                shard.add(ids[lo:hi], np.diff(first), np.searchsorted(first, at, "right") - 1, term, known.size)
                if shard.held >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield shard.row(part)
                    shard = Shard()
        if shard.n_docs:
            yield shard.row(part)

    return docs.mapInArrow(run, SHARD)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, highest first, equal ones by id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k :]].min()
        above, ties = at[own > least], at[own == least]
        left = k - len(above)
        if len(ties) > left:
            ties = ties[np.argpartition(ids[ties], left - 1)[:left]]
        at = np.concatenate([above, ties])
    return at[np.lexsort((ids[at], -scores[at]))]


def impacts(counts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Of postings: how often the term occurs, words of the document, the term's weight."""
    m = 50 + 50 * lengths * n_docs // max(n_words, 1)
    return weights * (1_000_000_000 * counts // (1000 * counts + 20 * m))


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. docs: doc_id (long), text; items: item_id, text."""
    spark = docs.sparkSession
    shipped(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = items.select("item_id", "text").where(F.col("text").isNotNull())
    blocks = (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    found = None
    for block in range(blocks):
        rows = sorted(set(map(tuple, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())), key=lambda r: (str(r[0]), r[1]))
        if not rows:
            continue
        known = Vocabulary([text for _, text in rows])
        index = stored(shards(own, spark.sparkContext.broadcast(known)))
        sums = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
        n_docs, n_words = sums[0] or 0, sums[1] or 0
        df = np.zeros(known.size, np.int64)  # a row for each term of the block comes to the driver
        counted = index.select(F.posexplode("terms").alias("at", "term"), "starts").select("term", (F.get("starts", F.col("at") + 1) - F.get("starts", F.col("at"))).alias("df"))
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["term"]] = r["df"]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((known.items, weights, n_docs, n_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            held, weights, n_docs, n_words = shared.value
            for batch in batches:
                for row in range(batch.num_rows):
                    part, ids, lengths, terms, starts, docs, counts = (batch.column(c)[row].values.to_numpy() if c > 2 else batch.column(c)[row].as_py() for c in (0, 3, 4, 5, 6, 7, 8))
                    each = np.diff(starts)
                    impact = impacts(counts.astype(np.int64), lengths[docs], np.repeat(weights[terms], each), n_docs, n_words)
                    local = np.full(len(weights), -1)
                    local[terms] = np.arange(len(terms))
                    out = []
                    for item, own in enumerate(held):
                        scores = np.zeros(len(ids), np.int64)
                        for t in local[own]:
                            if t >= 0:
                                a, b = starts[t], starts[t + 1]
                                scores[docs[a:b]] += impact[a:b]
                        at = best(scores, ids, k)
                        out.append((np.full(len(at), item), ids[at], scores[at]))
                    item, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), part), pa.int32()), pa.array(item, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["part", "item", "doc_id", "score"])

        listed = index.mapInArrow(run, "part int, item int, doc_id long, score long")
        order = [F.desc("score"), F.asc("doc_id")]  # null ids are the largest number here
        for keys in (["item", "part"], ["item"]):
            listed = listed.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]]))
        listed = listed.join(F.broadcast(names), "item").select("item_id", "rank", F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "score")
        found = listed if found is None else found.unionByName(listed)
    if found is None:  # no item at all
        found = spark.createDataFrame([], T.StructType([asked.schema["item_id"], *T._parse_datatype_string("rank int, doc_id long, score long").fields]))
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), asked AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nw FROM lengths
), counts AS (
  SELECT doc_id, w, count(*) AS tf FROM words GROUP BY doc_id, w
), weights AS (
  SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM counts, totals GROUP BY w, nd
), scored AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nw))))::BIGINT AS score
  FROM asked JOIN counts USING (w) JOIN weights USING (w) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
