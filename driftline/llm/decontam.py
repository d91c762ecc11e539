"""Benchmark decontamination by SimHash of item-sized windows.

Method: for a benchmark item of n words, the windows of n words of a document
(the whole document, if it is shorter) get 256-bit SimHash fingerprints of their
SHINGLE-word shingles. Fingerprints are looked up in BLOCKS tables of one block
of 8 bits each: of 32 blocks, those with three or more differing bits can be at
most RADIUS / 3 where the distance is at most RADIUS, so that the items that
come within two bits in at least BLOCKS - RADIUS / 3 tables include all within
RADIUS. These, once within RADIUS, are verified by the exact weighted Jaccard
similarity of the shingles (weights: how often each occurs). At a similarity of
0.8 the expected distance is 39 with a standard deviation of 6, so that RADIUS
leaves out one window in 10^5. Windows that share no shingle with any item have
similarity 0 and are passed over.

The benchmark is read in blocks of items of about INDEX_CHARS characters; each
is an index of bounded size that is broadcast, and one pass over the documents.

Cases: words are split at ASCII white space and lower-cased; a null text or item
has no words and matches nothing; items of fewer than SHINGLE words have one
shingle, all their words; repeated documents are one document; items with the
same text each match; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import grams, mixed, shipped, slices, table, word_hashes, word_spans

SHINGLE, SIMILAR = 5, 0.8
BITS, RADIUS, BLOCKS, NEAR = 256, 64, 32, 2
VOTES = BLOCKS - RADIUS // (NEAR + 1)
INDEX_CHARS = 4 << 20
MASK = (1 << 20) - 1
COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def signs(shingles: np.ndarray) -> np.ndarray:
    """[shingles, BITS] of +1 and -1."""
    words = np.stack([mixed(shingles + np.uint64(k)) for k in range(1, BITS // 64 + 1)], 1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """[n, BLOCKS] bytes of the fingerprints with these sums of signs."""
    return np.packbits(sums > 0, axis=1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(both)), np.bincount(at[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items of one block of the benchmark."""

    def __init__(self, ids: list, texts: list[str]):
        texts = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        self.ids, self.sizes, self.shingles = [], [], []
        for k, i in enumerate(ids):
            n = int(first[k + 1] - first[k])
            if n:
                self.ids.append(i)
                self.sizes.append(n)
                self.shingles.append(grams(h[first[k] : first[k + 1]], min(n, SHINGLE)))
        self.sizes = np.array(self.sizes, np.int64)
        self.prints = packed(np.stack([signs(s).sum(0, dtype=np.int64) for s in self.shingles])) if self.ids else np.empty((0, BLOCKS), np.uint8)
        # For each block and value: which items come within NEAR bits.
        value = np.arange(256, dtype=np.uint8)
        self.tables = [COUNT[value[:, None] ^ self.prints[None, :, b]] <= NEAR for b in range(BLOCKS)]
        self.grams = np.unique(np.minimum(self.sizes, SHINGLE)).tolist()
        self.holders: dict[int, dict[int, set[int]]] = {g: {} for g in self.grams}
        for k, s in enumerate(self.shingles):
            for x in s.tolist():
                self.holders[min(int(self.sizes[k]), SHINGLE)].setdefault(x, set()).add(int(self.sizes[k]))
        self.maybe = {}
        for g, held in self.holders.items():
            self.maybe[g] = np.zeros(MASK + 1, bool)
            self.maybe[g][(np.array(list(held), np.uint64) & np.uint64(MASK)).astype(np.int64)] = True

    def windows(self, h: np.ndarray, g: int, hits: np.ndarray, shingles: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of similar windows of a document whose g-word shingles `hits` are an item's."""
        by_size: dict[int, list[int]] = {}
        for p in hits.tolist():
            for n in self.holders[g][int(shingles[p])]:
                by_size.setdefault(n, []).append(p)
        out = []
        for n, ps in by_size.items():
            span = min(n, len(h)) - g + 1  # shingles of a window
            # Windows that hold one of the shingles, as ranges that are opened and closed.
            last, ps = len(shingles) - span, np.array(ps)
            change = np.zeros(last + 2, np.int32)
            np.add.at(change, np.clip(ps - span + 1, 0, last + 1), 1)
            np.add.at(change, np.minimum(ps, last) + 1, -1)
            at = np.flatnonzero(np.cumsum(change)[: last + 1] > 0)
            if not len(at):
                continue
            items = np.flatnonzero(self.sizes == n)
            # Sums of signs by prefix sums over each run of windows that touch.
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) > span) + 1, [len(at)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for part in range(lo, hi, 4096):
                    some = at[part : min(hi, part + 4096)]
                    base = some[0]
                    sums = np.cumsum(signs(shingles[base : some[-1] + span]), axis=0, dtype=np.int32)
                    sums = np.concatenate([np.zeros((1, BITS), np.int32), sums])
                    prints = packed(sums[some - base + span] - sums[some - base])
                    votes = np.zeros((len(some), len(items)), np.uint8)
                    for b in range(BLOCKS):
                        votes += self.tables[b][prints[:, b]][:, items]
                    for r, c in zip(*np.nonzero(votes >= VOTES), strict=True):
                        if COUNT[prints[r] ^ self.prints[items[c]]].sum() <= RADIUS:
                            s = weighted_jaccard(shingles[some[r] : some[r] + span], self.shingles[items[c]])
                            if s >= SIMILAR:
                                out.append((int(items[c]), s, int(some[r])))
        return out

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, best similarity, its first word, number of similar windows)."""
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        found: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for g in self.grams:
            all_grams = grams(h, g)
            at = np.flatnonzero(self.maybe[g][(all_grams & np.uint64(MASK)).astype(np.int64)])
            at = at[[int(x) in self.holders[g] for x in all_grams[at]]] if len(at) else at
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + g <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                d = int(doc[lo])
                a, b = first[d], first[d + 1]
                for item, s, w in self.windows(h[a:b], g, at[lo:hi] - a, all_grams[a : b - g + 1]):
                    found.setdefault((d, item), []).append((-s, w))
        for (d, item), best in sorted(found.items()):
            yield d, item, -min(best)[0], min(best)[1], len(best)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_windows: a row for each document and item that it holds.

    docs: doc_id, text; benchmark: item_id, text.
    """
    spark = docs.sparkSession
    shipped(spark)
    items = benchmark.select("item_id", F.lower("text").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // INDEX_CHARS + 1
    own = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    schema = T.StructType([own.schema["doc_id"], items.schema["item_id"]]).add("similarity", "double").add("first_word", "integer").add("n_windows", "integer")
    out = None
    for block in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect(), key=lambda r: (r["text"], str(r["item_id"])))
        shared = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column(0)
                for lo, _, data, offsets in slices(batch):
                    found = list(index.search(data, offsets))
                    columns = list(zip(*found, strict=True)) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + d for d in columns[0]], pa.int64())), pa.array([index.ids[i] for i in columns[1]], item_type), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())], names=schema.names)

        item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(items.schema["item_id"].dataType.simpleString(), pa.string())
        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_windows"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.at")).alias("first_word"), F.col("b.n_windows").alias("n_windows"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
