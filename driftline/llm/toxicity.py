"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Method: terms are words of letters, lower-cased, and their first 4 and 6 letters
(for inflected forms). A bounded sample of labelled texts outside the held-out
fold (SAMPLE of each label, by hash of the id, of at most LONGEST characters) is
all that is learnt from: a part of it (CALIBRATION of each label, a quarter at
most) is set apart for the scale; on the others, terms are tested against the
label, and the TERMS terms whose chi-square is highest (and at least LEAST) make
the vocabulary, with inverse document frequencies in which each text counts for
as many labelled ones as it stands for. EXAMPLES of each label are the index: for
each block of BLOCK examples and each term, the block's highest weight, and
postings. Texts go through the blocks by falling upper bound of their cosine with
a block's examples (exact for the few frequent terms, by the highest weights for
the others), many texts in one step and ever more blocks at a time; a text stops
when no block left can beat its NEIGHBOURS best, so that these are the exact
nearest. Their votes, weighted by cosine squared and by how many labelled
texts each example stands for, are put on the scale of the labels by a monotone
fit on the part set apart.

Cases: a null or empty text, or one without a term of the vocabulary, has no
neighbour and gets the rate of toxic texts among such texts; without labelled
rows every score is 0; where no term passes the test, all texts get the rate of
toxic ones; repeated rows get the same score; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import apart, held_out, shipped, table, with_text
from driftline.llm.crf import rising

TERMS, LEAST = 4096, 15.0
SAMPLE, EXAMPLES, CALIBRATION, LONGEST = 4096, 1024, 1024, 20_000
NEIGHBOURS, BLOCK = 25, 64
#: Terms that stand in more than this share of the examples are multiplied for all of them; the others have postings.
OFTEN = 1 / 32
#: Blocks of the first step; each step looks at twice as many as the one before.
TOGETHER = 4
PREFIXES = (4, 6)
#: Texts that are scored in one step, and words that a worker remembers (of at most 32 letters each).
STEP, REMEMBERED = 256, 200_000
WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> tuple[str, ...]:
    """The terms of a word."""
    return (word, *(f"{word[:k]}*" for k in PREFIXES))


def word_counts(text: str) -> Counter:
    return Counter(m.group() for m in WORD.finditer(text.lower())) if len(text) > 1 << 20 else Counter(WORD.findall(text.lower()))


def vocabulary(texts: list[str], labels: np.ndarray, stands_for: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Terms and their inverse document frequencies, from a bounded sample; labels: 0 or 1."""
    found: tuple[Counter, Counter] = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        found[int(y)].update({x for w in word_counts(t) for x in forms(w)})
    n, pos = len(texts), float(np.sum(labels))
    terms = [t for t in set(found[0]) | set(found[1]) if 5 <= found[0][t] + found[1][t] < n]
    clean, toxic = (np.array([c[t] for t in terms], float) for c in found)
    df = clean + toxic
    expected = df * pos / max(n, 1)
    spread = expected * (1 - df / max(n, 1)) * (1 - pos / max(n, 1))
    chi2 = (toxic - expected) ** 2 / np.maximum(spread, 1e-12)
    passed = sorted(np.flatnonzero((chi2 >= LEAST) & (spread > 0)).tolist(), key=lambda i: (-chi2[i], terms[i]))[:TERMS]
    each = [float(np.mean(stands_for[labels == y])) if (labels == y).any() else 0.0 for y in (0, 1)]
    return [terms[i] for i in passed], np.log((1 + stands_for.sum()) / (1 + clean[passed] * each[0] + toxic[passed] * each[1]))


class Index:
    """Labelled examples in blocks, with each block's highest weight of each term."""

    def __init__(self, terms: list[str], idf: np.ndarray, texts: list[str], labels: np.ndarray, stands_for: np.ndarray):
        self.met: dict[str, tuple[int, ...]] = {}
        self.known, self.idf = {t: i for i, t in enumerate(terms)}, idf
        t, x, first = self.vectors(texts)
        lead = np.array([t[a:b][x[a:b].argmax()] if b > a else -1 for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
        order = np.lexsort((np.random.default_rng(2).permutation(len(texts)), lead)) if len(texts) else np.empty(0, np.int64)
        self.rows = order[lead[order] >= 0]  # alike examples share blocks, which keeps bounds low
        self.labels, self.weight = labels[self.rows].astype(float), stands_for[self.rows]
        self.blocks = -(-len(self.rows) // BLOCK)
        slot_of = np.full(len(texts), -1)
        slot_of[self.rows] = np.arange(len(self.rows))
        slots = slot_of[np.repeat(np.arange(len(texts)), np.diff(first))]
        often = np.bincount(t, minlength=len(idf)) > OFTEN * max(len(self.rows), 1)
        self.column = np.where(often, np.cumsum(often) - 1, -1)  # of the frequent terms, in `dense`
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK))
        self.dense[self.column[t[often[t]]], slots[often[t]]] = x[often[t]]
        t, x, slots = t[~often[t]], x[~often[t]], slots[~often[t]]
        self.best = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.best, (t, slots // BLOCK), x)
        # Postings by term and slot; those of term t in block b are start[t, b] on, size[t, b] of them.
        order = np.lexsort((slots, t))
        self.inside, self.weights = slots[order] % BLOCK, x[order]
        upto = np.cumsum(np.bincount(t * self.blocks + slots // BLOCK, minlength=self.best.size)).reshape(self.best.shape)
        self.size = np.diff(upto.ravel(), prepend=0).reshape(self.best.shape)
        self.start = upto - self.size

    def terms_of(self, word: str) -> tuple[int, ...]:
        out = self.met.get(word)
        if out is None:
            out = tuple(self.known[x] for x in forms(word) if x in self.known)
            if len(word) <= 32:
                if len(self.met) >= REMEMBERED:
                    self.met.clear()
                self.met[word] = out
        return out

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, weights (of length 1 in each text), and each text's first (one more entry at the end)."""
        terms, counts, sizes = [], [], []
        for text in texts:
            c: dict[int, int] = {}
            for w, n in word_counts(text).items():
                for i in self.terms_of(w):
                    c[i] = c.get(i, 0) + n
            terms += sorted(c)
            counts += [c[i] for i in sorted(c)]
            sizes.append(len(c))
        t, first = np.array(terms, np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        x = (1 + np.log(np.array(counts, float))) * self.idf[t]
        owner = np.repeat(np.arange(len(texts)), sizes)
        return t, x / np.sqrt(np.maximum(np.bincount(owner, x * x, len(texts)), 1e-24))[owner], first

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[texts, NEIGHBOURS] slots and cosines of the nearest examples, the nearest first; -1 and 0 where there are fewer.

        Of equally near examples those met first stay; that order is the same whatever else is in the step.
        """
        t, x, first = self.vectors(texts)
        slots, cosines = np.full((len(texts), NEIGHBOURS), -1), np.zeros((len(texts), NEIGHBOURS))
        live = np.flatnonzero(np.diff(first))
        if not len(live) or not self.blocks:
            return slots, cosines
        bound = np.add.reduceat(x[:, None] * self.best[t], first[live], axis=0)
        owner, column = np.repeat(np.arange(len(texts)), np.diff(first)), self.column[t]
        frequent = np.zeros((len(texts), len(self.dense)))
        frequent[owner[column >= 0], column[column >= 0]] = x[column >= 0]
        sums = (frequent @ self.dense).reshape(len(texts), self.blocks, BLOCK)
        bound += sums[live].max(2)
        falling = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, falling, 1)
        row, at, some = np.arange(len(live)), 0, TOGETHER
        while at < self.blocks:
            on = bound[row, at] > np.maximum(cosines[live[row], -1], 1e-9)
            row = row[on]
            if not len(row):
                break
            here = falling[row, at : at + some]
            # Rounded, so that what is equally near does not depend on the order of sums.
            scores = np.round(self.scores(t, x, first, live[row], here) + sums[live[row, None], here], 9)
            # Blocks whose bound is too low are looked at only with others of the step; their examples cannot get in.
            new = here[:, :, None] * BLOCK + np.arange(BLOCK)
            every = np.concatenate([cosines[live[row]], scores.reshape(len(row), -1)], 1)
            names = np.concatenate([slots[live[row]], new.reshape(len(row), -1)], 1)
            top = np.argsort(-every, axis=1, kind="stable")[:, :NEIGHBOURS]
            cosines[live[row]] = np.take_along_axis(every, top, 1)
            slots[live[row]] = np.take_along_axis(names, top, 1)
            at, some = at + some, 2 * some
        slots[cosines <= 0] = -1
        return slots, cosines

    def scores(self, t: np.ndarray, x: np.ndarray, first: np.ndarray, texts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """[texts, blocks, BLOCK] shares of the cosines, by the postings of each text's terms in its blocks."""
        n, k = blocks.shape
        many = first[texts + 1] - first[texts]
        at = np.repeat(first[texts] - np.cumsum(many) + many, many) + np.arange(many.sum())  # each text's terms
        whose = np.repeat(np.arange(n), many)
        size, start = self.size[t[at, None], blocks[whose]], self.start[t[at, None], blocks[whose]]
        size, start = size.ravel(), start.ravel()
        some = np.flatnonzero(size)
        size, start = size[some], start[some]
        where = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(whose[some // k] * k + some % k, size) * BLOCK + self.inside[where]
        return np.bincount(cell, np.repeat(x[at][some // k], size) * self.weights[where], n * k * BLOCK).reshape(n, k, BLOCK)

    def vote(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Votes for toxic, -1 without neighbours, and the first three examples that each rests on (-1: none)."""
        slots, cosines = self.nearest(texts)
        w = cosines**2 * self.weight[slots] if len(self.rows) else cosines
        total = w.sum(1)
        vote = np.where(total > 0, (w * self.labels[slots]).sum(1) / np.where(total > 0, total, 1), -1.0) if len(self.rows) else np.full(len(texts), -1.0)
        return vote, np.where(slots[:, :3] >= 0, self.rows[slots[:, :3]], -1) if len(self.rows) else slots[:, :3]


def share(part: list[tuple], sizes: dict[int, int]) -> np.ndarray:
    """How many labelled texts each row of a part stands for."""
    n = Counter(r[2] for r in part)
    return np.array([sizes[r[2]] / n[r[2]] for r in part], float)


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> list[tuple]:
    """(doc_id, text, label) of at most `rows` texts of each label, in the order of the ids' hashes."""
    ids = None
    for y in (0, 1):
        some = labels.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.where(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").select("doc_id", F.xxhash64("doc_id").alias("h"), "text", "label")
    found = sorted(texts.collect(), key=lambda r: (r["h"], r["text"]))  # a row for each id but for repeated ones
    return [(r["doc_id"], r["text"], y) for y in (0, 1) for r in [x for x in found if x["label"] == y][:rows]]


def score_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """docs with score, predicted (1 if score >= cutoff) and evidence (ids of the nearest examples).

    labels: doc_id, label (0 or 1), to learn from; ids with a row labelled 1 count as 1.
    """
    spark = docs.sparkSession
    shipped(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    rows = sampled(own, labels, SAMPLE)
    made = None
    if rows:
        sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
        learn, rest = [], []
        for y in (0, 1):
            mine = [r for r in rows if r[2] == y]
            aside = min(CALIBRATION, len(mine) // 4)
            learn += mine[: len(mine) - aside]
            rest += mine[len(mine) - aside :]
        terms, idf = vocabulary([r[1] for r in learn], np.array([r[2] for r in learn]), share(learn, sizes))
        pick = [r for y in (0, 1) for r in [q for q in learn if q[2] == y][:EXAMPLES]]
        index = Index(terms, idf, [r[1] for r in pick], np.array([r[2] for r in pick]), share(pick, sizes))
        votes, y, w = index.vote([r[1] for r in rest])[0], np.array([float(r[2]) for r in rest]), share(rest, sizes)
        none = votes < 0
        prior = float((y * w).sum() / w.sum()) if len(rest) else sizes.get(1, 0) / sum(sizes.values())
        alone = float(((y * w)[none].sum() + prior) / (w[none].sum() + 1)) if len(rest) else prior
        # Labels are drawn at different rates: repeat each row in proportion, so that the fit sees the corpus's rates.
        times = np.maximum(1, np.round(w / w.min()).astype(int)) if len(rest) else np.empty(0, int)
        knots, values = rising(np.repeat(votes[~none], times[~none]), np.repeat(y[~none], times[~none])) if (~none).any() else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        made = spark.sparkContext.broadcast((index, knots, values, alone, [r[0] for r in pick]))
    df = with_text(docs.drop("score", "predicted", "evidence"))
    kind = T.ArrayType(docs.schema["doc_id"].dataType)
    schema = T.StructType(df.schema.fields[:-1]).add("score", "double").add("predicted", "integer").add("evidence", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for lo, hi, kept, texts in apart(batch, STEP):
                score, evidence = np.zeros(hi - lo), [[]] * (hi - lo)
                if made is not None:
                    index, knots, values, alone, ids = made.value
                    vote, which = index.vote(texts.to_pylist())
                    score = np.clip(np.where(vote < 0, alone, np.interp(vote, knots, values)), 0, 1)
                    evidence = [[ids[k] for k in row if k >= 0] for row in which.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(score), pa.array((score >= cutoff).astype(np.int32)), pa.array(evidence, pa.list_(id_type))],
                    schema=pa.schema([*kept.schema, pa.field("score", pa.float64()), pa.field("predicted", pa.int32()), pa.field("evidence", pa.list_(id_type))]),
                )

    return df.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
