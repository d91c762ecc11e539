"""Document quality by a linear-chain conditional random field over lines.

Method: every line of a text is labelled good or bad; its features and those of
the lines before and behind it give the emission scores, and two by two weights
the transitions. Forward-backward gives each line's marginal; a text's quality
is the mean marginal of good, weighted by the lines' lengths, put on the scale
of the labels by a monotone fit.

Training: a bounded sample of labelled texts (SAMPLE rows, chosen by hash of the
id, of at most LONGEST characters each). Lines start with their text's label;
after each round, lines of bad texts that look good to the field change theirs,
as long as a line stays bad.

Cases: a null or empty text is one empty line; without labelled rows every score
is 0.5; repeated rows get the same score; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import held_out, mixed, shipped, slices, table, training_sample, with_text, word_hashes, word_spans

SAMPLE, LONGEST = 3000, 20_000
ROUNDS, STEPS = 3, 50
OWN = ("bias", "log_words", "few_words", "upper", "symbols", "bars", "shouts", "digits", "word_length", "same_as_last", "same_as_two_before", "seen_line", "short_words", "stop", "alone")
SHARED = ("upper", "symbols", "bars", "shouts", "digits", "same_as_last", "seen_line", "few_words")
WIDTH = len(OWN) + 2 * len(SHARED)
#: Classes of bytes that are counted in a line.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbols": b"#*$%&<>", "bars": b"|", "shouts": b"!?", "digits": b"0123456789"}


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [lines, WIDTH], lengths in bytes of the lines, and each text's first line (one more entry at the end)."""
    breaks = np.flatnonzero(data == 0x0A)
    doc = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(np.concatenate([np.arange(len(offsets) - 1), doc + 0.5]), kind="stable")
    starts = starts[order]
    first = np.arange(len(offsets)) + np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ends = np.append(starts[1:] - 1, len(data))
    ends[first[1:] - 1] = offsets[1:]
    n, length = len(starts), np.maximum(ends - starts, 0)
    f = {"bias": np.ones(n)}
    for name, letters in CLASSES.items():
        table = np.zeros(256, np.int32)
        table[list(letters)] = 1
        count = np.concatenate([[0], np.cumsum(table[data])])
        f[name] = (count[ends] - count[starts]) / np.maximum(length, 1)
    ws, we, _ = word_spans(data, offsets)
    h = word_hashes(data, ws, we)
    line = np.searchsorted(starts, ws, "right") - 1
    words = np.bincount(line, minlength=n)
    some = np.maximum(words, 1)
    same = lambda k: np.bincount(line[k:][(h[k:] == h[:-k]) & (line[k:] == line[:-k])], minlength=n) / some
    f["log_words"], f["few_words"] = np.log1p(words) / 4, (words <= 3).astype(float)
    f["bars"], f["shouts"], f["symbols"] = np.minimum(f["bars"] * 10, 2), np.minimum(f["shouts"] * 10, 2), np.minimum(f["symbols"] * 10, 2)
    f["word_length"] = np.bincount(line, we - ws, n) / some / 8
    f["same_as_last"], f["same_as_two_before"] = same(1), same(2)
    f["short_words"] = np.bincount(line[we - ws <= 3], minlength=n) / some
    f["stop"] = (data[np.maximum(ends - 1, 0)] == 0x2E).astype(float) if len(data) else np.zeros(n)
    f["alone"] = (np.diff(first)[owner] == 1).astype(float)
    key = np.zeros(n, np.uint64)
    np.add.at(key, line, mixed(h + (np.arange(len(h)) - np.searchsorted(line, line)).astype(np.uint64)))
    order = np.lexsort((np.arange(n), key, owner))
    again = np.zeros(n, bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    f["seen_line"] = (again & (words > 0)).astype(float)
    own = np.stack([f[x] for x in OWN], 1).astype(np.float32)
    shared = own[:, [OWN.index(x) for x in SHARED]]
    before, behind = np.zeros_like(shared), np.zeros_like(shared)
    before[1:], behind[:-1] = shared[:-1], shared[1:]
    before[first[:-1]], behind[first[1:] - 1] = 0, 0
    return np.concatenate([own, before, behind], 1), length, first


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of each line and the expected counts of transitions, from each line's score for bad.

    Texts go through the recursions together, the longest first, so that those
    still under way are the first ones.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    m = np.exp(trans)
    e = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], 1)
    alive = np.searchsorted(-sizes, -np.arange(sizes.max()), "left") if len(sizes) else np.empty(0, int)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    pair = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = beta[at + 1] * e[at + 1]
        joint = alpha[at][:, :, None] * m * b[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = b @ m.T
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pair


def fit(x: np.ndarray, first: np.ndarray, bad_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the transitions."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    y = bad_text[owner].astype(float)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    for round_ in range(ROUNDS):
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        state = y.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[np.flatnonzero(inner) - 1], state[inner]), 1)
        for it in range(1, STEPS + 1):
            p, pair = marginals(x @ w, trans, first)
            g = np.concatenate([x.T @ (p - y), (pair - seen).ravel()]) / len(y) + 1e-4 * np.concatenate([w, trans.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
            w, trans = w - d[:-4], trans - d[-4:].reshape(2, 2)
        if round_ < ROUNDS - 1:
            p, _ = marginals(x @ w, trans, first)
            most = np.maximum.reduceat(p, first[:-1])[owner]
            y = np.where(bad_text[owner] & ((p >= 0.3) | (p == most)), 1.0, 0.0)
    return w, trans


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit of y over x (pool adjacent violators), each block shrunk by one observation of the mean."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            u, v = blocks[-2], blocks.pop()
            n = u[2] + v[2]
            u[:] = [(u[0] * u[2] + v[0] * v[2]) / n, (u[1] * u[2] + v[1] * v[2]) / n, n]
    return np.array([b[0] for b in blocks]), np.array([(b[1] * b[2] + y.mean()) / (b[2] + 1) for b in blocks])


def mean_good(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Mean over the lines, weighted by length, of the marginals of good."""
    x, length, first = line_features(data, offsets)
    p, _ = marginals(x @ w, trans, first)
    weight = length + 1.0
    return np.add.reduceat((1 - p) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= cutoff).

    labelled: doc_id, text; labels: doc_id, quality (1 good, 0 bad).
    """
    shipped(docs.sparkSession)
    rows = sorted((r["text"], int(r["label"])) for r in training_sample(labelled, labels, "quality", SAMPLE, LONGEST).collect())
    model = None
    if rows:
        texts, bad = [t.encode() for t, _ in rows], np.array([q != 1 for _, q in rows])
        offsets, data = np.concatenate([[0], np.cumsum(list(map(len, texts)))]), np.frombuffer(b"".join(texts), np.uint8)
        x, _, first = line_features(data, offsets)
        w, trans = fit(x, first, bad)
        model = w, trans, *rising(mean_good(data, offsets, w, trans), (~bad).astype(float))
    df = with_text(docs.drop("score", "predicted"))
    schema = T.StructType(df.schema.fields[:-1]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(range(batch.num_columns - 1))
            for lo, hi, data, offsets in slices(batch, batch.num_columns - 1):
                score = np.full(hi - lo, 0.5)
                if model:
                    w, trans, knots, values = model
                    score = np.clip(np.interp(mean_good(data, offsets, w, trans), knots, values), 0, 1)
                yield pa.RecordBatch.from_arrays([*kept.slice(lo, hi - lo).columns, pa.array(score), pa.array((score >= cutoff).astype(np.int32))], schema=pa.schema([*kept.schema, pa.field("score", pa.float64()), pa.field("predicted", pa.int32())]))

    return df.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
