"""Language identification by a bidirectional gated recurrent network over bytes.

Method: the network is trained in numpy by backpropagation through time on a
bounded sample of labelled texts (SAMPLE rows, chosen by hash of the id, of at
most LONGEST characters each). It gives every byte position of every text
probabilities of the languages; a text's are the mean over its positions.

Whole texts are cut into chunks of STRIDE bytes that overlap their neighbours by
CONTEXT bytes on either side, which the network reads but whose labels belong to
the neighbour; the chunks of many texts go through it together.

Cases: a null text, or one without a letter, is `und` with score 0; without
labelled rows every text is `und`; repeated rows each get the same answer;
other columns are kept, `lang_pred` and `score` replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import held_out, shipped, slices, table, training_sample, with_text

SAMPLE, LONGEST = 2000, 20_000
HIDDEN, STEPS, BATCH, LENGTH = 8, 350, 192, 64
STRIDE, CONTEXT, TOGETHER = 112, 8, 2048
UNKNOWN = "und"
Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(w: Weights, side: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """State after bytes x, and the gates that led there."""
    k = h.shape[1]
    g, a = np.take(w[f"E{side}"], x, axis=0), h @ w[f"U{side}"]
    an = a[:, 2 * k :] + w[f"b{side}"]
    zr = sigmoid(g[:, : 2 * k] + a[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = sigmoid(2 * (g[:, 2 * k :] + r * an)) * 2 - 1
    return n + z * (h - n), z, r, n, an


def backward(w: Weights, side: str, xs: np.ndarray, trace: list, dhs: np.ndarray, grad: Weights) -> None:
    """Adds the gradient of one direction. xs and dhs in its order of time; trace: (state before, z, r, n, an)."""
    k, u = dhs.shape[2], w[f"U{side}"]
    dh, dgs = np.zeros_like(dhs[0]), np.empty((*xs.shape, 3 * k), np.float32)
    for t in reversed(range(len(xs))):
        h, z, r, n, an = trace[t]
        dh = dh + dhs[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr, da = dh * (h - n) * z * (1 - z), dn * an * r * (1 - r), dn * r
        back = np.concatenate([dz, dr, da], 1)
        dgs[t] = np.concatenate([dz, dr, dn], 1)
        grad[f"U{side}"] += h.T @ back
        grad[f"b{side}"] += da.sum(0)
        dh = dh * z + back @ u.T
    flat, x = dgs.reshape(-1, 3 * k), xs.ravel()
    for c in range(3 * k):
        grad[f"E{side}"][:, c] += np.bincount(x, flat[:, c], 256)


def train(texts: list[bytes], labels: np.ndarray, classes: int, seed: int = 1) -> Weights:
    rng, k = np.random.default_rng(seed), HIDDEN
    w = {f"{m}{s}": rng.normal(0, scale, shape).astype(np.float32) for s in "fb" for m, shape, scale in (("E", (256, 3 * k), 0.3), ("U", (k, 3 * k), 0.3), ("b", (k,), 0.0), ("O", (k, classes), 0.3))}
    w["o"] = np.zeros(classes, np.float32)
    m, v = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    pools = [[np.frombuffer(texts[i].ljust(LENGTH), np.uint8) for i in np.flatnonzero(labels == c)] for c in range(classes)]
    for it in range(1, STEPS + 1):
        y = rng.integers(classes, size=BATCH)
        rows = []
        for c in y:
            text = pools[c][rng.integers(len(pools[c]))]
            at = rng.integers(len(text) - LENGTH + 1)
            rows.append(text[at : at + LENGTH])
        xs = np.array(rows).T
        states, traces = {}, {}
        for s, order in (("f", xs), ("b", xs[::-1])):
            h, hs, trace = np.zeros((BATCH, k), np.float32), [], []
            for x in order:
                new, *gates = step(w, s, x, h)
                trace.append((h, *gates))
                hs.append(h := new)
            states[s], traces[s] = np.array(hs), trace
        states["b"] = states["b"][::-1]
        logits = states["f"] @ w["Of"] + states["b"] @ w["Ob"] + w["o"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        p /= p.shape[0] * BATCH
        grad = {n: np.zeros_like(x) for n, x in w.items()}
        grad["o"] = p.sum((0, 1))
        for s, order in (("f", 1), ("b", -1)):
            grad[f"O{s}"] = np.einsum("tnk,tnc->kc", states[s], p)
            backward(w, s, xs[::order], traces[s], (p @ w[f"O{s}"].T)[::order], grad)
        rate = 0.02 * min(1, 3 * (1 - it / (STEPS + 1)))
        for n in w:
            m[n] = 0.9 * m[n] + 0.1 * grad[n]
            v[n] = 0.98 * v[n] + 0.02 * grad[n] ** 2
            w[n] -= (rate * m[n] / (1 - 0.9**it) / (np.sqrt(v[n] / (1 - 0.98**it)) + 1e-7)).astype(np.float32)
    return w


def pooled(w: Weights, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over each text's positions of the positions' probabilities; zeros for an empty text."""
    classes, sizes = len(w["o"]), np.diff(offsets)
    chunks = -(-sizes // STRIDE)
    total = int(chunks.sum())
    out = np.zeros((len(sizes), classes))
    if not total:
        return out
    doc = np.repeat(np.arange(len(sizes)), chunks)
    at = offsets[:-1][doc] + STRIDE * (np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    length = STRIDE + 2 * CONTEXT
    padded = np.concatenate([data, np.full(1, 0x20, np.uint8)])
    for lo in range(0, total, TOGETHER):
        begin, d = at[lo : lo + TOGETHER], doc[lo : lo + TOGETHER]
        where = begin - CONTEXT + np.arange(length)[:, None]
        inside = (where >= offsets[d]) & (where < offsets[d + 1])
        xs = padded[np.where(inside, where, len(data))].astype(np.intp)
        n = len(d)
        h, forward = np.zeros((n, HIDDEN), np.float32), np.empty((STRIDE, n, HIDDEN), np.float32)
        for t in range(CONTEXT + STRIDE):
            h = step(w, "f", xs[t], h)[0]
            if t >= CONTEXT:
                forward[t - CONTEXT] = h
        h, sums = np.zeros((n, HIDDEN), np.float32), np.zeros((n, classes))
        for t in range(length - 1, CONTEXT - 1, -1):
            h = step(w, "b", xs[t], h)[0]
            if t < CONTEXT + STRIDE:
                p = forward[t - CONTEXT] @ w["Of"] + h @ w["Ob"] + w["o"]
                np.exp(p - p.max(1, keepdims=True), out=p)
                p *= (inside[t] / p.sum(1))[:, None]
                sums += p
        for c in range(classes):
            out[:, c] += np.bincount(d, sums[:, c], len(sizes))
    return out / np.maximum(sizes, 1)[:, None]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    count = np.concatenate([[0], np.cumsum(letter[data])])
    found = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return found


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs with lang_pred and score; labelled: doc_id, text, lang to learn from."""
    spark = docs.sparkSession
    shipped(spark)
    rows = training_sample(labelled, labelled.select("doc_id", "lang"), "lang", SAMPLE, LONGEST).collect()
    rows = sorted((r["label"], r["text"]) for r in rows if r["text"])
    names = sorted({a for a, _ in rows})
    w = train([t.encode() for _, t in rows], np.array([names.index(a) for a, _ in rows]), len(names)) if names else None
    df = with_text(docs.drop("lang_pred", "score"))
    schema = T.StructType(df.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(range(batch.num_columns - 1))
            for lo, hi, data, offsets in slices(batch, batch.num_columns - 1):
                found = has_letter(data, offsets) if w else np.zeros(hi - lo, bool)
                p = pooled(w, data, offsets) if w else np.zeros((hi - lo, 1))
                best = p.argmax(1)
                lang = [names[b] if ok else UNKNOWN for b, ok in zip(best, found, strict=True)]
                score = np.where(found, np.clip(p.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*kept.slice(lo, hi - lo).columns, pa.array(lang, pa.string()), pa.array(score)], schema=pa.schema([*kept.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    return df.mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
