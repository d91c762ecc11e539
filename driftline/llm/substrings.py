"""Removal of passages of WINDOW words that stand anywhere else.

Method: compressed FM-indexes of shards, backward search over wavelet matrices,
matching statistics, and the intervals of them that reach WINDOW words.

What lets the shards be independent: each window is filed under its minimizer,
the least hash among its GRAM-word grams. Equal windows have equal minimizers,
so a window's other occurrences are all filed under the same key. Runs of
windows with one minimizer at one place make a segment. Keys that occur once are
done. Equal segments of a key become one, with a count, before any text moves;
the texts of those that are left are dealt to shards by key. A shard's index
holds its segments; the segments are streamed through it backwards, and the
matching statistics at the ends of windows tell how far back the words are found
at least twice. Segments counted twice or more are repeated throughout. Keys
with over HOT different segments (the edges of a passage that very many
documents share) are dealt window by window, equal windows first made one.

Keys and equal segments are told by 64-bit hashes, so two different segments are
taken for one only if both of theirs collide; all else is compared word by word.

Cases: a null or empty text has no words; texts of fewer than WINDOW words keep
all; a row repeated with the same doc_id and text is one document whose windows
count once; rows that share an id but not the text are told apart; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import BASE, discarded, grams, keyed, mixed, released, shipped, slices, stored, table, word_hashes, word_spans

WINDOW, GRAM = 35, 8
LONGEST_RUN = 256
SHARD, HOT = 3000, 3000


# ---- windows and their minimizers -------------------------------------------------


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window (counted in the text), windows, key and hash of each segment."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n, none = len(h), np.empty(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none
    g = grams(h, GRAM)
    bits = np.uint64(max(int(n).bit_length(), 1))
    order = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    span, width = WINDOW - GRAM + 1, 1
    while width * 2 <= span:  # least over 2, 4, 8 ... grams, then over all by an overlap
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if width < span:
        order = np.minimum(order[: len(order) - (span - width)], order[span - width :])
    place = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    window = np.arange(len(place))
    doc = np.searchsorted(first, window, "right") - 1
    inside = window + WINDOW <= first[doc + 1]
    window, place, doc = window[inside], place[inside], doc[inside]
    if not len(window):
        return none, none, none, none, none
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(window)) - np.repeat(run, np.diff(np.append(run, len(window))))
    run = np.flatnonzero(nth % LONGEST_RUN == 0)
    size = np.diff(np.append(run, len(window)))
    begin, key, doc = window[run], g[place[run]], doc[run]
    words = size + WINDOW - 1
    at = np.repeat(begin - (np.cumsum(words) - words), words) + np.arange(words.sum())
    power = np.cumprod(np.full(int(words.max()) + 1, BASE | np.uint64(1)))
    nth = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    seg = mixed(np.add.reduceat(h[at] * power[nth], np.cumsum(words) - words) + words.astype(np.uint64))
    return doc, begin - first[doc], size, key.view(np.int64), seg.view(np.int64)


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, offsets in slices(batch):
            doc, begin, size, key, seg = segments(data, offsets)
            row = pa.array(lo + doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(key), pa.array(seg), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))], names=["doc_id", "th", "key", "seg", "w0", "nw"])


# ---- a shard's index --------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in a sequence, by bit vectors packed into 64-bit words with a count for each word."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, n = [], len(sequence)
        s = sequence
        for bit in reversed(range(max(int(symbols - 1).bit_length(), 1))):
            on = (s >> bit & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = on
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64)
            self.levels.append((bit, words, counts, int(n - on.sum())))
            s = np.concatenate([s[~on], s[on]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before `at` end in the last level's order."""
        for bit, words, counts, zeros in self.levels:
            w = at >> 6
            ones = counts[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """An FM-index of texts of symbols from 1 on; 0 stands behind each text."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        # Prefix doubling; nothing behind a 0 counts, as no pattern holds one.
        stop = np.flatnonzero(text == 0)
        left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
        while True:
            behind = np.where(left >= width, np.take(rank, np.minimum(np.arange(n) + width, n - 1)), -1)
            pair = rank * (n + 2) + behind + 1
            order = np.argsort(pair, kind="stable")
            step = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
            new = np.empty(n, np.int64)
            new[order] = step
            done = step[-1] == n - 1 or width > left.max()
            rank, width = new, width * 2
            if done:
                break
        self.size = n
        bwt = text[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.matrix = WaveletMatrix(bwt, symbols)
        every = np.arange(symbols)
        self.base = self.matrix.walk(every, np.zeros(symbols, np.int64))

    def extended(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        at = self.matrix.walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.start[symbol] - self.base[symbol], 2)
        return at[: len(symbol)], at[len(symbol) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """How many words up to each end, not before its begin, are found twice or more."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        while len(live):
            at = ends[live] - length[live]
            live = live[at >= begins[live]]
            a, b = self.extended(text[ends[live] - length[live]], lo[live], hi[live])
            on = b - a >= 2
            live = live[on]
            lo[live], hi[live] = a[on], b[on]
            length[live] += 1
        return length


def repeated_windows(texts: list[list[str]], counts: np.ndarray) -> list[np.ndarray]:
    """For each text of a shard, which of its windows occur twice or more; counts: how often each text occurs."""
    names: dict[str, int] = {}
    sizes = np.array([len(t) + 1 for t in texts])
    flat = np.zeros(sizes.sum(), np.int64)
    stop = np.cumsum(sizes) - 1
    inside = np.ones(len(flat), bool)
    inside[stop] = False
    flat[inside] = [names.setdefault(w, len(names) + 1) for t in texts for w in t]
    begin = stop - sizes + 1
    once = np.flatnonzero(counts == 1)
    out = [np.ones(max(len(t) - WINDOW + 1, 0), bool) for t in texts]
    if not len(once) or len(texts) == 1:
        for i in once:
            out[i][:] = False
        return out
    index = FMIndex(flat, len(names) + 1)
    windows = sizes[once] - WINDOW
    cell = np.concatenate([[0], np.cumsum(windows)])  # a cell for each end of a window
    owner = np.repeat(once, windows)
    ends = begin[owner] + WINDOW - 1 + np.arange(cell[-1]) - np.repeat(cell[:-1], windows)
    first, last = np.repeat(cell[:-1], windows), np.repeat(cell[1:], windows) - 1
    state = np.full(cell[-1], -1)
    for stride in (16, 4, 1):
        todo = np.flatnonzero((state < 0) & ((last - np.arange(cell[-1])) % stride == 0))
        if not len(todo):
            continue
        length = index.matching(flat, ends[todo], begin[owner[todo]])
        found = length >= WINDOW
        for value, lo, hi in ((1, todo - (length - WINDOW), todo), (0, todo, np.minimum(todo + (WINDOW - 1 - length), last[todo]))):
            on = found == bool(value)
            marks = np.zeros(cell[-1] + 1, np.int64)
            np.add.at(marks, np.maximum(lo, first[todo])[on], 1)
            np.add.at(marks, hi[on] + 1, -1)
            state[np.cumsum(marks[:-1]) > 0] = value
    for k, i in enumerate(once):
        out[i] = state[cell[k] : cell[k + 1]] == 1
    return out


def runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    found = repeated_windows([t.split(" ") for t in frame["words"]], frame["n"].to_numpy())
    keep = [i for i, f in enumerate(found) if f.any()]
    return pd.DataFrame({"key": frame["key"].to_numpy()[keep], "seg": frame["seg"].to_numpy()[keep], "runs": [runs(found[i]) for i in keep]})


# ---- the jobs ---------------------------------------------------------------------


def words_of(data: np.ndarray, lo: int, hi: int) -> list[str]:
    return data[lo:hi].tobytes().decode().split(" ")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, seg, part, n, words of each segment asked for; part: the window of a hot key's segment, else -1."""
    for batch in batches:
        asked = batch.column(batch.schema.get_field_index("asked"))
        for lo, hi, data, offsets in slices(batch):
            starts, ends, first = word_spans(data, offsets)
            h = word_hashes(data, starts, ends)
            out: list[tuple] = []
            for i in range(lo, hi):
                for a in asked[i].as_py():
                    w = first[i - lo] + a["w0"]
                    many = a["nw"] + WINDOW - 1
                    words = [data[x:y].tobytes().decode() for x, y in zip(starts[w : w + many], ends[w : w + many], strict=True)]
                    if a["hot"]:
                        hashes = grams(h[w : w + many], WINDOW).view(np.int64).tolist()
                        out += [(a["key"], a["seg"], j, x, a["n"], " ".join(words[j : j + WINDOW])) for j, x in enumerate(hashes)]
                    else:
                        out.append((a["key"], a["seg"], -1, a["seg"], a["n"], " ".join(words)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "seg", "part", "id", "n", "words"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, n_words, n_removed, kept: words covered by a repeated window are left out."""
    for batch in batches:
        kept, n_words, n_removed = [], [], []
        spans = batch.column(batch.schema.get_field_index("spans"))
        for lo, hi, data, offsets in slices(batch):
            starts, ends, first = word_spans(data, offsets)
            for i in range(lo, hi):
                a, b = first[i - lo], first[i - lo + 1]
                gone = np.zeros(b - a + 1, np.int64)
                for x, y in spans[i].as_py() or ():
                    gone[x] += 1
                    gone[y] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                text = data[offsets[i - lo] : offsets[i - lo + 1]].tobytes()
                words = [text[x:y] for x, y in zip((starts[a:b][stay] - offsets[i - lo]).tolist(), (ends[a:b][stay] - offsets[i - lo]).tolist(), strict=True)]
                kept.append(b" ".join(words).decode())
                n_words.append(int(b - a))
                n_removed.append(int(b - a) - len(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "th", "n_words", "n_removed", "kept"])


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """doc_id, th, spans (array of [first word, word behind the last]): what repeated windows cover. docs: doc_id, text."""
    shipped(docs.sparkSession)
    own = keyed(docs)
    once = own.dropDuplicates(["doc_id", "th"]) if _repeats(own) else own
    found = stored(once.mapInArrow(_segmented, own.drop("text").schema.add("key", "long").add("seg", "long").add("w0", "integer").add("nw", "integer")))
    # Keys to join with are stored first: Spark can split the rows of a frequent key only between two plain exchanges.
    shared = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    here = F.struct("doc_id", "th", "w0", "nw")
    linked = stored(found.join(shared, "key"))
    discarded(found, shared)
    distinct = stored(linked.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("at")))
    released(docs.sparkSession)
    shards = distinct.count() // SHARD + 1
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("s"), F.max("n").alias("m"))
    hot = stored(per_key.where(F.col("s") > HOT).select("key", F.lit(True).alias("hot")))
    asked = (
        distinct.join(hot, "key", "left").select("at.*", F.struct("key", "seg", "n", "at.w0", "at.nw", F.coalesce("hot", F.lit(False)).alias("hot")).alias("a"))
        .groupBy("doc_id", "th").agg(F.collect_list("a").alias("asked")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    )
    texts = once.join(asked, once["doc_id"].eqNullSafe(asked["d"]) & (once["th"] == asked["t"])).select("text", "asked")
    pieces = stored(texts.mapInArrow(_texts, "key long, seg long, part integer, id long, n long, words string"))
    discarded(distinct, hot)
    released(docs.sparkSession)
    whole = pieces.where("part < 0").select("key", "seg", "n", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    single = pieces.where("part >= 0").groupBy("key", "id").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    single = single.select("key", F.col("id").alias("seg"), "n", "words", F.pmod(F.xxhash64("key", "id"), F.lit(shards)).alias("shard"))
    kind = "key long, seg long, runs array<array<int>>"
    by_segment = whole.groupBy("shard").applyInPandas(_shard, kind)
    by_window = single.groupBy("shard").applyInPandas(_shard, kind).select("key", F.col("seg").alias("id"))
    of_hot = pieces.where("part >= 0").select("key", "seg", "part", "id").join(by_window, ["key", "id"]).select("key", "seg", F.array(F.array(F.col("part"), F.col("part") + 1)).alias("runs"))
    results = stored(by_segment.unionByName(of_hot))
    discarded(pieces)
    released(docs.sparkSession)
    spans = linked.select("doc_id", "th", "key", "seg", "w0").join(results, ["key", "seg"])
    spans = spans.select("doc_id", "th", F.explode(F.transform("runs", lambda r: F.array(F.col("w0") + r[0], F.col("w0") + r[1] + WINDOW - 1))).alias("span"))
    return spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _repeats(own: DataFrame) -> bool:
    """Whether a row repeats another's doc_id and text."""
    return not own.groupBy("doc_id", "th").count().where("count > 1").isEmpty()


def without_repeats(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    own = keyed(docs)
    spans = repeated_intervals(docs).withColumnsRenamed({"doc_id": "d", "th": "t"})
    joined = own.join(spans, own["doc_id"].eqNullSafe(spans["d"]) & (own["th"] == spans["t"]), "left").select("doc_id", "th", "text", "spans")
    return joined.mapInArrow(_cut, own.drop("text").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")).drop("th")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM repeated
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
