"""Byte-level BPE encoding and decoding with a public vocabulary.

Method: each word holds its part boundaries and the ranks of adjacent pairs in
one contiguous array; the smallest rank is looked for again and again, the
boundary between the pair is deleted, and the two neighbouring ranks are looked
up anew. Words of up to SHORT bytes go through it together, one row of a matrix
each; longer words use a heap over linked parts, with the same result.

Cases: a null or empty text has no ids and decodes to an empty text; the special
token's string inside a text becomes its id; repeated rows are encoded each for
itself; other columns are kept as they are, `ids` and `decoded` replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import apart, shipped, table, with_text

SHORT = 48
SLOTS = 1 << 19
NONE = np.int32(2**31 - 1)
#: Bytes (strings, ids and dictionary entries, roughly) of the words, and of the chunks, that a task remembers;
#: the memory is emptied when it is full. A string longer than KEPT is not remembered.
REMEMBERED, ENTRY, KEPT = 24 << 20, 240, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spread(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)


class Vocabulary:
    """Tables made from a vocabulary file: pair of ids -> rank and id of the merged part; id -> bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.pattern = pattern
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.uint32)
        self.keys, self.ranks = np.zeros(SLOTS, np.uint32), np.full(SLOTS, NONE, np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        at, left = spread(keys), np.arange(len(keys))
        while len(left):  # one pair for each slot at a time; the others go to the next slot
            free = left[self.ranks[at[left]] == NONE]
            slots, which = np.unique(at[free], return_index=True)
            self.keys[slots], self.ranks[slots] = keys[free[which]], free[which]
            left = np.setdiff1d(left, free[which])
            at[left] = (at[left] + 1) % SLOTS
        parts = {i: bytes(letters[c] for c in s) for s, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        every = [parts.get(i, b"") for i in range(max(parts) + 1)]
        self.lengths = np.array([len(x) for x in every], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(every), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at, out = spread(keys), np.full(len(keys), NONE, np.int32)
        left = np.arange(len(keys))
        while len(left):
            slot = at[left]
            ranks, hit = self.ranks[slot], self.keys[slot] == keys[left]
            out[left] = np.where(hit, ranks, NONE)
            left = left[~hit & (ranks != NONE)]
            at[left] = (at[left] + 1) % SLOTS
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        n, lengths = len(words), np.array([len(w) for w in words])
        width = int(lengths.max())
        ids = np.zeros((n, width + 1), np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        ids[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width + 1), NONE, np.int32)
        paired = inside[:, 1:]
        ranks[:, :-1][paired] = self.rank(ids[:, :-1][paired], ids[:, 1:][paired])
        live, columns = np.arange(n), np.arange(width)
        while len(live):
            r, p = ranks[live], ids[live]
            j = r.argmin(1)
            rows = np.arange(len(live))
            least = r[rows, j]
            on = least != NONE
            live, r, p, j, least = live[on], r[on], p[on], j[on], least[on]
            rows = rows[: len(live)]
            if not len(live):
                break
            p[rows, j] = self.made[least]
            take = columns + (columns > j[:, None])  # the boundary behind j goes
            p[:, :-1] = np.take_along_axis(p, take, 1)
            take = columns + (columns >= j[:, None])
            r[:, :-1] = np.take_along_axis(r, take, 1)
            r[:, -1] = NONE
            lengths[live] -= 1
            more = j + 1 < lengths[live]
            r[rows[more], j[more]] = self.rank(p[rows[more], j[more]], p[rows[more], j[more] + 1])
            r[rows[~more], j[~more]] = NONE
            more = j > 0
            r[rows[more], j[more] - 1] = self.rank(p[rows[more], j[more] - 1], p[rows[more], j[more]])
            ranks[live], ids[live] = r, p
        packed = ids[np.arange(width + 1) < lengths[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(lengths)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i] if ids[i] == a else n
            if k >= n or ids[k] != b:
                continue
            ids[i], ids[k], after[i] = int(self.made[r]), -1, after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    pair = ids[x], ids[y]
                    if pair not in known:
                        known[pair] = int(self.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if known[pair] != NONE:
                        heapq.heappush(heap, (known[pair], x, *pair))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for least, most in ((1, 4), (5, 8), (9, 12), (13, 16), (17, 24), (25, SHORT)):
            which = np.flatnonzero((sizes >= least) & (sizes <= most)).tolist()
            for lo in range(0, len(which), 20_000):
                some = which[lo : lo + 20_000]
                for i, ids in zip(some, self.merge_short([words[i] for i in some]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.merge_long(words[i])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
        return self.bytes[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes()


class Encoder:
    """A vocabulary, and the words and chunks met so far.

    A chunk is what lies between two single spaces, or a single line feed and
    what follows it up to a space. No part of a text reaches over such a place,
    so each chunk's ids stay the same wherever it stands. Texts with other runs
    of white space, or with a special token, are split by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}
        self.held = {"words": 0, "chunks": 0}
        self.pattern = regex.compile(vocabulary.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def parts(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out: list[str] = []
        for k, piece in enumerate(self.special.split(text)):
            out += [f"\0{piece}"] if k % 2 else self.pattern.findall(piece)
        return out

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(t) for t in texts]
        self.make_room("words")
        for s, i in self.vocabulary.special.items():
            self.words[f"\0{s}"] = np.array([i], "<u4").tobytes()
        new = list({w for p in parts for w in p if w not in self.words})
        self.words.update(zip(new, self.vocabulary.merge([w.encode() for w in new]), strict=True))
        out = [b"".join(map(self.words.__getitem__, p)) for p in parts]
        self.remember("words", new)
        return out

    def make_room(self, name: str) -> None:
        if self.held[name] > REMEMBERED:
            getattr(self, name).clear()
            self.held[name] = 0

    def remember(self, name: str, new: list[str]) -> None:
        """Counts what was added, and forgets long strings."""
        known = getattr(self, name)
        for w in [w for w in new if len(w) > KEPT]:
            del known[w]
        self.held[name] += ENTRY * sum(len(w) <= KEPT for w in new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        self.make_room("chunks")
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        for chunks in split:
            chunks[0] = f" {chunks[0]}"  # marks that no space stands before it; no other chunk holds a space
        new = list(set().union(*split).difference(self.chunks))
        whole = [w for w in new if w.strip() and not w[w[0] in " \n" :][0].isspace() and not w[-1].isspace()]
        self.chunks.update(dict.fromkeys(new))
        self.chunks.update(zip(whole, self.encode_parts([w[1:] if w[0] == " " else w if w[0] == "\n" else f" {w}" for w in whole]), strict=True))
        out = [None if None in ids else b"".join(ids) for ids in ([self.chunks[w] for w in chunks] for chunks in split)]
        self.remember("chunks", new)
        if self.special is not None:
            out = [None if self.special.search(t) else ids for t, ids in zip(texts, out, strict=True)]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.encode_parts([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def _mapped(shared, fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)  # one for a task: a worker that is used again holds nothing of it
        for batch in batches:
            for _, _, kept, texts in apart(batch, batch.num_rows):
                ids = encoder.encode(texts.to_pylist())
                decoded = [encoder.vocabulary.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=pa.schema([*kept.schema, *fields]))

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of docs with `ids` (binary: little-endian unsigned 32-bit integers) and `decoded` (string).

    path: vocabulary file, read by the driver; its tables (of the vocabulary's size) are broadcast.
    """
    spark = docs.sparkSession
    shipped(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path, pattern))
    df = with_text(docs, text).drop("ids", "decoded")
    schema = T.StructType(df.schema.fields[:-1]).add("ids", "binary").add("decoded", "string")
    return df.mapInArrow(_mapped(shared, pa.schema([("ids", pa.binary()), ("decoded", pa.string())])), schema)


def ids_as_array(ids: str = "ids"):
    """The ids of a packed column as an array of integers, by built-in functions."""
    hexed = F.hex(F.col(ids))
    n = (F.length(hexed) / 8).cast("int")
    byte = lambda i, k: F.substring(hexed, i * 8 + 2 * k + 1, F.lit(2))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("int")))


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
