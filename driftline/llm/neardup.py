"""Near-duplicates by DartMinHash signatures and banded joining.

Method: a text's elements are its SHINGLE-word shingles, weighted by how often
they occur; each unit of weight is a region at which a hashed Poisson process
throws darts along the rank axis. The axis is cut into cells of doubling width,
so that all texts meet the same darts; a text with total weight W looks at ranks
below DARTS / W, which gives about DARTS darts whatever its length. Each dart
falls on one of COORDINATES; each coordinate keeps its earliest dart. Where one
stays empty the text looks twice as far.

BANDS bands of ROWS coordinates are the keys of the join. Texts of a key are
compared with the first of them and with the one before them, salted groups
first and then their firsts, so that no group is gathered and the pairs grow
with the rows. Keys of more texts that still fall into several classes are
compared once more in blocks of BLOCK, all pairs of different classes, each pair
under the first key that it shares; a block returns no more links than it has
texts. Every link rests on the exact weighted Jaccard
similarity of the shingles. Links are joined into classes by the least label.

Exact copies are one text from the start; they are told by a 64-bit hash.

Cases: a null text is an empty one; texts without words are classed by equality
alone; texts of fewer than SHINGLE words have one shingle, all their words;
repeated rows fall into one class; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint, grams, mixed, released, shipped, slices, stored, table, word_hashes, word_spans

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
DARTS = int(COORDINATES * (np.log(COORDINATES) + 2))
FIRST_CELL = 1 / 16
SALTS, BLOCK = 64, 512
#: Bits of the map that tells which texts' shingles are needed; where it fills up, more are read than needed.
MAP_BITS = 1 << 25
#: Signatures that agree on fewer coordinates (of 80) are not compared: at similarity 0.8 one in a million agrees on so few.
AGREE = 46


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' shingles, sorted within each text and told apart by copy, and each text's first."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(begin[-1], np.uint64)
    owner = np.repeat(np.arange(len(n)), counts)
    at = first[:-1][owner] + np.arange(len(out)) - begin[:-1][owner]
    long = n[owner] >= SHINGLE
    out[long] = grams(h, SHINGLE)[at[long]] if long.any() else 0
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        out[begin[i]] = grams(h[first[i] : first[i + 1]], int(n[i]))[0]
    order = np.lexsort((out, owner))
    out = out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    copy = np.arange(len(out)) - np.repeat(run, np.diff(np.append(run, len(out))))
    again = copy > 0
    out[again] = mixed(out[again] + copy[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out, begin


def poisson_steps(mean: float) -> np.ndarray:
    p, total, out, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-12 and k < mean + 40 * np.sqrt(mean) + 40:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, owner: np.ndarray, reach: np.ndarray, texts: int) -> np.ndarray:
    """[texts, COORDINATES]: each coordinate's earliest dart below the text's reach, 0 where there is none."""
    rank, name = np.full(texts * COORDINATES, np.inf), np.zeros(texts * COORDINATES, np.uint64)
    low, width, cell = 0.0, FIRST_CELL, 0
    farthest = float(reach.max()) if texts else 0.0
    while low < farthest:
        near = np.flatnonzero(reach[owner] > low)
        e, o = elements[near], owner[near]
        salt = mixed(np.array([cell + 1], np.uint64))[0]
        pieces = max(1, int(width // 64))  # wide cells are cut, so that tables of Poisson steps stay short
        for piece in range(pieces):
            seed = mixed(e ^ mixed(np.array([salt + np.uint64(piece)], np.uint64))[0])
            count = np.searchsorted(poisson_steps(width / pieces), unit(seed), "right")
            at = np.repeat(np.arange(len(e)), count)
            nth = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
            dart = mixed(seed[at] + (nth + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            r = low + width * (piece + unit(mixed(dart + np.uint64(7)))) / pieces
            slot = o[at] * COORDINATES + (dart % np.uint64(COORDINATES)).astype(np.int64)
            inside = r < reach[o[at]]
            slot, r, dart = slot[inside], r[inside], dart[inside]
            order = np.lexsort((r, slot))
            slot, r, dart = slot[order], r[order], dart[order]
            lead = np.ones(len(slot), bool)
            lead[1:] = slot[1:] != slot[:-1]
            slot, r, dart = slot[lead], r[lead], dart[lead]
            better = r < rank[slot]
            rank[slot[better]], name[slot[better]] = r[better], dart[better]
        low, width, cell = low + width, low + width, cell + 1
    return name.reshape(texts, COORDINATES)


def signatures(elements: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """[texts, COORDINATES] of 16 bits each; rows of texts without elements are zeros."""
    weight = np.diff(begin)
    out = np.zeros((len(weight), COORDINATES), np.uint64)
    todo, reach = np.flatnonzero(weight > 0), DARTS / np.maximum(weight, 1)
    while len(todo):
        at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in todo])
        out[todo] = darts(elements[at], np.repeat(np.arange(len(todo)), weight[todo]), reach[todo], len(todo))
        todo = todo[(out[todo] == 0).any(1)]
        reach[todo] *= 2
    return (mixed(out) & np.uint64(0xFFFF)).astype("<u2")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, "text", 1 << 20):
            elements, begin = shingles(data, offsets)
            rows = [s.tobytes() if w else None for s, w in zip(signatures(elements, begin), np.diff(begin), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(rows, pa.binary())], names=["doc_id", "node", "sig"])


def _shingled(needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(needed.value, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) % MAP_BITS
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for lo, hi, data, offsets in slices(batch, "text", 1 << 20):
                elements, begin = shingles(data, offsets)
                rows = [np.sort(elements[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(rows, pa.binary())], names=["node", "set"])

    return run


def bitmap(nodes: DataFrame) -> bytes:
    """A map of MAP_BITS bits of the nodes' hashes; it comes to the driver in pieces of 4 KB, MAP_BITS / 8 bytes at most."""
    at = F.pmod(F.col("node"), F.lit(MAP_BITS)).cast("long")
    pieces = nodes.select(F.bitmap_bucket_number(at + 1).alias("k"), F.bitmap_bit_position(at + 1).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("m")).collect()
    out = bytearray(MAP_BITS // 8)
    for r in pieces:
        lo = (r["k"] - 1) * len(r["m"])
        out[lo : lo + len(r["m"])] = r["m"]
    return bytes(out)


def shingle_sets(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (sorted 64-bit hashes) of the nodes. own: node, text, a row for each document."""
    needed = own.sparkSession.sparkContext.broadcast(bitmap(nodes))
    return own.select("node", "text").mapInArrow(_shingled(needed), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs whose sets have a weighted Jaccard similarity of at least SIMILAR."""
    for batch in batches:
        keep = []
        for i in range(len(batch)):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def keys(signed: DataFrame) -> DataFrame:
    """key, band, node, next, n: a row for each text and band whose key n > 1 texts share.

    next is the following band's key, by which alike texts stand together.
    """
    band = lambda k: F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS))
    some = signed.where(F.col("sig").isNotNull())
    every = F.array(*(F.struct(F.lit(k).alias("band"), band(k).alias("key"), band((k + 1) % BANDS).alias("next")) for k in range(BANDS)))
    shared = some.select(F.explode(F.array(*map(band, range(BANDS)))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return some.select("node", F.explode(every).alias("b")).select("b.key", "b.band", "node", "b.next").join(shared, "key")


def starred(rows: DataFrame) -> DataFrame:
    """Pairs a < b of nodes to compare: with the first of the salted key and the one before, then the same among the firsts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))

    def linked(df: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy("next", "node")
        return df.withColumn("head", F.first("node").over(w)).withColumn("last", F.lag("node").over(w))

    one = linked(salted, ["key", "salt"])
    two = linked(one.where(F.col("head") == F.col("node")).select("key", "node", "next"), ["key"])
    pair = lambda df, other: df.where(F.col(other).isNotNull() & (F.col(other) != F.col("node"))).select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b"))
    both = lambda df: df.select("node", F.explode(F.array("head", "last")).alias("other"))
    return pair(both(one), "other").unionByName(pair(both(two), "other"))


def _block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of different classes in a block, as many as join these.

    A pair is looked at under its first band only, and in a block of two sides only across them.
    """
    n = len(frame)
    sig = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(n, COORDINATES)
    node, side = frame["node"].to_numpy(), frame["side"].to_numpy()
    band, alone = int(frame["band"].iloc[0]), frame["x"].iloc[0] == frame["y"].iloc[0]
    sets = [np.frombuffer(x, np.uint64) for x in frame["set"]]
    _, label = np.unique(frame["label"].to_numpy(), return_inverse=True)
    out = []
    for i in range(n):
        same = sig == sig[i]
        ok = (same.sum(1) >= AGREE) & (same.reshape(n, BANDS, ROWS).all(2).argmax(1) == band) & (node > node[i])
        if not alone:
            ok &= side != side[i]
        for k in np.flatnonzero(ok):
            if label[i] != label[k]:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if both >= SIMILAR * (len(sets[i]) + len(sets[k]) - both):
                    out.append((int(node[i]), int(node[k])))
                    label[label == label[k]] = label[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def classes(links: DataFrame) -> DataFrame:
    """node, label: the least node that links lead to. Labels spread along links and jump to their label's label."""
    edges = checkpoint(links.union(links.select("b", "a")).toDF("src", "dst").distinct())
    label = edges.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node")
    label = checkpoint(label)
    while True:
        near = edges.join(label.toDF("dst", "other"), "dst").groupBy("src").agg(F.min("other").alias("other")).withColumnRenamed("src", "node")
        new = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = checkpoint(new.join(up, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label")))
        label = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return label


def verified(pairs: DataFrame, signed: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs whose texts are similar. own: node, text, a row for each document."""
    sigs = signed.select("node", "sig")
    agree = F.length(F.regexp_replace(F.array_join(F.zip_with(F.split(F.hex("sa"), "(?<=\\G.{4})"), F.split(F.hex("sb"), "(?<=\\G.{4})"), lambda x, y: F.when(x == y, "1").otherwise("")), ""), "[^1]", ""))
    likely = stored(pairs.distinct().join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").where(agree >= AGREE).select("a", "b"))
    sets = stored(shingle_sets(own, likely.select(F.col("a").alias("node")).union(likely.select("b"))))
    full = likely.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return full.mapInArrow(_similar, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least doc_id of its class), kept (the class's first row), n_class (its rows)."""
    return membership(docs).drop("node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their class, each once."""
    first = membership(docs).where("kept").select(F.col("doc_id").alias("__d"), F.col("node").alias("__n")).distinct()
    node = f"__node_{uuid.uuid4().hex}"  # no column of docs is called so
    own = docs.withColumn(node, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = own.join(first, own["doc_id"].eqNullSafe(first["__d"]) & (own[node] == first["__n"]), "left_semi")
    twice = not own.groupBy("doc_id", node).count().where("count > 1").isEmpty()
    return (rows.dropDuplicates(["doc_id", node]) if twice else rows).drop(node)


def membership(docs: DataFrame) -> DataFrame:
    """What near_duplicates returns, with node, the hash of the row's text. docs: doc_id, text."""
    shipped(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    signed = own.mapInArrow(_signed, own.drop("text").schema.add("sig", "binary"))
    signed = stored(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))
    banded = stored(keys(signed))
    released(docs.sparkSession)
    links = checkpoint(verified(starred(banded.select("key", "node", "next")), signed, own))
    label = classes(links)
    released(docs.sparkSession)
    # Keys of three texts or more, of several classes: all pairs of these, in blocks. Of three, starred() may leave out a pair.
    labelled = banded.where("n > 2").join(label, "node", "left").select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    left = stored(labelled.join(several, "key").join(signed.select("node", "sig"), "node"))
    sets = shingle_sets(own, left.select("node").distinct())
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = left.join(sets, "node").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    blocked = dealt.select("key", "band", "node", "label", "sig", "set", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.col("mine").alias("side"))
    more = checkpoint(blocked.groupBy("key", "x", "y").applyInPandas(_block_links, "a long, b long"))
    label = classes(links.union(more)) if not more.isEmpty() else label
    released(docs.sparkSession)
    sizes = signed.join(label, "node", "left").select("node", "rep", "n", F.coalesce("label", "node").alias("label"))
    heads = sizes.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("n_class"), F.min(F.struct(F.col("rep"), F.col("node")))["node"].alias("head"))
    found = sizes.join(heads, "label").select("node", "class_id", "n_class", F.when(F.col("head") == F.col("node"), F.col("rep")).alias("first"), (F.col("head") == F.col("node")).alias("leads"))
    rows = own.select("doc_id", "node").join(found, "node")
    return rows.select("doc_id", "node", "class_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("kept"), "n_class")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
