"""What several operators share: row identity, the fold, and texts as numpy arrays.

Row identity: a document is a row with its own (doc_id, text). Rows that repeat
both are one document that is listed twice: they count once and each of them
gets the document's result. A null doc_id is an id like any other; a null text
is an empty text.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.shipping import shipped as shipped

#: White space between words, as bytes.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of this machine's only where Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/driftline-checkpoints"
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; for small tables."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder: cuts the lineage with less disk than a checkpoint."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/driftline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Removes tables that `stored` wrote and that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark removes the shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text: null texts are empty, th tells texts under one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, longest: int) -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold, of `longest` characters at most: text, label.

    The ids are chosen by hash, so that only they, never the texts, are ordered.
    """
    chosen = (
        labels.where(F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col(target).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "label").limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    return found.orderBy(F.xxhash64("doc_id"), "label", "text").limit(rows)  # more than `rows` only where rows repeat an id


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one more column at its end: the text, empty where null. What the others are called does not matter."""
    return df.withColumn(f"__text_{uuid.uuid4().hex}", F.coalesce(F.col(text), F.lit("")))


def apart(batch: pa.RecordBatch, rows: int, most: int = 1 << 20) -> Iterator[tuple[int, int, pa.RecordBatch, pa.Array]]:
    """Runs of at most `rows` rows and about `most` bytes of text: first row, last row, the columns kept, and the texts.

    batch: rows of what `with_text` returns.
    """
    kept = batch.select(range(batch.num_columns - 1))
    texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
    sizes = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1))
        yield lo, hi, kept.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes: first row, last row, their bytes, and offsets into these."""
    texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and each text's first word (one more entry at the end)."""
    inside = ~IS_SPACE[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets < len(data)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024), BASE))])
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words' bytes, mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    power = powers(int(lengths.max()) + 1)
    values = (data[at].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(starts, lengths)]
    return mixed(np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]])))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word; windows that run over a text's end are to be left out by the caller."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * BASE + h[k : len(h) - n + 1 + k]
    return mixed(out)
