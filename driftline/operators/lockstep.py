"""Recordings that advance together: one numpy step for the k-th rows of all recordings of a block.

Rows come sorted by recording and time from Spark's own sort, so that a task holds a
block of whole recordings, not its partition; the step's cost in Python is shared by the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftline.shipping import shipped

#: Rows of a block, at least; a recording is never cut.
ROWS = 1 << 18


def starts(ids: pa.ChunkedArray) -> np.ndarray:
    """The first rows of runs of equal ids; null is an id of its own."""
    codes = ids.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole recordings with their starts, from batches sorted by recording."""
    held, n, least = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        start = starts(table["recording_id"])
        cut = int(start[-1])  # the last recording may go on
        if cut:
            yield table.slice(0, cut), start[:-1]
        held, n = table.slice(cut).to_batches(), n - cut
        least = max(rows, 2 * n)  # so that a long recording is not looked through again for each batch
    if n:
        table = pa.Table.from_batches(held)
        yield table, starts(table["recording_id"])


def steps(start: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step the recordings that have a row yet, by their numbers, and these rows."""
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    falling = -length[order]
    for i in range(int(length.max())):
        live = order[: np.searchsorted(falling, -i, "left")]
        yield live, start[live] + i


def in_blocks(df: DataFrame, run: Callable[[pd.DataFrame, np.ndarray], dict], columns: str, also: tuple[str, ...] = ("t_us", "seq")) -> DataFrame:
    """run on blocks: it gets their rows in order, without recording_id, and the recordings' starts, and returns `columns` (DDL) by name, a value for each row.

    Returns recording_id and `also` with the types they have in df, then `columns`.
    """
    shipped(df.sparkSession)
    ids, new = ["recording_id", *also], T._parse_datatype_string(columns)
    schema = T.StructType([df.schema[c] for c in ids] + new.fields)
    kinds = {f.name: {"double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in new.fields}

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in blocks(batches):
            with np.errstate(all="ignore"):
                out = run(table.drop_columns(["recording_id"]).to_pandas(), start)
            made = [pa.array(out[c], type=kind, from_pandas=True) for c, kind in kinds.items()]  # NaN is null
            yield from pa.Table.from_arrays([*(table[c] for c in ids), *made], names=[*ids, *kinds]).combine_chunks().to_batches(max_chunksize=10_000)

    return df.repartition("recording_id").sortWithinPartitions("recording_id", "t_us", "seq").mapInArrow(blockwise, schema)
