"""The recursive estimators as operators of Structured Streaming: one state for each recording.

Rows of a recording must come in order of time from batch to batch; inside a
batch they are sorted. A step back in time by more than RESTART_US starts a new
state; smaller ones are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.operators.filters import Offset
from driftline.shipping import shipped

RESTART_US = 500_000


def offset_stream(df: DataFrame, walk_var: float, noise_var: float, threshold: float = 10.0) -> DataFrame:
    """recording_id, t_us, seq, estimate, late of a stream with recording_id, t_us, seq and value."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, late = Offset(walk_var, noise_var, threshold), 0
        if state.exists:
            k.value, k.var, k.t_us, late = state.get
        out = []
        for t, seq, z in pd.concat(frames).sort_values(["t_us", "seq"])[["t_us", "seq", "value"]].itertuples(index=False):
            if k.var >= 0 and t < k.t_us:
                if k.t_us - t <= RESTART_US:
                    late += 1
                    continue
                k = Offset(walk_var, noise_var, threshold)
            out.append((key[0], int(t), int(seq), k.step(int(t), float(z)), late))
        state.update((k.value, k.var, k.t_us, late))
        yield pd.DataFrame(out, columns=["recording_id", "t_us", "seq", "estimate", "late"])

    shipped(df.sparkSession)
    return df.select("recording_id", "t_us", "seq", "value").groupBy("recording_id").applyInPandasWithState(run, f"recording_id {df.schema['recording_id'].dataType.simpleString()}, t_us long, seq long, estimate double, late long", "value double, var double, t_us long, late long", "append", GroupStateTimeout.NoTimeout)


def rates(df: DataFrame, bucket: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Rows and mean of value for each recording and window of time; later rows than the watermark allows are left out."""
    timed = df.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", lateness)
    g = timed.groupBy("recording_id", F.window("ts", bucket).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select("recording_id", F.unix_micros("w.start").alias("t0_us"), "n", "mean")
