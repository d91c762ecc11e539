"""The filters as stateful operators of a stream: vertical, attitude, inertial, stillness, modes and the whole suite.

A recording's state is kept by Spark from batch to batch, as numbers in arrays
(the suite's as bytes), and is restored from the checkpoint after a restart. Rows
of a batch are sorted by time; a row that is late by RESTART_US at most is dropped
and counted, a longer step back is a restart of the device: a new segment with a
new filter. Where an idle time is given, a recording that the watermark leaves so
far behind gets a last row, with `idle` set, and its state is dropped.

The state store has to be RocksDB's; `stateful` sets it for the session.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.operators import inertial, suite
from driftline.operators.filters import Attitude, Vertical
from driftline.shipping import shipped

RESTART_US = 500_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Kernel:
    """A filter of a stream: how it starts, takes the rows of one batch, and goes into numbers and back."""

    start: Callable[[], object]
    run: Callable[[object, pd.DataFrame], pd.DataFrame]
    columns: str
    pack: Callable[[object], list[float]] | None = None
    unpack: Callable[[list[float]], object] | None = None


class Processor(StatefulProcessor):
    def __init__(self, kernel: Kernel, idle_s: float | None):
        self.kernel, self.idle_s = kernel, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filter", "t_us long, segment long, late long, " + ("numbers array<double>" if self.kernel.pack else "kernel binary"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, segment, late, k = None, 0, 0, None
        if self.state.exists():
            last, segment, late, held = self.state.get()
            k = self.kernel.unpack(list(held)) if self.kernel.pack else pickle.loads(held)
        frame = pd.concat(list(rows)).sort_values(["t_us", "seq"], ignore_index=True)
        t = frame["t_us"].to_numpy(np.int64)
        # Sorted rows can be late only at a batch's start.
        behind = t < last if last is not None else np.zeros(len(t), bool)
        if behind.any() and last - t[0] > RESTART_US:
            segment, k = segment + 1, None
        else:
            late += int(behind.sum())
            frame = frame[~behind].reset_index(drop=True)
        if len(frame):
            k = self.kernel.start() if k is None else k
            out = self.kernel.run(k, frame)
            yield pd.concat([frame[["recording_id", "t_us", "seq"]], out.reset_index(drop=True)], axis=1).assign(segment=segment, late=late, idle=False)
            last = int(frame["t_us"].iloc[-1])
        if last is not None and k is not None:
            self.state.update((last, segment, late, self.kernel.pack(k) if self.kernel.pack else pickle.dumps(k)))
            if self.idle_s is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(last / 1000 + self.idle_s * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, segment, late, _ = self.state.get()
            self.state.clear()
            names = [c.split()[0] for c in self.kernel.columns.split(", ")]
            yield pd.DataFrame([{"recording_id": key[0], "t_us": last, "seq": None, **dict.fromkeys(names), "segment": segment, "late": late, "idle": True}])

    def close(self) -> None:
        pass


def stateful(df: DataFrame, kernel: Kernel, idle_s: float | None = None) -> DataFrame:
    """recording_id, t_us, seq, the kernel's columns, segment, late (rows dropped so far) and idle of a stream.

    idle_s: needs a watermark, which is set here on the rows' time with as long a delay.
    """
    spark = df.sparkSession
    shipped(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = T.StructType([df.schema["recording_id"], df.schema["t_us"], T.StructField("seq", df.schema["seq"].dataType, True)])
    schema = T.StructType([*own.fields, *T._parse_datatype_string(kernel.columns).fields, *T._parse_datatype_string("segment long, late long, idle boolean").fields])
    if idle_s is not None:
        df = df.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", f"{idle_s} seconds")
    return df.groupBy("recording_id").transformWithStateInPandas(Processor(kernel, idle_s), schema, "Append", "EventTime" if idle_s is not None else "None")


# ---- kernels


def vertical_kernel(acc: str, height: str, **settings) -> Kernel:
    """h, v, bias; as filters.vertical_filter."""

    def run(k: Vertical, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, a, h in zip(frame["t_us"], frame[acc], frame[height], strict=True):
            k.predict(int(t), float(a))
            if h is not None and h == h:
                k.height(float(h))
            out.append(k.x)
        return pd.DataFrame(np.array(out), columns=["h", "v", "bias"])

    def unpack(x: list[float]) -> Vertical:
        k = Vertical(**settings)
        k.x, k.p, k.t_us = np.array(x[:3]), np.array(x[3:12]).reshape(3, 3), int(x[12])
        return k

    return Kernel(lambda: Vertical(**settings), run, "h double, v double, bias double", lambda k: [*k.x.tolist(), *k.p.ravel().tolist(), float(k.t_us)], unpack)


def attitude_kernel(**settings) -> Kernel:
    """roll, pitch, yaw; as filters.attitude_filter."""

    def run(k: Attitude, frame: pd.DataFrame) -> pd.DataFrame:
        g, a = frame[["gyr_x", "gyr_y", "gyr_z"]].to_numpy(), frame[["acc_x", "acc_y", "acc_z"]].to_numpy()
        return pd.DataFrame(np.array([k.step(int(t), g[i], a[i]) for i, t in enumerate(frame["t_us"])]), columns=["roll", "pitch", "yaw"])

    def unpack(x: list[float]) -> Attitude:
        k = Attitude(**settings)
        k.q, k.bias, k.p, k.t_us = np.array(x[:4]), np.array(x[4:7]), np.array(x[7:43]).reshape(6, 6), int(x[43])
        return k

    return Kernel(lambda: Attitude(**settings), run, "roll double, pitch double, yaw double", lambda k: [*k.q.tolist(), *k.bias.tolist(), *k.p.ravel().tolist(), float(k.t_us)], unpack)


def inertial_kernel(fix_arm: tuple = (0.0, 0.0, 0.0), range_arm: tuple = (0.0, 0.0, 0.0), **settings) -> Kernel:
    """Position, velocity, attitude and sigmas; as inertial.inertial_filter, its ring of past states included."""
    arm, to_ranges = np.array(fix_arm, float), np.array(range_arm, float)
    names = [c.split()[0] for c in inertial.OUT.format(id="x").split(", ")][3:]

    def run(k: inertial.Inertial, frame: pd.DataFrame) -> pd.DataFrame:
        rows, out = inertial.measured_rows(frame), []
        for i, t in enumerate(frame["t_us"]):
            m = rows(i)
            k.begin(m) if k.t_us is None else None
            k.predict(int(t), m.imu[:3], m.imu[3:])
            inertial.correct(k, m, arm, to_ranges)
            out.append(np.concatenate([k.p, k.v, k.rpy(), np.sqrt(np.diag(k.cov)[:3])]))
        return pd.DataFrame(np.array(out), columns=names)

    def pack(k: inertial.Inertial) -> list[float]:
        return np.concatenate([[k.t_us, k.rejected, k.late], k.p, k.v, k.q, k.ba, k.bg, k.rate, k.cov.ravel(), k.history.times, np.ravel(k.history.states)]).astype(float).tolist()

    def unpack(x: list[float]) -> inertial.Inertial:
        k, x = inertial.Inertial(**settings), np.array(x)
        k.t_us, k.rejected, k.late = (int(v) for v in x[:3])
        k.p, k.v, k.q, k.ba, k.bg, k.rate = np.split(x[3:22], [3, 6, 10, 13, 16])
        k.cov, rest = x[22:247].reshape(15, 15), x[247:]
        n = len(rest) // 14  # a time and 13 numbers each
        k.history = inertial.History([int(v) for v in rest[:n]], rest[n:].reshape(n, 13))
        return k

    return Kernel(lambda: inertial.Inertial(**settings), run, ", ".join(f"{n} double" for n in names), pack, unpack)


def suite_kernel(gate: dict | None = None, still: dict | None = None, level: dict | None = None, **settings) -> Kernel:
    """As suite.suite_track."""
    start = lambda: suite.Suite(gate=suite.Gate(**gate or {}), still=suite.Still(**still or {}), level=suite.LevelWindow(**level or {}), **settings)
    return Kernel(start, lambda k, frame: pd.DataFrame([k.step(m) for m in suite.epochs(frame)]), suite.OUT)
