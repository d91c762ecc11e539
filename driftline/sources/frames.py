"""Binary frames: two sync bytes, class, id, length, payload, and a Fletcher checksum of two bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.shipping import shipped

#: Sync bytes and the longest payload.
SYNC, LONGEST = b"\xb5\x62", 8192


def fletcher(data: Column) -> Column:
    """Both checksum bytes of a binary column as a struct a, b, by built-in functions."""
    hexed = F.hex(data)
    n = F.length(hexed) / 2
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), byte)).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    return F.aggregate(each, zero, lambda s, x: F.struct(((s["a"] + x) % 256).alias("a"), ((s["b"] + s["a"] + x) % 256).alias("b")))


def checksum(body: bytes) -> bytes:
    """The same of bytes: b is the sum of the running sums."""
    x = np.frombuffer(body, np.uint8).astype(np.int64)
    return bytes([int(x.sum() % 256), int(np.cumsum(x).sum() % 256)])


def frame(cls: int, mid: int, payload: bytes) -> bytes:
    body = struct.pack("<BBH", cls, mid, len(payload)) + payload
    return SYNC + body + checksum(body)


class Framer:
    """Frames from pieces of a byte stream; keeps the unfinished end, counts what it skips."""

    def __init__(self) -> None:
        self.rest, self.skipped = b"", 0

    def feed(self, data: bytes) -> list[tuple[int, int, bytes]]:
        buf, at, out = self.rest + data, 0, []
        while (start := buf.find(SYNC, at)) >= 0:
            self.skipped += start - at
            at = start
            if len(buf) < at + 6:
                break
            cls, mid, size = struct.unpack_from("<BBH", buf, at + 2)
            stop = at + 8 + size
            if size > LONGEST:
                self.skipped, at = self.skipped + 2, at + 2
            elif stop > len(buf):
                break
            elif checksum(buf[at + 2 : stop - 2]) == buf[stop - 2 : stop]:
                out.append((cls, mid, buf[at + 6 : stop - 2]))
                at = stop
            else:
                self.skipped, at = self.skipped + 2, at + 2
        else:
            keep = 1 if buf[at:].endswith(SYNC[:1]) else 0
            self.skipped += len(buf) - at - keep
            at = len(buf) - keep
        self.rest = buf[at:]
        return out


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """recording_id (the file's path), seq, cls, id, payload of all frames of binary files, a file to a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                rows = Framer().feed(bytes(content))
                yield pd.DataFrame([(p, i, c, m, x) for i, (c, m, x) in enumerate(rows)], columns=["recording_id", "seq", "cls", "id", "payload"])

    shipped(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "recording_id string, seq long, cls int, id int, payload binary")


def field(payload: Column, at: int, size: int, signed: bool = False) -> Column:
    """A little-endian integer of `size` bytes at an offset, null where the payload is too short; of 8 bytes always signed."""
    if size == 8:
        return F.shiftleft(field(payload, at + 4, 4), 32).bitwiseOR(field(payload, at, 4))
    hexed = F.hex(F.substring(payload, at + 1, size))
    turned = F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in reversed(range(size))))
    value = F.conv(turned, 16, 10).cast("decimal(20,0)").cast("long")
    if signed:
        value = F.when(value >= 2 ** (8 * size - 1), value - F.lit(2 ** (8 * size))).otherwise(value)
    return F.when(F.length(payload) >= at + size, value)


def real(payload: Column, at: int, size: int = 4) -> Column:
    """A little-endian IEEE number of 4 or 8 bytes at an offset, null where the payload is too short."""
    fraction, bias = (23, 127) if size == 4 else (52, 1023)
    bits = field(payload, at, size)
    part = F.shiftrightunsigned(bits, fraction).bitwiseAND(2 * bias + 1)
    rest = bits.bitwiseAND((1 << fraction) - 1).cast("double") / float(1 << fraction)
    sign = F.when(F.shiftrightunsigned(bits, 8 * size - 1).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    value = F.when(part == 0, rest * 2.0 ** (1 - bias)).otherwise((1 + rest) * F.pow(F.lit(2.0), part - bias))
    return sign * F.when(part == 2 * bias + 1, F.when(rest == 0, float("inf")).otherwise(float("nan"))).otherwise(value)


#: Arrow types of the integers and numbers of a layout.
_ARROW = {"i": (np.int64, pa.int64()), "u": (np.int64, pa.int64()), "f": (np.float64, pa.float64())}


def unpacked(payload: Column, size: int, longer: bool = False, **layout: tuple[int, str]) -> Column:
    """A struct of numbers from payloads of `size` bytes (or more, with `longer`), null where they have another size: a batch at a time.

    layout: name -> (offset, numpy's type, as "<u4"); integers become long, numbers double.
    """
    record = np.dtype({"names": list(layout), "offsets": [at for at, _ in layout.values()], "formats": [kind for _, kind in layout.values()], "itemsize": size})
    kinds = [_ARROW[np.dtype(kind).kind] for _, kind in layout.values()]
    schema = ", ".join(f"{n}: {'double' if arrow == pa.float64() else 'bigint'}" for n, (_, arrow) in zip(layout, kinds, strict=True))

    def run(batch: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        whole = n >= size if longer else n == size
        rows = np.zeros(len(batch), record)
        rows[whole] = np.frombuffer(b"".join(pc.binary_slice(batch.filter(pa.array(whole)), 0, size).to_pylist()), record)
        return pa.StructArray.from_arrays([pa.array(rows[c].astype(kind), arrow) for c, (kind, arrow) in zip(layout, kinds, strict=True)], list(layout), mask=pa.array(~whole))

    shipped(SparkSession.active())
    return F.arrow_udf(run, f"struct<{schema}>")(payload)


def bit(flags: Column, n: int) -> Column:
    return F.shiftrightunsigned(flags, n).bitwiseAND(1) == 1


def nav_pvt(payload: Column) -> dict[str, Column]:
    """The receiver's position and velocity message (class 0x01, id 0x07), null where shorter than 92 bytes."""
    longs = {"lon": (24, "<i4"), "lat": (28, "<i4"), "h": (32, "<i4"), "hacc": (40, "<u4"), "vacc": (44, "<u4"), "vn": (48, "<i4"), "ve": (52, "<i4"), "vd": (56, "<i4"), "sacc": (68, "<u4"), "mot": (64, "<i4"), "veh": (84, "<i4")}
    m = unpacked(payload, 92, True, fix_type=(20, "u1"), flags=(21, "u1"), num_sv=(23, "u1"), **longs)
    flags = m["flags"]
    return {
        "fix_type": m["fix_type"], "fix_ok": bit(flags, 0), "carr_soln": F.shiftright(flags, 6).bitwiseAND(3), "num_sv": m["num_sv"],
        "lon_deg": m["lon"] * 1e-7, "lat_deg": m["lat"] * 1e-7, "height_m": m["h"] * 1e-3, "hacc_m": m["hacc"] * 1e-3, "vacc_m": m["vacc"] * 1e-3,
        "vn": m["vn"] * 1e-3, "ve": m["ve"] * 1e-3, "vd": m["vd"] * 1e-3, "sacc_mps": m["sacc"] * 1e-3,
        "head_mot_deg": m["mot"] * 1e-5, "head_veh_deg": m["veh"] * 1e-5, "head_veh_valid": bit(flags, 5),
    }


def timesync(payload: Column) -> dict[str, Column]:
    """A pulse's time on the device and, where it was announced, its GPS time (class 0x40, id 0x05, 28 bytes)."""
    m = unpacked(payload, 28, t_us=(0, "<i8"), count=(8, "<u4"), ms=(12, "<u4"), part=(16, "<u4"), q=(20, "<i4"), week=(24, "<u2"), flags=(26, "<u2"))
    ms, part, week, flags, q = m["ms"], m["part"], m["week"], m["flags"], m["q"]
    valid = bit(flags, 0)
    tow = (ms + part * 2.0**-32) / 1e3
    gps = week * 604800 + tow + F.when(bit(flags, 3), q * 1e-12).otherwise(0.0)
    return {
        "t_us": m["t_us"], "count": m["count"], "tow_ms": ms, "tow_sub_ms": part, "q_err_ps": q, "week": week, "flags": flags,
        "gps_valid": valid, "utc_base": bit(flags, 1), "suspect": bit(flags, 4), "tow_s": F.when(valid, tow), "gps_s": F.when(valid, gps),
    }


def odometry(payload: Column) -> dict[str, Column]:
    """A speed from a host (class 0x40, id 0x80, 30 bytes)."""
    m = unpacked(payload, 30, t_unix_us=(0, "<i8"), t_us=(8, "<i8"), speed_mps=(16, "<f4"), stddev_mps=(20, "<f4"), delay_ms=(24, "<u2"), flags=(26, "<u2"), kind=(28, "<u2"))
    flags = m["flags"]
    same = ("t_unix_us", "t_us", "speed_mps", "stddev_mps", "delay_ms", "flags", "kind")
    return {n: m[n] for n in same} | {"t_us_valid": bit(flags, 4), "reverse": bit(flags, 0) & bit(flags, 1)}


#: Axes by bit, names of the counters, bits of the solution's flags, names of modes and sources.
AXES = ("acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z")
STATUS = ("tx_dropped", "imu_overruns", "loop_count", "uart_errors", "cfg_fail_mask", "vcp_dropped", "gnss_rx_bytes", "gnss_tx_dropped", "gnss_rx_overflows", "gnss_crc_errors")
HEALTH = ("stalls", "reinits", "reinit_fails", "spi_errors", "last_busy", "last_overruns", "last_spi_error", "last_spi_state", "last_exti_pend", "last_drdy_level", "last_fifo_used", "at_seq", "at_ms", "reg_whoami", "reg_pwr_mgmt0", "reg_int1_cfg0", "reg_read_rc", "sat_sticky", "sat_samples")
FLAGS = ("ready", "rpy", "rpy_sigma", "yaw_sigma", "vel", "pos", "latlon", "height", "height_ell", "baro_alt", "baro_meas", "vz", "leverarm", "leverarm_bad", "zupt", "zaru", "vzupt", "mag_ref")
MODES, SOURCES = ("none", "attitude", "coasting", "full"), ("none", "ins", "ahrs", "ars")


def axes(mask: Column) -> Column:
    """Names of the axes in a mask, in the order of the bits."""
    return F.array_compact(F.array(*(F.when(bit(mask, i), n) for i, n in enumerate(AXES))))


def counters(payload: Column, names: tuple[str, ...] = STATUS) -> dict[str, Column]:
    """Counters of 4 bytes each by name (class 0x40, id 0x04 or 0x0D): null beyond the frame's end, `extra` what has no name."""

    def run(batch: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        whole = (n > 0) & (n % 4 == 0)
        words = np.frombuffer(b"".join(batch.filter(pa.array(whole)).to_pylist()), "<u4").astype(np.int64)
        ends = np.append(0, np.cumsum(np.where(whole, n // 4, 0))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(words), mask=pa.array(~whole))

    shipped(SparkSession.active())
    words, n = F.arrow_udf(run, "array<bigint>")(payload), len(names)
    more = F.when(F.size(words) > n, F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))))
    return {name: F.get(words, F.lit(i)) for i, name in enumerate(names)} | {"extra": more}


def saturation(payload: Column) -> dict[str, Column]:
    """A run of clipped samples (class 0x40, id 0x0E, 8 bytes)."""
    m = unpacked(payload, 8, first_seq=(0, "<u2"), last_seq=(2, "<u2"), samples=(4, "<u2"), mask=(6, "u1"), flags=(7, "u1"))
    return {"first_seq": m["first_seq"], "last_seq": m["last_seq"], "samples": m["samples"], "mask": m["mask"], "axes": axes(m["mask"]), "flags": m["flags"], "dropped_before": bit(m["flags"], 0)}


def solution(payload: Column) -> dict[str, Column]:
    """The device's navigation solution (class 0x40, id 0x0F, 120 bytes); null where the value's bit is not set."""
    at = iter(range(16, 96, 4))
    names = ("roll", "pitch", "yaw", "roll_sigma", "pitch_sigma", "yaw_sigma", "vn", "ve", "vd", "pn", "pe", "pd", "height", "height_ell", "baro_alt", "baro_meas", "vz", "arm_f", "arm_r", "arm_d")
    numbers = {n: (next(at), "<f4") for n in names} | {"lat_deg": (96, "<f8"), "lon_deg": (104, "<f8"), "mag_ref_ut": (112, "<f4"), "mag_decl_deg": (116, "<f4")}
    m = unpacked(payload, 120, **{n: (k, "u1") for k, n in enumerate(("version", "mode", "att_src", "cal_applied", "sat_axes", "cpu_pct"))}, imu_hz=(6, "<u2"), flags=(8, "<u4"), update_wcet_us=(12, "<u4"), **numbers)
    flags = m["flags"]
    on = lambda name: bit(flags, FLAGS.index(name))
    reals = {n: m[n] for n in names}
    flag = {"roll": "rpy", "pitch": "rpy", "yaw": "rpy", "roll_sigma": "rpy_sigma", "pitch_sigma": "rpy_sigma", "yaw_sigma": "yaw_sigma", "vn": "vel", "ve": "vel", "vd": "vel", "pn": "pos", "pe": "pos", "pd": "pos"}
    named = lambda k, names: F.coalesce(F.get(F.array(*map(F.lit, names)), k.cast("int")), F.when(k.isNotNull(), "?"))
    out = {"version": m["version"], "mode": named(m["mode"], MODES), "att_src": named(m["att_src"], SOURCES), "cal_applied": m["cal_applied"], "sat_axes": axes(m["sat_axes"]), "cpu_pct": m["cpu_pct"], "imu_hz": m["imu_hz"], "flags": flags, "update_wcet_us": m["update_wcet_us"]}
    out |= {n: c if n.startswith("arm") else F.when(on(flag.get(n, n)), c) for n, c in reals.items()}
    out |= {n: F.when(on(bit_of), m[n]) for n, bit_of in (("lat_deg", "latlon"), ("lon_deg", "latlon"), ("mag_ref_ut", "mag_ref"), ("mag_decl_deg", "mag_ref"))}
    return out | {n: on(n) for n in ("ready", "leverarm", "leverarm_bad", "zupt", "zaru", "vzupt")}


def imu_status(status: Column) -> tuple[Column, Column]:
    """Temperature count (11 bits, signed) and the flags above."""
    low = status.bitwiseAND(0x7FF)
    return F.when(low >= 1024, low - 2048).otherwise(low), F.shiftright(status, 11)


def imu_sample(payload: Column) -> dict[str, Column]:
    """An inertial sample (class 0x40, id 0x01, 38 bytes), in m/s2 and rad/s."""
    numbers = {f"{n}_{a}": (8 + 4 * (3 * i + k), "<f4") for i, n in enumerate(("acc", "gyr")) for k, a in enumerate("xyz")}
    m = unpacked(payload, 38, t_us=(0, "<i8"), **numbers, status=(32, "<u4"), seq16=(36, "<u2"))
    temperature, flags = imu_status(m["status"])
    out = {"t_us": m["t_us"]} | {n: m[n] * (9.80665 if n.startswith("acc") else 0.017453292519943295) for n in numbers}
    return out | {"status_temp": temperature, "status_flags": flags, "seq16": m["seq16"]}


def mag_sample(payload: Column) -> dict[str, Column]:
    """A magnetometer sample (class 0x40, id 0x06, 24 bytes), in uT and degrees Celsius."""
    m = unpacked(payload, 24, t_us=(0, "<i8"), mag_x=(8, "<f4"), mag_y=(12, "<f4"), mag_z=(16, "<f4"), temp_c=(20, "<f4"))
    return {n: m[n] for n in ("t_us", "mag_x", "mag_y", "mag_z", "temp_c")}


#: Bytes of a value by bits 28 to 30 of its key; -1: the bytes stand before it.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: -1}


def items_of(payload: bytes) -> list[tuple[int, bytes]] | None:
    """Keys and values from the fifth byte on; None where the payload is malformed."""
    at, n, out = 4, len(payload), []
    while at < n:
        key = int.from_bytes(payload[at : at + 4], "little")
        # A kind that is not in the table has its width before the value, too.
        width, head = WIDTHS.get(key >> 28 & 7, -1), 4
        if width < 0:
            width, head = int.from_bytes(payload[at + 4 : at + 6], "little"), 6
        if at + head > n or at + head + width > n:
            return None
        out.append((key, payload[at + head : at + head + width]))
        at += head + width
    return out


def value_items(payload: Column) -> dict[str, Column]:
    """Items of keys and values (class 0x40, id 0x0A): layer, more, and items, an array of key and value; null items where the payload is malformed.

    A walk over each payload: a key of 4 bytes, from it or from 2 bytes more the width, and the value.
    """

    def run(batch: pa.Array) -> pa.Array:
        rows = [None if x is None or len(x) < 4 else items_of(x) for x in batch.to_pylist()]
        flat = [item for row in rows if row for item in row]
        ends = np.append(0, np.cumsum([len(row) if row else 0 for row in rows])).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array([key for key, _ in flat], pa.int64()), pa.array([value for _, value in flat], pa.binary())], ["key", "value"])
        return pa.ListArray.from_arrays(pa.array(ends), each, mask=pa.array([row is None for row in rows]))

    shipped(SparkSession.active())
    whole = F.length(payload) >= 4
    items = F.arrow_udf(run, "array<struct<key: bigint, value: binary>>")(payload)
    return {"layer": F.when(whole, field(payload, 1, 1)), "more": F.when(whole, field(payload, 2, 1) > 0), "items": items}


def datagrams(frames: list[bytes], most: int = 1400) -> list[bytes]:
    """Frames packed one after another into datagrams of at most `most` bytes."""
    out: list[bytes] = []
    for f in frames:
        if out and len(out[-1]) + len(f) <= most:
            out[-1] += f
        else:
            out.append(f)
    return out
