"""Recordings as streams: schemas, text readers, and the events table as a stream.

A stream has recording_id, t_us (microseconds on the device's clock, may be
negative) and seq (order in the file), then its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COV = ["nn", "ne", "nd", "ee", "ed", "dd"]
#: The columns of each stream's file, in order; L, D and I are long, double and integer.
COLUMNS = {
    "imu": "t_us:L gyr_x:D gyr_y:D gyr_z:D acc_x:D acc_y:D acc_z:D temp_c:D",
    "gnss": "t_us:L lat_deg:D lon_deg:D h_m:D " + " ".join(f"p_{c}:D" for c in _COV) + " vn:D ve:D vd:D " + " ".join(f"v_{c}:D" for c in _COV) + " vel_ok:I quality:I gps_week:I gps_tow_s:D num_sv:I jamming:I spoofing:I sig_auth:I nav_auth:I",
    "mag": "t_us:L mag_x:D mag_y:D mag_z:D",
    "baro": "t_us:L pressure_pa:D",
    "speed": "t_us:L speed_mps:D",
    "heading": "t_us:L heading_deg:D stddev_deg:D carr_soln:I length_m:D itow_ms:L",
    "ranges": "t_us:L anchor_id:I anchor_x:D anchor_y:D anchor_z:D range_m:D stddev_m:D",
    "ref": "t_us:L lat_deg:D lon_deg:D h_m:D roll_deg:D pitch_deg:D yaw_deg:D vn:D ve:D vd:D",
}
#: How many columns a row must have.
LEAST = {"imu": 7, "gnss": 20, "mag": 4, "baro": 2, "speed": 2, "heading": 4, "ranges": 7, "ref": 7}
TYPES = {"L": T.LongType(), "D": T.DoubleType(), "I": T.IntegerType()}


def schema(stream: str) -> T.StructType:
    return T.StructType([T.StructField(n, TYPES[k]) for n, k in (c.split(":") for c in COLUMNS[stream].split())])


def read_stream(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """Rows of a stream's files. Comments and rows that are short or malformed go; further columns are ignored.

    recording_id is the name of the file's folder. Heading and range rows out of their limits go, too.
    """
    fields = schema(stream).fields
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("seq"))
    parts = F.split("value", r"\s*,\s*")
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("__p", parts).where(F.size("__p") >= LEAST[stream])
    rows = rows.select(F.element_at(F.split("__f", "/"), -2).alias("recording_id"), "seq", *(F.get("__p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))
    need = [f.name for f in fields[: LEAST[stream]]]
    for c in need:
        rows = rows.where(F.col(c).isNotNull())  # NaN stays, and becomes null below
    if stream == "gnss":  # what a row leaves out at its end is 0
        rows = rows.withColumns({f.name: F.coalesce(f.name, F.lit(0).cast(f.dataType)) for f in fields[LEAST[stream] :]})
    doubles = [f.name for f in fields if isinstance(f.dataType, T.DoubleType)]
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    if stream == "ranges":
        rows = rows.where((F.col("stddev_m") > 0) & (F.col("range_m") >= 0) & F.col("anchor_id").between(0, 65535))
    return rows


def read_timesync(spark: SparkSession, path: str) -> DataFrame:
    """Pulse pairs, by the names in the header."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    kinds = {"timesync_t_us": "long", "imu_t_us": "long", "gps_week": "int", "gps_tow_s": "double", "mcu_restarts": "int", "segment": "int"}
    out = df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in df.columns})
    return out.withColumn("flags", F.conv(F.regexp_replace("flags", "^0[xX]", ""), 16, 10).cast("int")) if "flags" in df.columns else out


#: Factors to SI by unit name.
UNITS = {"rad/s": 1.0, "deg/s": 0.017453292519943295, "dps": 0.017453292519943295, "m/s2": 1.0, "g": 9.80665, "mg": 0.00980665, "pa": 1.0, "hpa": 100.0, "mbar": 100.0, "kpa": 1000.0, "ut": 1.0, "nt": 0.001, "gauss": 100.0, "mgauss": 0.1, "s": 1e6, "ms": 1e3, "us": 1.0}


def read_mapped(spark: SparkSession, path: str, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """A text table with a header as a stream. mapping: column -> (name in the header, unit)."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    out = df.select(*((F.col(name).try_cast("double") * UNITS[unit.lower()]).alias(c) for c, (name, unit) in mapping.items()))
    return out.withColumn("t_us", F.bround("t_us").cast("long")) if "t_us" in mapping else out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as streams: a user is a recording, an event type a stream."""
    t = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("recording_id"), t.alias("t_us"), F.col("event_id").alias("seq"), F.col("event_type").alias("stream"), "value")
