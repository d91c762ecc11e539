"""Solutions as text: the reference layout with sigmas, position files, tracks. Each is a column or a frame to write with spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.covariance import enu_roots
from driftline.sources.streams import schema

#: Columns of a solution file, in order.
SOLUTION = ["t_us", "lat_deg", "lon_deg", "h_m", "roll_deg", "pitch_deg", "yaw_deg", "vn", "ve", "vd", "sd_n", "sd_e", "sd_d", "sd_vn", "sd_ve", "sd_vd", "sd_roll", "sd_pitch", "sd_yaw"]


def write_solution(df: DataFrame, path: str) -> None:
    """A folder of text files for each recording; nulls and NaN are empty."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k == "double"})
    clean.select("recording_id", *(c for c in SOLUTION if c in df.columns)).write.partitionBy("recording_id").mode("overwrite").csv(path)


def gps_time(seconds: Column) -> Column:
    """GPS seconds as yyyy/mm/dd hh:mm:ss.sss, without leap seconds."""
    ms = F.bround(seconds * 1000).cast("long")
    at = F.timestamp_millis(ms + 315964800000)
    return F.concat(F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(at, F.current_timezone()), F.current_timezone()), "yyyy/MM/dd HH:mm:ss"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def position_line(gps_s: Column, lat_deg: Column, lon_deg: Column, h: Column, quality: Column, ns: Column, cov: tuple[Column, ...], age: Column) -> Column:
    """A line of a position file: time, position, quality, satellites, sigmas and signed roots, age."""
    e, n, u, en, nu, ue = enu_roots(cov)
    return F.format_string("%s %14.9f %14.9f %10.4f %3d %3d %8.4f %8.4f %8.4f %8.4f %8.4f %8.4f %6.2f %6.1f", gps_time(gps_s), lat_deg, lon_deg, h, quality, ns, n, e, u, en, ue, nu, age, F.lit(0.0))


def write_stream(df: DataFrame, path: str, stream: str) -> None:
    """A folder of text files for each recording, with the stream's columns in order; what is null is NaN, columns that df lacks are 0 or, at the end, left out.

    `streams.read_stream` reads them again.
    """
    fields = schema(stream).fields
    last = max(i for i, f in enumerate(fields) if f.name in df.columns)
    kept = [(F.col(f.name) if f.name in df.columns else F.lit(0)).cast(f.dataType).cast("string") for f in fields[: last + 1]]
    line = F.concat_ws(",", *(F.coalesce(c, F.lit("NaN")) for c in kept))
    rows = df.select("recording_id", "t_us", "seq", line.alias("line")).repartition("recording_id").sortWithinPartitions("recording_id", "t_us", "seq")
    rows.select("recording_id", "line").write.partitionBy("recording_id").mode("overwrite").text(path)


def track_lines(df: DataFrame, timed: bool = False) -> DataFrame:
    """recording_id, part, t_us, seq, line: each recording's positions as the lines of a map file, in the order of part, t_us and seq.

    timed: with the time of each point, as a track; else one line of coordinates. A row stays a row: nothing is gathered.
    """
    point = F.format_string("%.8f,%.8f,%.3f" if not timed else "<gx:coord>%.8f %.8f %.3f</gx:coord>", F.col("lon_deg"), F.col("lat_deg"), F.col("h_m"))
    open_, close = ("<gx:Track><altitudeMode>absolute</altitudeMode>", "</gx:Track>") if timed else ("<LineString><altitudeMode>absolute</altitudeMode><coordinates>", "</coordinates></LineString>")
    ends = df.select("recording_id").distinct()
    text = lambda part, line: ends.select("recording_id", F.lit(part).alias("part"), F.lit(None).cast("long").alias("t_us"), F.lit(None).cast("long").alias("seq"), F.lit(line).alias("line"))
    own = lambda part, line: df.select("recording_id", F.lit(part).alias("part"), "t_us", F.col("seq").cast("long").alias("seq"), line.alias("line"))
    at = F.timestamp_micros("t_us")
    when = F.concat(F.lit("<when>"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z</when>"))
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><Placemark>'
    out = text(0, head + open_).unionByName(own(2, point)).unionByName(text(3, close + "</Placemark></Document></kml>"))
    return out.unionByName(own(1, when)) if timed else out


def write_track(df: DataFrame, path: str, timed: bool = False) -> None:
    """A map file for each recording, in a folder of its own."""
    rows = track_lines(df, timed).repartition("recording_id").sortWithinPartitions("recording_id", "part", "t_us", "seq")
    rows.select("recording_id", "line").write.partitionBy("recording_id").mode("overwrite").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """json: each row without its null, NaN and infinite leaves."""
    clean = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c, k in df.dtypes if k in ("double", "float")})
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "true"}).alias("json"))
