"""A dataset as one source: a folder for each recording with its streams and its settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.streams import COLUMNS, read_stream

#: The file of each stream, and settings that a folder may leave out.
FILES = {s: f"{s}.csv" for s in COLUMNS}
DEFAULTS = {
    "aiding": "gnss", "init": "auto", "gnss": {"delay_ms": 0.0, "leverarm_frd": [0.0, 0.0, 0.0], "pos_stddev_fallback_m": [5.0, 10.0], "vel_stddev_fallback_mps": 0.5},
    "speed": {"enable": 0, "scale": 1.0, "stddev_mps": 0.1}, "score": {"warmup_sec": 0.0, "ref_delay_ms": 0.0, "leverarm_frd": [0.0, 0.0, 0.0]},
}


def settings(spark: SparkSession, folder: str) -> dict:
    """config.yaml of a folder over the defaults; sections are merged, others kept as they are. Needs a YAML reader."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading config.yaml needs the yaml module") from e
    text = "\n".join(r["value"] for r in spark.read.text(f"{folder}/config.yaml").collect())  # a page of text
    own = yaml.safe_load(text) or {}
    if not isinstance(own, dict):
        raise ValueError(f"{folder}/config.yaml: sections are expected")
    return {k: {**DEFAULTS[k], **(own.get(k) or {})} if isinstance(DEFAULTS.get(k), dict) else own.get(k, DEFAULTS.get(k)) for k in {**DEFAULTS, **own}}


def limits(config: dict, recording_id: str) -> list[tuple[str, str, float]]:
    """(recording_id, metric, limit) of a configuration's limits, as scoring.judged takes them."""
    found = {**config, **(config.get("score") or {})}
    return sorted((recording_id, k.removeprefix("lim_"), float(v)) for k, v in found.items() if k.startswith("lim_"))


def available(spark: SparkSession, root: str) -> set[str]:
    """Streams of which a folder of the dataset has a file."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return {s for s, f in FILES.items() if fs.globStatus(paths(f"{root}/*/{f}"))}


def read_recordings(spark: SparkSession, root: str, outages: list[tuple[float, float]] = (), config: dict | None = None) -> dict[str, DataFrame]:
    """Stream -> rows of all folders below root, as the filters take them.

    The truth moves to its time of validity (score.ref_delay_ms), fixes in the outages (start and length in seconds from each
    recording's first inertial sample) go, fixes and speeds get the age of the settings (age_us), variances that are not
    positive become the fallback's, speeds are scaled. Streams that no folder has are left out; without inertial samples it is an error.
    """
    config, there = config or DEFAULTS, available(spark, root)
    if "imu" not in there:
        raise ValueError(f"no inertial samples below {root}")
    out = {s: read_stream(spark, f"{root}/*/{FILES[s]}", s) for s in sorted(there)}
    if "ref" in out:
        out["ref"] = out["ref"].withColumn("t_us", F.col("t_us") - int(config["score"]["ref_delay_ms"] * 1000))
    start = out["imu"].groupBy("recording_id").agg(F.min("t_us").alias("imu0"))
    if "gnss" in out:
        fixes = out["gnss"]
        if outages:
            s = (F.col("t_us") - F.col("imu0")) / 1e6
            fixes = fixes.join(start, "recording_id", "left")
            for lo, length in outages:
                fixes = fixes.where(F.col("imu0").isNull() | ~((s >= lo) & (s < lo + length)))
            fixes = fixes.drop("imu0")
        hor, ver = (x**2 for x in config["gnss"]["pos_stddev_fallback_m"])
        vel = config["gnss"]["vel_stddev_fallback_mps"] ** 2
        none = lambda names: F.greatest(*(F.abs(c) for c in names)) == 0
        for p, own in (("p", {"nn": hor, "ee": hor, "dd": ver}), ("v", {"nn": vel, "ee": vel, "dd": vel})):
            empty = none([f"{p}_{c}" for c in ("nn", "ee", "dd")])
            fixes = fixes.withColumns({f"{p}_{c}": F.when(empty, F.lit(float(x))).otherwise(F.col(f"{p}_{c}")) for c, x in own.items()})
        out["gnss"] = fixes.withColumn("age_us", F.lit(int(config["gnss"]["delay_ms"] * 1000)))
    if "speed" in out:
        out["speed"] = out["speed"].withColumns({"speed_mps": F.col("speed_mps") * float(config["speed"]["scale"]), "age_us": F.lit(int(float(config["speed"].get("delay_ms", 0.0)) * 1000))})
    return out
