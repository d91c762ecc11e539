"""How a sensor sits in its housing, from faces it was laid on, and how two triads sit to each other, from the dip of the field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.calibration import shortest_rotation
from driftline.operators.filters import Attitude
from driftline.shipping import shipped

#: What a rest on each face reads, as a direction.
FACES = {"bottom": (0.0, 0.0, -1.0), "left": (0.0, 1.0, 0.0), "right": (0.0, -1.0, 0.0), "nose": (-1.0, 0.0, 0.0), "tail": (1.0, 0.0, 0.0), "top": (0.0, 0.0, 1.0)}
ACC, MAG = ("acc_x", "acc_y", "acc_z"), ("mag_x", "mag_y", "mag_z")
#: Poses that the dip needs at least.
LEAST_POSES = 5


def angles(r: np.ndarray) -> list[float]:
    """Roll, pitch and yaw in degrees."""
    return np.degrees([np.arctan2(r[2, 1], r[2, 2]), np.arcsin(np.clip(-r[2, 0], -1, 1)), np.arctan2(r[1, 0], r[0, 0])]).tolist()


def turn_deg(r: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))))


def unit(v: tuple[str, ...]) -> list[Column]:
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in v), F.lit(0.0)))
    return [F.col(c) / n for c in v]


def nearest_face(acc: tuple[str, str, str] = ACC) -> tuple[Column, Column]:
    """The face that explains a reading best, and the angle to it in degrees."""
    u = unit(acc)
    dots = F.array(*(F.struct(sum((a * b for a, b in zip(u, f, strict=True)), F.lit(0.0)).alias("c"), F.lit(name).alias("face")) for name, f in FACES.items()))
    best = F.array_max(dots)
    return best["face"], F.degrees(F.acos(F.greatest(F.least(best["c"], F.lit(1.0)), F.lit(-1.0))))


def housing_rotations(rests: DataFrame) -> DataFrame:
    """recording_id, placements, matrix (nine numbers by rows), roll_deg, pitch_deg, yaw_deg, angle_deg, tilt_only, residual_deg.

    rests: recording_id, face (of FACES) and ACC, the mean reading of each rest. Sums of products of measured and ideal directions
    are all that goes on from the rows; each recording's rotation is solved from its nine. Where all faces are parallel only the tilt
    is known (tilt_only): the smallest rotation. residual_deg: the worst angle left. Faces of other names are left out.
    """
    shipped(rests.sparkSession)
    u = unit(ACC)
    ideal = [F.element_at(F.create_map(*(x for name, f in FACES.items() for x in (F.lit(name), F.lit(f[k])))), F.col("face")) for k in range(3)]
    rows = rests.where(F.col("face").isin(*FACES)).select("recording_id", *(c.alias(f"u{k}") for k, c in enumerate(u)), *(c.alias(f"v{k}") for k, c in enumerate(ideal)))
    sums = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("placements"), *(F.sum(F.col(f"v{i}") * F.col(f"u{j}")).alias(f"b{i}{j}") for i in range(3) for j in range(3)), *(F.sum(F.abs(f"v{i}")).alias(f"a{i}") for i in range(3)))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                b = np.array([[r[f"b{i}{j}"] for j in range(3)] for i in range(3)])
                axes = [i for i in range(3) if r[f"a{i}"] > 0]
                if len(axes) == 1:  # readings of opposite faces are folded together by the product
                    m = shortest_rotation(b[axes[0]], np.eye(3)[axes[0]])
                else:
                    p, _, q = np.linalg.svd(b)
                    m = p @ np.diag([1, 1, np.sign(np.linalg.det(p @ q))]) @ q
                out.append((r["recording_id"], r["placements"], m.ravel(), *angles(m), turn_deg(m), len(axes) == 1))
            yield pd.DataFrame(out, columns=["recording_id", "placements", "matrix", "roll_deg", "pitch_deg", "yaw_deg", "angle_deg", "tilt_only"])

    kind = rests.schema["recording_id"].dataType.simpleString()
    solved = sums.mapInPandas(solve, f"recording_id {kind}, placements long, matrix array<double>, roll_deg double, pitch_deg double, yaw_deg double, angle_deg double, tilt_only boolean")
    back = rows.join(solved.select("recording_id", "matrix"), "recording_id")
    cos = sum((F.col(f"v{i}") * F.col(f"u{j}") * F.get("matrix", F.lit(3 * i + j)) for i in range(3) for j in range(3)), F.lit(0.0))
    left = back.groupBy("recording_id").agg(F.max(F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))).alias("residual_deg"))
    return solved.join(left, "recording_id")


def dip_rotation(acc: np.ndarray, mag: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """The rotation that takes mag to acc's axes so that the angle between them is the same in all poses, and how well the poses tell (least singular value a pose).

    Alternates between the common angle and a linear step of the rotation with that angle taken out.
    """
    a, m = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (acc, mag))
    r, least = np.eye(3), 0.0
    for _ in range(rounds):
        v = m @ r.T
        off, slope = (v * a).sum(1), np.cross(v, a)
        off, slope = off - off.mean(), slope - slope.mean(0)
        step, _, _, sv = np.linalg.lstsq(slope, -off, rcond=None)
        least = float(sv[-1])
        size = float(np.linalg.norm(step))
        w, x, y, z = Attitude.exponential(step)
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]) @ r
        if size < 1e-13:
            break
    return r, least / len(a) ** 0.5


def dip_alignments(poses: DataFrame) -> DataFrame:
    """recording_id, poses, matrix, roll_deg, pitch_deg, yaw_deg, angle_deg, dip_deg, scatter_before_deg, scatter_after_deg, observability.

    poses: recording_id and the means ACC and MAG of each pose at rest. Recordings of fewer than LEAST_POSES poses have no row.
    """
    names = ["recording_id", "poses", "matrix", "roll_deg", "pitch_deg", "yaw_deg", "angle_deg", "dip_deg", "scatter_before_deg", "scatter_after_deg", "observability"]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < LEAST_POSES:
            return pd.DataFrame(columns=names)
        a, m = frame[list(ACC)].to_numpy(float), frame[list(MAG)].to_numpy(float)
        r, seen = dip_rotation(a, m)
        angle = lambda m: np.degrees(np.arccos(np.clip((m * a).sum(1) / np.linalg.norm(m, axis=1) / np.linalg.norm(a, axis=1), -1, 1)))
        before, after = angle(m), angle(m @ r.T)
        return pd.DataFrame([[frame["recording_id"].iloc[0], len(a), r.ravel(), *angles(r), turn_deg(r), float(after.mean()) - 90.0, float(before.std()), float(after.std()), seen]], columns=names)

    shipped(poses.sparkSession)
    kind = poses.schema["recording_id"].dataType.simpleString()
    return poses.select("recording_id", *ACC, *MAG).groupBy("recording_id").applyInPandas(solve, f"recording_id {kind}, poses int, matrix array<double>, " + ", ".join(f"{n} double" for n in names[3:]))
