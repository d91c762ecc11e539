"""Findings on a recording from its metrics: groups of rules, the first of which that holds speaks for its group.

Metrics are columns of a table with one row for each recording. A metric that is
null (or a column that is not there) was not measured: rules that need it are silent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, INFO, WARN, CRIT = 0, 1, 2, 3
#: (rule, severity, condition over the metrics), by group. Limits are fixed values.
GROUPS: tuple[tuple[tuple[str, int, str], ...], ...] = (
    (("imu_late_start", WARN, "imu_max_gap >= 0.5 AND imu_max_gap_at - imu_max_gap < 2"), ("imu_dropout", WARN, "imu_max_gap >= 0.5"), ("imu_minor_dropout", INFO, "imu_max_gap >= 0.1"), ("imu_continuous", OK, "imu_max_gap >= 0")),
    (("imu_rate_varies", WARN, "imu_rate_spread > 0.25"), ("imu_rate_wobbles", INFO, "imu_rate_spread > 0.05")),
    (("gnss_few_fixes", INFO, "gnss_n < 2 AND aiding_mode = 'gnss'"), ("gnss_outage", CRIT, "gnss_n >= 2 AND gnss_max_gap >= 10"), ("gnss_gap", WARN, "gnss_n >= 2 AND gnss_max_gap >= 2"), ("gnss_coverage", OK, "gnss_n >= 2 AND gnss_max_gap >= 0")),
    (("latency_implausible", WARN, "NOT latency_ms BETWEEN -50 AND 2000"), ("delay_below_latency", WARN, "delay_ms + 20 < latency_ms"), ("latency_covered", OK, "delay_ms IS NOT NULL AND latency_ms IS NOT NULL")),
    (("satellites", INFO, "satellites > 0"),),
    (("jamming", WARN, "jamming_bad > 0"), ("no_jamming", OK, "jamming_bad = 0")),
    (("spoofing", WARN, "spoofing_bad > 0"), ("no_spoofing", OK, "spoofing_bad = 0")),
    (("signal_authentication_failed", WARN, "sig_auth_failed > 0"), ("signal_authentication", INFO, "sig_auth_failed = 0")),
    (("message_authentication_failed", WARN, "nav_auth_failed > 0"), ("message_authentication", INFO, "nav_auth_failed = 0")),
    (("gyro_band_limited", INFO, "gyr_noise_ratio IS NOT NULL AND gyr_band_limited"), ("gyro_noise_optimistic", WARN, "gyr_noise_ratio > 100"), ("gyro_noise_conservative", OK, "gyr_noise_ratio < 1"), ("gyro_noise", OK, "gyr_noise_ratio >= 1")),
    (("accel_band_limited", INFO, "acc_noise_ratio IS NOT NULL AND acc_band_limited"), ("accel_noise_optimistic", WARN, "acc_noise_ratio > 100"), ("accel_noise_conservative", OK, "acc_noise_ratio < 1"), ("accel_noise", OK, "acc_noise_ratio >= 1")),
    (
        ("accel_unit", WARN, "abs(1 + gravity_dev - 9.80665) < 0.980665 OR abs((1 + gravity_dev) * 9.80665 - 1) < 0.1"), ("accel_scale", WARN, "abs(gravity_dev) > 0.02"),
        ("accel_slightly_off", INFO, "abs(gravity_dev) > 0.01"), ("accel_gravity", OK, "gravity_dev IS NOT NULL"),
    ),
    (("gnss_sigma_optimistic", WARN, "greatest(pos_hor_ratio, pos_ver_ratio, vel_hor_ratio, vel_ver_ratio) > 10"),),
    (("gnss_sigma_pessimistic", INFO, "least(pos_hor_ratio, pos_ver_ratio, vel_hor_ratio, vel_ver_ratio) < 0.1"),),
    (("gnss_sigma", OK, "greatest(pos_hor_ratio, pos_ver_ratio, vel_hor_ratio, vel_ver_ratio) <= 10 AND least(pos_hor_ratio, pos_ver_ratio, vel_hor_ratio, vel_ver_ratio) >= 0.1"),),
    (("gnss_sigma_unchecked", INFO, "aiding_mode = 'gnss' AND pos_hor_ratio IS NULL AND pos_ver_ratio IS NULL AND vel_hor_ratio IS NULL AND vel_ver_ratio IS NULL"),),
    (("gnss_velocity_weak", WARN, "gnss_hor_mps > CASE WHEN gnss_max_hor_mps > 0 THEN least(0.5, gnss_max_hor_mps) ELSE 0.5 END"), ("gnss_velocity", OK, "gnss_hor_mps IS NOT NULL")),
    (("baro_optimistic", WARN, "baro_ratio > 1.3"), ("baro_pessimistic", INFO, "baro_ratio < 0.77"), ("baro_sigma", OK, "baro_ratio IS NOT NULL")),
    (("mag_optimistic", WARN, "mag_ratio > 1.3"), ("mag_pessimistic", INFO, "mag_ratio < 0.77"), ("mag_sigma", OK, "mag_ratio IS NOT NULL")),
    (("levelling_uncertain", WARN, "roll_exceeded + pitch_exceeded > 0"),),
    (("yaw_uncertain", WARN, "yaw_exceeded > 0"),),
    (("position_uncertain", WARN, "pos_exceeded > 0"),),
    (("uncertainty_bounded", OK, "roll_exceeded + pitch_exceeded + yaw_exceeded + pos_exceeded = 0"),),
    (("covariance_collapse", CRIT, "overconfident"),),
    (("fusion_failures", WARN, "fuse_failures > 0"),),
    (("fixes_rejected", WARN, "fixes_rejected / nullif(fixes_seen, 0) > 0.2"), ("fixes_skipped", INFO, "(fixes_seen - fixes_used - fixes_rejected) / nullif(fixes_seen, 0) > 0.2")),
    (("lever_arm_unset", WARN, "fixes_seen > 0 AND lever_arms = 'score_unset'"), ("lever_arms_differ", INFO, "fixes_seen > 0 AND lever_arms = 'differ'")),
    (("baro_height_drift", WARN, "fixes_seen > 0 AND baro_offset_span >= 10"), ("baro_height", OK, "fixes_seen > 0 AND baro_offset_span >= 0")),
    (("downweighted", INFO, "fixes_seen > 0 AND fixes_used > 0 AND downweighted / nullif(fixes_used, 0) > 0.15"),),
)
#: All metrics that rules read, with their types.
METRICS = {
    **dict.fromkeys(
        (
            "imu_max_gap", "imu_max_gap_at", "imu_rate_spread", "gnss_max_gap", "latency_ms", "delay_ms", "gyr_noise_ratio", "acc_noise_ratio", "gravity_dev", "pos_hor_ratio", "pos_ver_ratio",
            "vel_hor_ratio", "vel_ver_ratio", "gnss_hor_mps", "gnss_max_hor_mps", "baro_ratio", "mag_ratio", "baro_offset_span", "imu_hz", "satellites",
        ),
        "double",
    ),
    **dict.fromkeys(
        (
            "gnss_n", "jamming_bad", "spoofing_bad", "sig_auth_failed", "nav_auth_failed", "roll_exceeded", "pitch_exceeded", "yaw_exceeded", "pos_exceeded", "fuse_failures", "fixes_seen", "fixes_used",
            "fixes_rejected", "downweighted", "least_satellites",
        ),
        "long",
    ),
    **dict.fromkeys(("gyr_band_limited", "acc_band_limited", "overconfident"), "boolean"),
    "lever_arms": "string", "aiding_mode": "string",
}


#: What a rule says, with the metrics that go into it; rules that are not here say their name.
TEXTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "imu_late_start": ("samples begin in earnest at %.0f s, after a gap of %.0f ms", ("imu_max_gap_at", "imu_max_gap * 1000")), "imu_dropout": ("no sample for %.0f ms, up to %.0f s: nothing is predicted across it", ("imu_max_gap * 1000", "imu_max_gap_at")),
    "imu_minor_dropout": ("samples %.0f ms apart at %.0f s", ("imu_max_gap * 1000", "imu_max_gap_at")), "imu_continuous": ("samples at %.0f Hz without a gap over %.0f ms", ("imu_hz", "imu_max_gap * 1000")),
    "imu_rate_varies": ("the rate of samples varies by %.0f %% of its median", ("imu_rate_spread * 100",)), "imu_rate_wobbles": ("the rate of samples wobbles by %.0f %% of its median", ("imu_rate_spread * 100",)),
    "gnss_few_fixes": ("%d fixes: too few to tell how well they cover the recording", ("gnss_n",)), "gnss_outage": ("no fix for %.0f s", ("gnss_max_gap",)), "gnss_gap": ("fixes up to %.1f s apart", ("gnss_max_gap",)), "gnss_coverage": ("%d fixes, at most %.1f s apart", ("gnss_n", "gnss_max_gap")),
    "latency_implausible": ("fixes arrive %.0f ms after their time: the clocks do not belong together", ("latency_ms",)), "delay_below_latency": ("fixes arrive %.0f ms after their time, but count as %.0f ms old", ("latency_ms", "delay_ms")),
    "latency_covered": ("fixes arrive %.0f ms after their time and count as %.0f ms old", ("latency_ms", "delay_ms")), "satellites": ("%.0f satellites in the median, %d at least", ("satellites", "least_satellites")),
    "jamming": ("the receiver tells of jamming at %d fixes", ("jamming_bad",)), "spoofing": ("the receiver tells of spoofing at %d fixes", ("spoofing_bad",)),
    "signal_authentication_failed": ("%d fixes with signals that are not authentic", ("sig_auth_failed",)), "message_authentication_failed": ("%d fixes with messages that are not authentic", ("nav_auth_failed",)),
    "gyro_noise_optimistic": ("the gyros are %.0f times as noisy as set", ("gyr_noise_ratio",)), "accel_noise_optimistic": ("the accelerometers are %.0f times as noisy as set", ("acc_noise_ratio",)),
    "gyro_noise": ("the gyros are %.2f times as noisy as set", ("gyr_noise_ratio",)), "accel_noise": ("the accelerometers are %.2f times as noisy as set", ("acc_noise_ratio",)),
    "gyro_noise_conservative": ("the gyros are %.2f times as noisy as set", ("gyr_noise_ratio",)), "accel_noise_conservative": ("the accelerometers are %.2f times as noisy as set", ("acc_noise_ratio",)),
    "accel_unit": ("at rest the force is %.2f times gravity: its unit is another one", ("1 + gravity_dev",)), "accel_scale": ("at rest the force is off gravity by %.1f %%: scale or offset", ("gravity_dev * 100",)),
    "accel_slightly_off": ("at rest the force is off gravity by %.1f %%", ("gravity_dev * 100",)), "accel_gravity": ("at rest the force is gravity within %.1f %%", ("abs(gravity_dev) * 100",)),
    "gnss_sigma_optimistic": ("fixes at rest scatter up to %.1f times their sigmas", ("greatest(pos_hor_ratio, pos_ver_ratio, vel_hor_ratio, vel_ver_ratio)",)), "gnss_sigma_unchecked": ("sigmas of fixes were not checked: no rest", ()),
    "gnss_velocity_weak": ("velocities with a sigma of %.2f m/s", ("gnss_hor_mps",)), "baro_optimistic": ("pressure scatters %.1f times its sigma", ("baro_ratio",)), "mag_optimistic": ("the field scatters %.1f times its sigma", ("mag_ratio",)),
    "fixes_rejected": ("%d of %d fixes were rejected", ("fixes_rejected", "fixes_seen")), "baro_height_drift": ("the height by pressure moved %.0f m against that of fixes", ("baro_offset_span",)),
}


def told(metrics: DataFrame, by: list[str]) -> DataFrame:
    """by, severity, rule, text of all findings; for lines, order by severity (falling) and rule. One pass over the metrics, without a join."""
    rule = F.col("__f.rule")
    text = F.translate(rule, "_", " ")
    for name, (pattern, values) in TEXTS.items():
        text = F.when(rule == name, F.format_string(pattern, *map(F.expr, values)) if values else F.lit(pattern)).otherwise(text)
    return _found(metrics, GROUPS).select(*by, "__f.severity", "__f.rule", text.alias("text"))


def report(metrics: DataFrame, by: list[str], groups: tuple[tuple[tuple[str, int, str], ...], ...] = GROUPS) -> DataFrame:
    """by, rule, severity: for each group the first rule whose condition holds. One pass over the metrics, without a shuffle."""
    return _found(metrics, groups).select(*by, "__f.rule", "__f.severity")


def _found(metrics: DataFrame, groups: tuple[tuple[tuple[str, int, str], ...], ...]) -> DataFrame:
    """All metrics with __f, rule and severity: a row for each finding."""
    full = metrics.withColumns({c: F.lit(None).cast(t) for c, t in METRICS.items() if c not in metrics.columns})
    each = []
    for group in groups:
        found = F.lit(None).cast("struct<rule: string, severity: int>")
        for rule, severity, condition in reversed(group):
            found = F.when(F.expr(condition), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))).otherwise(found)
        each.append(found)
    return full.select("*", F.explode(F.array_compact(F.array(*each))).alias("__f"))


def summary(findings: DataFrame, by: list[str]) -> DataFrame:
    """How many findings are critical, warnings and information, and the worst severity."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return findings.groupBy(*by).agg(n(CRIT).alias("critical"), n(WARN).alias("warnings"), n(INFO).alias("information"), F.max("severity").alias("worst"))
