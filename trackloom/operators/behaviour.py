"""Behaviour from 3-D poses: features, head angles, saccades, rigidity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.operators.ensemble import seed_medians
from trackloom.operators.joins import event_windows, near
from trackloom.operators.ordered import neighbours, percentiles, running_total
from trackloom.operators.tracks import gradient, pivot_points, velocity
from trackloom.session import lookup, many_rows, materialised, together

# Names and order of the eleven pose features.
FEATURES = ("pawL_vx", "pawL_vy", "pawL_vz", "pawR_vx", "pawR_vy", "pawR_vz", "pawL_speed", "pawR_speed",
            "pawL_acc_mag", "pawR_acc_mag", "paw_dist")
# Keypoint pairs that keep their distance on a rigid head.
RIGID_PAIRS = (("leftEye", "rightEye", "Eye-to-Eye"), ("topBeak", "botBeak", "Top-Bot Beak"),
               ("topBeak", "backHead", "Beak-BackHead"), ("leftEye", "topBeak", "LeftEye-Beak"),
               ("rightEye", "topBeak", "RightEye-Beak"), ("leftEye", "backHead", "LeftEye-BackHead"))
TRACE = ("model", "session")


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def wrap(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def circular_error(a: Column, b: Column) -> Column:
    """Absolute angular distance in degrees."""
    return F.abs(wrap(a - b))


# Features.

def pose_features(points: DataFrame, dt: float = 1 / 60, keys: Sequence[str] = TRACE) -> DataFrame:
    """The eleven paw features per frame: velocities, speeds, acceleration magnitudes and paw distance."""
    paws = ["pawL", "pawR"]
    wide = pivot_points(points, [*keys, "frame"], paws)
    axes = [f"{p}_{a}" for p in paws for a in "XYZ"]
    moved = velocity(wide, keys, axes, dt)
    moved = velocity(moved, keys, [f"v_{a}" for a in axes], dt, prefix="a_")

    def size(prefix: str, paw: str) -> Column:
        return norm(*[F.col(f"{prefix}{paw}_{a}") for a in "XYZ"])

    made = [F.col(f"v_{p}_{a}").alias(f"{p}_v{a.lower()}") for p in paws for a in "XYZ"]
    made += [size("v_", p).alias(f"{p}_speed") for p in paws] + [size("a_v_", p).alias(f"{p}_acc_mag") for p in paws]
    apart = norm(*[F.col(f"pawL_{a}") - F.col(f"pawR_{a}") for a in "XYZ"])
    return moved.select(*keys, "frame", *made, apart.alias("paw_dist"))


def egocentric(points: DataFrame, center: str, head: str, tail: str, keys: Sequence[str] = ("model", "session", "frame")
               ) -> DataFrame:
    """Poses centred on one keypoint and turned about z so that tail → head points along +X.

    A pose whose horizontal axis is shorter than 1e-8 is only centred.
    """
    w = Window.partitionBy(*keys)

    def at(name: str, axis: str) -> Column:
        return F.max(F.when(F.col("keypoint") == name, F.col(axis))).over(w)

    anchored = points.withColumns({f"_c{a}": at(center, a) for a in "XYZ"})
    anchored = anchored.withColumns({f"_f{a}": at(head, a) - at(tail, a) for a in "XY"})
    size = norm(F.col("_fX"), F.col("_fY"))
    cos, sin = F.col("_fX") / F.nullif(size, F.lit(0.0)), F.col("_fY") / F.nullif(size, F.lit(0.0))
    x, y = F.col("X") - F.col("_cX"), F.col("Y") - F.col("_cY")
    short = size < 1e-8
    out = anchored.withColumns({"_x": F.when(short, x).otherwise(cos * x + sin * y),
                                "_y": F.when(short, y).otherwise(cos * y - sin * x)})
    return out.withColumns({"X": F.col("_x"), "Y": F.col("_y"), "Z": F.col("Z") - F.col("_cZ")}).select(*points.columns)


# Head angles.

def head_vectors(points: DataFrame, keys: Sequence[str] = ("model", "session", "frame")) -> DataFrame:
    """Unit forward vector f (eye midpoint → beak midpoint) and lateral vector l (left → right eye) per frame."""
    wide = pivot_points(points, keys, ["topBeak", "botBeak", "leftEye", "rightEye"])

    def c(k: str, a: str) -> Column:
        return F.col(f"{k}_{a}")

    f = {a: (c("topBeak", a) + c("botBeak", a)) / 2 - (c("leftEye", a) + c("rightEye", a)) / 2 for a in "XYZ"}
    lat = {a: c("rightEye", a) - c("leftEye", a) for a in "XYZ"}
    raw = wide.select(*keys, *[f[a].alias(f"_f{a}") for a in "XYZ"], *[lat[a].alias(f"_l{a}") for a in "XYZ"])
    fn = norm(*[F.col(f"_f{a}") for a in "XYZ"]) + 1e-9
    ln = norm(*[F.col(f"_l{a}") for a in "XYZ"]) + 1e-9
    return raw.select(*keys, *[(F.col(f"_f{a}") / fn).alias(f"f{a.lower()}") for a in "XYZ"],
                      *[(F.col(f"_l{a}") / ln).alias(f"l{a.lower()}") for a in "XYZ"])


def angles(vectors: DataFrame, keys: Sequence[str] = ("model", "session", "frame")) -> DataFrame:
    """yaw, pitch, roll in degrees from forward and lateral vectors; roll is NULL when it is undefined."""
    fx, fy, fz = (F.col(c) for c in ("fx", "fy", "fz"))
    dot = F.col("lx") * fx + F.col("ly") * fy + F.col("lz") * fz
    base = vectors.withColumns({"_px": F.col("lx") - dot * fx, "_py": F.col("ly") - dot * fy, "_pz": F.col("lz") - dot * fz,
                                "_ux": -fz * fx, "_uy": -fz * fy, "_uz": 1 - fz * fz})
    p, u = [F.col(f"_p{a}") for a in "xyz"], [F.col(f"_u{a}") for a in "xyz"]
    pn, un = norm(*p), norm(*u)
    # right = forward x up, both up and the projected lateral vector scaled to length one
    right = [fy * u[2] - fz * u[1], fz * u[0] - fx * u[2], fx * u[1] - fy * u[0]]
    along = sum((p[i] * u[i] for i in (1, 2)), p[0] * u[0])
    across = sum((p[i] * right[i] for i in (1, 2)), p[0] * right[0])
    scale = F.nullif(pn * un, F.lit(0.0))
    roll = F.when((pn >= 1e-9) & (un >= 1e-9), F.degrees(F.atan2(along / scale, across / scale)))
    return base.select(*keys, wrap(F.degrees(F.atan2(fy, fx))).alias("yaw"),
                       F.when(fz.isNotNull(), F.degrees(F.asin(F.greatest(F.least(fz, F.lit(1.0)), F.lit(-1.0))))).alias("pitch"),
                       roll.alias("roll"))


def best_rotations(vectors: DataFrame, reference: str, on: Sequence[str] = ("session", "frame")) -> DataFrame:
    """Per model the rotation R (nine values, row by row) with R a ≈ b for its forward vectors a and the reference's b.

    Nine sums per model are aggregated; the 3 x 3 decompositions run on one row per model.
    """
    ref = vectors.where(F.col("model") == reference).select(*on, *[F.col(f"f{a}").alias(f"r{a}") for a in "xyz"])
    both = vectors.where(F.col("model") != reference).join(ref, list(on))
    sums = both.groupBy("model").agg(F.array(*[F.sum(F.col(f"f{a}") * F.col(f"r{b}")) for a in "xyz" for b in "xyz"])
                                     .alias("h"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.stack([np.asarray(v, dtype=float).reshape(3, 3) for v in pdf["h"]]) if len(pdf) else np.empty((0, 3, 3))
            u, _, vt = np.linalg.svd(h)
            turn = np.linalg.det(np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2))
            vt[:, 2, :] *= np.where(turn < 0, -1.0, 1.0)[:, None]
            r = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
            yield pd.DataFrame({"model": pdf["model"], "rotation": [m.ravel().tolist() for m in r]})

    return sums.mapInPandas(solve, "model string, rotation array<double>")


def align_to_reference(vectors: DataFrame, reference: str) -> DataFrame:
    """All forward and lateral vectors turned into the frame of the reference model."""
    turned = vectors.join(lookup(best_rotations(vectors, reference), "rotations"), "model", "left")

    def rotated(prefix: str, row: int) -> Column:
        parts = [F.col("rotation")[3 * row + j] * F.col(f"{prefix}{a}") for j, a in enumerate("xyz")]
        return F.when(F.col("rotation").isNull(), F.col(f"{prefix}{'xyz'[row]}")).otherwise(parts[0] + parts[1] + parts[2])

    made = [rotated(p, i).alias(f"{p}{a}") for p in "fl" for i, a in enumerate("xyz")]
    rest = [c for c in vectors.columns if c not in {f"{p}{a}" for p in "fl" for a in "xyz"}]
    return turned.select(*rest, *made)


def align_yaw(traces: DataFrame, reference: str, on: Sequence[str] = ("session", "frame"), value: str = "yaw") -> DataFrame:
    """Each model's yaw plus its mean wrapped offset to the reference model, wrapped again."""
    ref = traces.where(F.col("model") == reference).select(*on, F.col(value).alias("_ref"))
    offset = traces.join(ref, list(on)).groupBy("model").agg(F.avg(wrap(F.col("_ref") - F.col(value))).alias("_off"))
    offset = lookup(offset, "offsets")
    out = traces.join(offset, "model", "left")
    moved = F.when(F.col("model") == reference, F.col(value)).otherwise(wrap(F.col(value) + F.col("_off")))
    return out.withColumn(value, moved).select(*traces.columns)


def melt_angles(traces: DataFrame, names: Sequence[str] = ("yaw", "pitch", "roll"),
                keys: Sequence[str] = ("model", "session", "frame")) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("angle"), F.col(n).alias("value")) for n in names])
    return traces.select(*keys, F.explode(rows).alias("_a")).select(*keys, "_a.angle", "_a.value")


def angle_summary(traces: DataFrame, dt: float, names: Sequence[str] = ("yaw", "pitch", "roll")) -> DataFrame:
    """mean, population std, min, max and mean absolute velocity per model and angle."""
    long = gradient(melt_angles(traces, names), [*TRACE, "angle"], "value", dt, "velocity")
    speed = F.abs(F.when(F.col("value").isNotNull(), F.col("velocity")))
    return long.groupBy("model", "angle").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg(speed).alias("mean_speed"))


def angular_error(traces: DataFrame, truth: DataFrame, names: Sequence[str] = ("yaw", "pitch", "roll")) -> DataFrame:
    """Mean absolute circular error and number of valid frames per session, model and angle."""
    true = melt_angles(truth, names, ["session", "frame"]).withColumnRenamed("value", "_true")
    both = melt_angles(traces, names).join(true, ["session", "frame", "angle"])
    error = circular_error(F.col("_true"), F.col("value"))
    return both.groupBy("session", "model", "angle").agg(F.avg(error).alias("mae_deg"), F.count(error).alias("n_frames"))


def yaw_histogram(traces: DataFrame, bins: int = 36, value: str = "yaw") -> DataFrame:
    """Share of frames per model in equal bins of [-180, 180]; the last bin includes its upper edge. Every model has all bins."""
    width = 360.0 / bins
    at = F.floor(F.round((F.col(value) + 180) / width, 9))
    counts = traces.where(F.col(value).between(-180, 180)).groupBy("model", F.least(at, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy("model").agg(F.sum("_n").alias("_all"))
    every = total.select("model", "_all", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    both = every.join(counts.withColumn("bin", F.col("bin").cast("bigint")), ["model", "bin"], "left")
    return both.select("model", "bin", (F.coalesce("_n", F.lit(0)) / F.col("_all")).alias("share"))


def velocity_density(traces: DataFrame, dt: float, cap: float, points: int = 500, bandwidth: float = 0.08,
                     value: str = "yaw") -> DataFrame:
    """Gaussian kernel density of the absolute velocity below ``cap`` on a grid, per model.

    The kernel width is ``bandwidth`` times the sample deviation. Equal speeds (nine digits) are counted first; each is spread
    over the grid points within nine widths, beyond which the kernel is below 10^-17 of its peak.
    """
    speed = gradient(traces, TRACE, value, dt, "_v").select("model", F.abs("_v").alias("_v")).where(F.col("_v") < cap)
    counts = materialised(speed.groupBy("model", F.round("_v", 9).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "speeds")
    n, s1 = F.sum("_c"), F.sum(F.col("_c") * F.col("_v"))
    middle = lookup(counts.groupBy("model").agg(n.alias("_n"), (s1 / n).alias("_m")), "means")
    square = F.sum(F.col("_c") * F.pow(F.col("_v") - F.col("_m"), 2))
    width = counts.join(middle, "model").groupBy("model", "_n").agg(
        (F.sqrt(square / F.nullif(F.col("_n") - 1, F.lit(0))) * bandwidth).alias("_h"))
    width = lookup(width.select("model", "_n", F.nullif("_h", F.lit(0.0)).alias("_h")), "widths")
    step = cap / (points - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("_v") - 9 * F.col("_h")) / step)).cast("bigint")
    high = F.least(F.lit(points - 1), F.floor((F.col("_v") + 9 * F.col("_h")) / step)).cast("bigint")
    near = counts.join(width, "model").where(low <= high).select("model", "_v", "_c", "_h", F.explode(F.sequence(low, high)).alias("i"))
    at = F.col("i") * F.lit(cap) / (points - 1)
    sums = near.groupBy("model", "i").agg(F.sum(F.col("_c") * F.exp(-F.pow((at - F.col("_v")) / F.col("_h"), 2) / 2)).alias("_s"))
    grid = width.select("model", "_n", "_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))
    return grid.join(sums, ["model", "i"], "left").select("model", "i", at.alias("speed"), (
        F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


# Saccades.

def detect_saccades(traces: DataFrame, dt: float, threshold: float = 500, min_ms: float = 10, merge_ms: float = 20,
                    value: str = "yaw", keys: Sequence[str] = TRACE) -> DataFrame:
    """Runs of frames whose absolute velocity reaches ``threshold`` (deg/s).

    Runs no more than ``merge_ms`` apart are joined, runs shorter than ``min_ms`` dropped. onset and offset are frames
    (offset is the first frame after the run); amplitude is the angle there minus the angle at the onset; the direction
    is CW for a positive peak velocity. The fast frames, a small part of the trace, are written to the shared folder.
    """
    min_frames = max(1, round(min_ms / 1000 / dt))
    merge_frames = max(0, round(merge_ms / 1000 / dt))
    keys = list(keys)
    fast = gradient(traces, keys, value, dt, "_v", keep_next=True)
    fast = fast.where(F.round(F.abs("_v"), 9) >= threshold).select(
        *keys, "frame", F.col("frame").alias("_f"), "_v", value, f"after_{value}")
    fast = neighbours(materialised(fast, "fast"), keys, "frame", ["_f"])
    starts = (~F.col("has_prev") | (F.col("frame") - F.col("prev__f") - 1 > merge_frames)).cast("bigint")
    runs = running_total(fast, keys, "frame", starts, "run")
    first, last = F.min("frame"), F.max("frame")
    events = runs.groupBy(*keys, "run").agg(
        first.alias("onset"), (last + 1).alias("offset"),
        (F.max_by(f"after_{value}", "frame") - F.min_by(value, "frame")).alias("amplitude_deg"),
        F.max_by("_v", F.struct(F.round(F.abs("_v"), 9), -F.col("frame"))).alias("peak_velocity_deg_s"))
    events = events.where(F.col("offset") - F.col("onset") >= min_frames).drop("run")
    length = F.col("offset") - F.col("onset")
    return events.withColumns({
        "duration_ms": length * F.lit(dt * 1000),
        "direction": F.when(F.col("peak_velocity_deg_s") > 0, "CW").otherwise("CCW")})


def saccade_frames(events: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """The frames inside saccades."""
    return events.select(*keys, F.explode(F.sequence("onset", F.col("offset") - 1)).alias("frame"))


def saccade_summary(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Per model: count, mean absolute amplitude, duration and peak velocity, and share of frames in fixation (%)."""
    total = traces.groupBy("model").agg(F.count(F.lit(1)).alias("_n"))
    sums = events.groupBy("model").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.abs("amplitude_deg")).alias("mean_amplitude"),
        F.avg("duration_ms").alias("mean_duration"), F.avg(F.abs("peak_velocity_deg_s")).alias("mean_peak"),
        F.sum(F.col("offset") - F.col("onset")).alias("_inside"))
    out = total.join(sums, "model", "left")
    return out.select("model", F.coalesce("count", F.lit(0)).alias("count"), "mean_amplitude", "mean_duration", "mean_peak",
                      (100 * (1 - F.coalesce("_inside", F.lit(0)) / F.col("_n"))).alias("fixation_pct"))


def fixation_stability(traces: DataFrame, events: DataFrame, dt: float, names: Sequence[str]) -> DataFrame:
    """Outside saccades, per model and angle: population std, mean and median absolute velocity, share of frames (%).

    The frames outside saccades are written to the shared folder, as several aggregates read them.
    """
    long = gradient(melt_angles(traces, names), [*TRACE, "angle"], "value", dt, "_v").withColumn("speed", F.abs("_v"))
    calm = long.select(*TRACE, "frame", "angle", "value", "speed").join(saccade_frames(events), [*TRACE, "frame"], "left_anti")
    calm = materialised(calm.select("model", "angle", "value", "speed"), "fixations")
    all_rows = melt_angles(traces, names).groupBy("model", "angle").agg(F.count(F.lit(1)).alias("_all"))
    sums = calm.groupBy("model", "angle").agg(
        F.stddev_pop("value").alias("std_deg"), F.avg("speed").alias("mean_speed"), F.count(F.lit(1)).alias("_n"))
    middle = percentiles(calm, ["model", "angle"], "speed", {"median_speed": 0.5}).drop("n")
    return sums.join(middle, ["model", "angle"]).join(all_rows, ["model", "angle"]).select(
        "model", "angle", "std_deg", "mean_speed", "median_speed", (F.col("_n") / F.col("_all") * 100).alias("pct_fixation"))


def saccade_agreement(events: DataFrame, tolerance: int = 3) -> DataFrame:
    """For each ordered pair of models, how many onsets of the first have one of the second within ``tolerance``.

    A model against itself counts its onsets; pairs without a match have 0. Pairs are of models, whose number is small.
    """
    onsets = events.select("session", "model", "onset")
    other = events.select("session", F.col("model").alias("other"), "onset")
    hit = near(onsets, other, ["session"], "onset", tolerance).select("session", "model", "other", "onset").distinct()
    matched = hit.groupBy("model", "other").agg(F.count(F.lit(1)).alias("matched"))
    models = events.groupBy(F.lit(1).alias("_one")).agg(F.collect_set("model").alias("_all"))
    pairs = models.select(F.explode("_all").alias("model"), "_all").select("model", F.explode("_all").alias("other"))
    return pairs.join(matched, ["model", "other"], "left").fillna(0, ["matched"])


def saccade_consensus(events: DataFrame, n_models: int, tolerance: int = 3) -> DataFrame:
    """Onsets (session, onset) with an onset of at least max(2, n_models // 2) models within ``tolerance``."""
    onsets = events.select("session", "onset").distinct()
    other = events.select("session", "model", "onset")
    votes = near(onsets, other, ["session"], "onset", tolerance).groupBy("session", "onset").agg(
        F.count_distinct("model").alias("n_agree"))
    return votes.where(F.col("n_agree") >= max(2, n_models // 2))


def consensus_share(events: DataFrame, consensus: DataFrame, tolerance: int = 3, models: Sequence[str] = ()) -> DataFrame:
    """Per model: saccades, those near a consensus onset, the rest, and the share (%). The ``models`` that have no
    saccade are there with zeros."""
    onsets = events.select("session", "model", "onset")
    found = near(onsets, consensus.select("session", "onset"), ["session"], "onset", tolerance).select(
        "session", "model", "onset").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("_in"))
    total = events.groupBy("model").agg(F.count(F.lit(1)).alias("total"))
    if models:
        named = events.sparkSession.createDataFrame([(m,) for m in models], "model string")
        total = named.join(total, "model", "left").fillna(0, ["total"])
    out = total.join(found, "model", "left").withColumn("in_consensus", F.coalesce("_in", F.lit(0)))
    return out.select("model", "total", "in_consensus", (F.col("total") - F.col("in_consensus")).alias("unique"),
                      F.coalesce(100 * F.col("in_consensus") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("agreement_pct"))


def saccade_average(events: DataFrame, traces: DataFrame, before: int, after: int, value: str = "yaw") -> DataFrame:
    """Mean displacement and its standard error (population std / sqrt(n)) per model and offset from the onset.

    CCW saccades are mirrored; saccades whose window leaves the trace are left out.
    """
    keys = list(TRACE)
    start = traces.select(*keys, F.col("frame").alias("onset"), F.col(value).alias("_start"))
    placed = events.select(*keys, "onset", "direction").join(start, [*keys, "onset"])
    rows = event_windows(placed, traces.select(*keys, "frame", value), keys, "onset", before, after)
    moved = F.col(value) - F.col("_start")
    rows = rows.withColumn("_d", F.when(F.col("direction") == "CCW", -moved).otherwise(moved))
    return rows.groupBy("model", "offset").agg(
        F.avg("_d").alias("mean"), (F.stddev_pop("_d") / F.sqrt(F.count(F.lit(1)))).alias("sem"),
        F.count(F.lit(1)).alias("n"))


# Rigidity and 3-D error.

def rigid_distances(points: DataFrame, pairs: Sequence[tuple[str, str, str]] = RIGID_PAIRS,
                    keys: Sequence[str] = ("model", "session", "frame")) -> DataFrame:
    """Distance in mm of the named keypoint pairs per frame."""
    names = sorted({k for a, b, _ in pairs for k in (a, b)})
    wide = pivot_points(points, keys, names)
    rows = F.array(*[F.struct(F.lit(label).alias("pair"), (1000 * norm(
        *[F.col(f"{a}_{c}") - F.col(f"{b}_{c}") for c in "XYZ"])).alias("distance_mm")) for a, b, label in pairs])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.pair", "_r.distance_mm")


def rigid_variation(distances: DataFrame) -> DataFrame:
    """Sample std / mean (%) of the distances per model and pair, and per session (more than one frame)."""
    sets = [["model", "pair"], ["model", "pair", "session"]]
    out = distances.groupingSets(sets, "model", "pair", "session").agg(
        F.count("distance_mm").alias("n"), F.avg("distance_mm").alias("mean_mm"), F.stddev_samp("distance_mm").alias("std_mm"))
    out = out.withColumn("cv", F.col("std_mm") / F.nullif("mean_mm", F.lit(0.0)) * 100)
    return out.where(F.col("session").isNull() | (F.col("n") > 1))


def mean_variation(variation: DataFrame) -> DataFrame:
    """Mean of the variation over pairs, per model and per model and session."""
    return variation.groupBy("model", "session").agg(F.avg("cv").alias("mean_cv"))


def error_3d(points: DataFrame, truth: DataFrame, head: Sequence[str], keys: Sequence[str] = ("session", "model", "seed")
             ) -> DataFrame:
    """Mean 3-D distance in mm of the head keypoints and of all keypoints."""
    true = truth.select("session", "frame", "keypoint", *[F.col(c).alias(f"t{c}") for c in "XYZ"])
    one = ["session", "frame"]
    both = together(points.select(*dict.fromkeys([*keys, *one, "keypoint", *"XYZ"])), one).join(many_rows(together(true, one)), [*one, "keypoint"])
    error = 1000 * norm(*[F.col(c) - F.col(f"t{c}") for c in "XYZ"])
    both = both.withColumn("_e", error)
    return both.groupBy(*keys).agg(F.avg(F.when(F.col("keypoint").isin(*head), F.col("_e"))).alias("head_mm"),
                                   F.avg("_e").alias("all_mm"), F.count("_e").alias("n_points"))


def seed_median_3d(points: DataFrame, n_seeds: int, keys: Sequence[str] = ("model", "session", "frame", "keypoint"),
                   seeds: Sequence[int] | None = None) -> DataFrame:
    """Median point over the seeds where all of them are present."""
    full = (F.count(F.col("X") + F.col("Y") + F.col("Z")) == n_seeds).alias("_ok")
    return seed_medians(points, keys, ("X", "Y", "Z"), seeds, [full]).where("_ok").select(*keys, "X", "Y", "Z")
