"""Cameras: projection, undistortion and triangulation.

Triangulation reduces each observation to the ten distinct entries of a symmetric 4 x 4 matrix. Observations are shuffled by
frame while they are narrow; the sums are made where the point is, and only they reach the batched eigenvalue solver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackloom.functions.space import valid_observations
from trackloom.operators.behaviour import norm
from trackloom.operators.joins import with_cameras
from trackloom.schema import cols
from trackloom.session import frame_keys, many_rows, together

UPPER = [(i, j) for i in range(4) for j in range(i, 4)]
POINT = ("session", "frame", "keypoint")


def prepared(cameras: DataFrame) -> DataFrame:
    """Camera table with the rotation matrix r00..r22 and plain fx, fy, cx, cy, k1, k2, tx, ty, tz columns."""
    rv = [F.col("rvec")[i] for i in range(3)]
    base = cameras.withColumn("_theta", norm(*rv))
    v = [F.coalesce(rv[i] / F.nullif("_theta", F.lit(0.0)), F.lit(0.0)) for i in range(3)]
    base = base.withColumns({f"_v{i}": v[i] for i in range(3)})
    c, s = F.cos("_theta"), F.sin("_theta")
    skew = {(0, 1): (-1, 2), (0, 2): (1, 1), (1, 0): (1, 2), (1, 2): (-1, 0), (2, 0): (-1, 1), (2, 1): (1, 0)}

    def entry(i: int, j: int) -> Column:
        outer = (1 - c) * F.col(f"_v{i}") * F.col(f"_v{j}")
        if i == j:
            return outer + c
        sign, axis = skew[i, j]
        return outer + sign * s * F.col(f"_v{axis}")

    return base.select(
        "session", "view", *[entry(i, j).alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        F.col("k")[0].alias("fx"), F.col("k")[4].alias("fy"), F.col("k")[2].alias("cx"), F.col("k")[5].alias("cy"),
        F.coalesce(F.get("dist", 0), F.lit(0.0)).alias("k1"), F.coalesce(F.get("dist", 1), F.lit(0.0)).alias("k2"),
        *[F.col("tvec")[i].alias(f"t{a}") for i, a in enumerate("xyz")])


CAMERA_COLUMNS = [*[f"r{i}{j}" for i in range(3) for j in range(3)], "fx", "fy", "cx", "cy", "k1", "k2", "tx", "ty", "tz"]


def _in_camera(axis: int) -> Column:
    return sum((F.col(f"r{axis}{j}") * F.col("XYZ"[j]) for j in (1, 2)), F.col(f"r{axis}0") * F.col("X")) + F.col(f"t{'xyz'[axis]}")


def project(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Add the pixel (px, py) of each 3-D point.

    Points with a ``view`` column go to that camera, others to every camera of their session. Rotation, translation,
    perspective division, radial distortion k1 and k2, focal length, principal point.
    """
    on = ["session", "view"] if "view" in points.columns else ["session"]
    seen = points.join(prepared(cameras), on)
    seen = seen.withColumns({"_a": _in_camera(0) / F.nullif(_in_camera(2), F.lit(0.0)),
                             "_b": _in_camera(1) / F.nullif(_in_camera(2), F.lit(0.0))})
    n = F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")
    seen = seen.withColumn("_r", 1 + F.col("k1") * n + F.col("k2") * n * n)
    keep = [*points.columns, *([] if "view" in points.columns else ["view"])]
    pixel = F.struct((F.col("_a") * F.col("_r") * F.col("fx") + F.col("cx")).alias("px"), (F.col("_b") * F.col("_r") * F.col("fy") + F.col("cy")).alias("py"))
    # explode keeps Spark from writing the projection out again in filters above, which do not share their parts
    return seen.select(*keep, F.explode(F.array(pixel)).alias("_p")).select(*keep, "_p.px", "_p.py")


def undistort(observations: DataFrame, cameras: DataFrame, steps: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """Add camera columns and the undistorted normalised coordinates (ux, uy) of x, y.

    Radial distortion only scales a point, so one factor is found by fixed-point iteration. Where another step would still
    move it by more than ``tolerance``, as where the distortion has no inverse, ux and uy are NULL.
    """
    seen = with_cameras(observations, prepared(cameras)).withColumns(
        {"_a": (F.col("x") - F.col("cx")) / F.col("fx"), "_b": (F.col("y") - F.col("cy")) / F.col("fy")})
    seen = seen.withColumn("_n", F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))

    def step(s: Column, _: Column) -> Column:
        m = F.col("_n") * s * s
        return 1 / (1 + F.col("k1") * m + F.col("k2") * m * m)

    plain = (F.col("k1") == 0) & (F.col("k2") == 0)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1.0), step, lambda s: F.struct(s.alias("s"), step(s, s).alias("next")))
    one = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("next"))
    # explode keeps Spark from writing the iteration out again for each use of its result, the filters above included
    seen = seen.select("*", F.explode(F.array(F.when(plain, one).otherwise(found))).alias("_f"))
    seen = seen.withColumn("_s", F.when(F.abs(F.col("_f.next") - F.col("_f.s")) <= tolerance, F.col("_f.s")))
    return seen.withColumns({"ux": F.col("_a") * F.col("_s"), "uy": F.col("_b") * F.col("_s")}).drop("_a", "_b", "_n", "_s", "_f")


def _rows(observations: DataFrame, cameras: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Valid observations as the ten sums s0..s9 of their two linear equations."""
    valid = undistort(observations.where("x is not null and y is not null"), cameras).where("ux is not null")
    third = [F.col("r20"), F.col("r21"), F.col("r22"), F.col("tz")]
    first = [F.col("r00"), F.col("r01"), F.col("r02"), F.col("tx")]
    second = [F.col("r10"), F.col("r11"), F.col("r12"), F.col("ty")]
    valid = valid.select(*cols([*keys, *extra]), *[(F.col("ux") * third[i] - first[i]).alias(f"_p{i}") for i in range(4)],
                         *[(F.col("uy") * third[i] - second[i]).alias(f"_q{i}") for i in range(4)])
    made = [(F.col(f"_p{i}") * F.col(f"_p{j}") + F.col(f"_q{i}") * F.col(f"_q{j}")).alias(f"s{n}")
            for n, (i, j) in enumerate(UPPER)]
    return valid.select(*cols([*keys, *extra]), *made)


def _solve(sums: np.ndarray) -> np.ndarray:
    """Points (n, 3) from ten sums (n, 10): the eigenvector of the smallest eigenvalue, divided by its last entry."""
    if not len(sums):
        return np.empty((0, 3))
    m = np.empty((len(sums), 4, 4))
    for n, (i, j) in enumerate(UPPER):
        m[:, i, j] = m[:, j, i] = sums[:, n]
    bad = ~np.isfinite(sums).all(axis=1)
    m[bad] = np.eye(4)
    v = np.linalg.eigh(m)[1][:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = v[:, :3] / v[:, 3:]
    p[bad | ~np.isfinite(p).all(axis=1)] = np.nan
    return p


def _with_xyz(pdf: pd.DataFrame, keep: Sequence[str], xyz: np.ndarray) -> pd.DataFrame:
    out = pdf[list(keep)].copy()
    for i, c in enumerate("XYZ"):
        out[c] = xyz[:, i]
    return out


def _schema(df: DataFrame, keep: Sequence[str], added: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], *added])


XYZ_FIELDS = [T.StructField(c, T.DoubleType()) for c in "XYZ"]


def triangulate(observations: DataFrame, cameras: DataFrame, keys: Sequence[str] = POINT, min_views: int = 2,
                validity: str | None = None, n_keypoints: int | None = None) -> DataFrame:
    """keys, X, Y, Z, n_views: least squares over all views with a valid point, for points seen by ``min_views``.

    ``validity`` leaves out whole views or frames with missing keypoints (modes of ``valid_observations``: all, most, frame).
    """
    keys = list(keys)
    if validity:
        if n_keypoints is None:
            raise ValueError("validity needs n_keypoints")
        frame = [k for k in keys if k != "keypoint"]
        narrow = observations.select(*[c for c in observations.columns if c in {*keys, "session", "view", "x", "y"}])
        observations = valid_observations(together(narrow, frame_keys(frame)), n_keypoints, validity, (*frame, "view"))
    seen = observations.select(*[c for c in observations.columns if c in {*keys, "session", "view", "x", "y"}])
    rows = _rows(seen if validity else together(seen.where("x is not null and y is not null"), frame_keys(keys)), cameras, keys)
    sums = rows.groupBy(*keys).agg(*[F.sum(f"s{n}").alias(f"s{n}") for n in range(10)],
                                   F.count(F.lit(1)).alias("n_views")).where(F.col("n_views") >= min_views)
    keep = [*keys, "n_views"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _with_xyz(pdf, keep, _solve(pdf[[f"s{n}" for n in range(10)]].to_numpy(float)))

    return sums.mapInPandas(solve, _schema(sums, keep, XYZ_FIELDS))


def _per_view(observations: DataFrame, cameras: DataFrame, keys: Sequence[str], pixels: bool = False) -> DataFrame:
    """One row per point with the sums of each of its views (and, with ``pixels``, ox and oy) as short arrays, ordered by view.

    Observations are shuffled by frame while they are narrow: the ten sums of each are made, and gathered, where the point is.
    """
    extra = ["ox", "oy"] if pixels else []
    seen = together(observations.where("x is not null and y is not null").select(*keys, "view", "x", "y"), frame_keys(keys))
    rows = _rows(seen.withColumns({"ox": F.col("x"), "oy": F.col("y")}), cameras, keys, ["view", *extra])
    entry = F.struct("view", *extra, F.array(*[f"s{n}" for n in range(10)]).alias("s"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("o")).where(F.size("o") >= 2).select(
        *keys, F.col("o.view").alias("views"), *[F.col(f"o.{e}").alias(e) for e in extra],
        F.flatten("o.s").alias("s"))


def _stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums (n, V, 10), zero beyond each point's own views, the numbers of views, and the row and place of each view."""
    sizes = pdf["views"].map(len).to_numpy()
    at = np.repeat(np.arange(len(pdf)), sizes)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(pdf), int(sizes.max()), 10))
    out[at, place] = np.concatenate(pdf["s"].to_list()).reshape(-1, 10)
    return out, sizes, at, place


def triangulate_pairs(observations: DataFrame, cameras: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """keys, X, Y, Z, n_views: median over the points of each pair of views that sees them."""
    keys = list(keys)
    held = _per_view(observations, cameras, keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            s, sizes, _, _ = _stacked(pdf)
            found = []
            for i in range(s.shape[1]):
                for j in range(i + 1, s.shape[1]):
                    p = _solve(s[:, i] + s[:, j])
                    p[j >= sizes] = np.nan
                    found.append(p)
            out = pdf[keys].copy()
            middle = np.nanmedian(np.stack(found), axis=0)
            out["n_views"] = sizes
            for n, c in enumerate("XYZ"):
                out[c] = middle[:, n]
            yield out

    return held.mapInPandas(solve, _schema(held, keys, [T.StructField("n_views", T.LongType()), *XYZ_FIELDS]))


def leave_one_out(observations: DataFrame, cameras: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """keys, view, ox, oy, px, py, error: each view's observation against the point found from the other views.

    The sums of the held-out view are taken off the total, so nothing is triangulated twice over the same rows. Points
    with fewer than two other views are left out.
    """
    keys = list(keys)
    held = _per_view(observations, cameras, keys, pixels=True).where(F.size("views") >= 3)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            s, _, at, place = _stacked(pdf)
            p = _solve(s.sum(axis=1)[at] - s[at, place])
            out = pdf[keys].iloc[at].reset_index(drop=True)
            for c in ("views", "ox", "oy"):
                out["view" if c == "views" else c] = np.concatenate(pdf[c].to_list())
            for n, c in enumerate("XYZ"):
                out[c] = p[:, n]
            yield out

    fields = [T.StructField("view", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("ox", "oy")], *XYZ_FIELDS]
    points = held.mapInPandas(solve, _schema(held, keys, fields))
    seen = project(points, cameras)
    error = norm(F.col("px") - F.col("ox"), F.col("py") - F.col("oy"))
    return seen.select(*keys, "view", "ox", "oy", "px", "py", error.alias("error"))


def leave_one_out_summary(errors: DataFrame, head: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean over held-out views and frames of the mean error of the head keypoints and of all keypoints."""
    one = errors.groupBy(*keys, "session", "frame", "view").agg(
        F.avg(F.when(F.col("keypoint").isin(*head), F.col("error"))).alias("_h"), F.avg("error").alias("_a"))
    # frames are told apart by one bit each, which tasks gather before anything is shuffled
    block = F.when(F.col("session").isNotNull(), F.bitmap_bucket_number(F.col("frame").cast("long"))).alias("_block")
    marks = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("frame").cast("long")))
    parts = one.groupBy(*keys, "session", block).agg(
        *[f(c).alias(f"{c}{n}") for c in ("_h", "_a") for n, f in ((0, F.sum), (1, F.count))],
        F.when(F.col("_block").isNotNull(), F.bitmap_count(marks)).otherwise(F.lit(0)).alias("_n"))
    return parts.groupBy(*keys).agg((F.sum("_h0") / F.nullif(F.sum("_h1"), F.lit(0))).alias("head_px"),
                                    (F.sum("_a0") / F.nullif(F.sum("_a1"), F.lit(0))).alias("all_px"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_frames"))


def reprojection_error(points: DataFrame, observations: DataFrame, cameras: DataFrame, keys: Sequence[str] = POINT
                       ) -> DataFrame:
    """keys, view, dx, dy, distance, mean_xy: observations against the projected points, in pixels."""
    both = observations.select(*keys, "view", F.col("x").alias("ox"), F.col("y").alias("oy")).join(
        many_rows(points.select(*keys, "X", "Y", "Z")), list(keys))
    seen = project(both, cameras)
    dx, dy = F.abs(F.col("px") - F.col("ox")), F.abs(F.col("py") - F.col("oy"))
    return seen.select(*keys, "view", dx.alias("dx"), dy.alias("dy"), norm(dx, dy).alias("distance"),
                       ((dx + dy) / 2).alias("mean_xy"))


def triangulate_confident(observations: DataFrame, cameras: DataFrame, threshold: float, min_views: int,
                          keys: Sequence[str] = POINT) -> tuple[DataFrame, DataFrame]:
    """Points from the views above the likelihood threshold only, and their errors on those views.

    The first result has the points reprojected to every camera (keys, view, X, Y, Z, px, py).
    """
    used = observations.where((F.col("likelihood") > threshold) & F.col("x").isNotNull() & F.col("y").isNotNull())
    points = triangulate(used, cameras, keys, min_views)
    return project(points, cameras), reprojection_error(points, used, cameras, keys)


def camera_scale(points: DataFrame, cameras: DataFrame, keys: Sequence[str] = ("session", "frame")) -> DataFrame:
    """Focal length over the distance of the keypoint centroid along the optical axis, per frame and view."""
    centre = points.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "XYZ"]).join(prepared(cameras), "session")
    return centre.select(*keys, "view", (F.col("fx") / F.nullif(_in_camera(2), F.lit(0.0))).alias("scale"))


def pose_from_views(pred: DataFrame, keypoints: Sequence[str], views: Sequence[str],
                    keys: Sequence[str] = ("session", "frame")) -> DataFrame:
    """3-D stand-in without cameras: per frame, the first three principal components of the (keypoints x 2 views)
    matrix, zero-padded.

    Views with a missing keypoint do not count; frames with fewer than two good views give no rows. The largest score
    of a component is positive.
    """
    keys = list(keys)
    narrow = together(pred.select(*keys, "view", "keypoint", "x", "y"), frame_keys(keys))
    good = valid_observations(narrow, len(keypoints), "all", (*keys, "view"))
    made = [F.max(F.when((F.col("view") == v) & (F.col("keypoint") == k), F.col(c))).alias(f"_{i}_{j}_{c}")
            for i, k in enumerate(keypoints) for j, v in enumerate(views) for c in ("x", "y")]
    names = [f"_{i}_{j}_{c}" for i in range(len(keypoints)) for j in range(len(views)) for c in ("x", "y")]
    wide = good.groupBy(*keys).agg(*made)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(keypoints)
        for pdf in batches:
            m = pdf[names].to_numpy(dtype=float, na_value=np.nan).reshape(len(pdf), k, -1)
            there = np.isfinite(m[:, 0, ::2]).sum(axis=1) >= 2
            m, rest = np.nan_to_num(m[there]), pdf.loc[there, keys]
            if not len(m):
                continue
            u, s, _ = np.linalg.svd(m - m.mean(axis=1, keepdims=True), full_matrices=False)
            z = np.zeros((len(m), k, 3))
            n = min(3, s.shape[1])
            z[:, :, :n] = (u * s[:, None, :])[:, :, :n]
            top = np.take_along_axis(z, np.abs(z).argmax(axis=1)[:, None, :], axis=1)
            z *= np.where(top < 0, -1.0, 1.0)
            out = rest.loc[rest.index.repeat(k)].reset_index(drop=True)
            out["keypoint"] = np.tile(np.array(keypoints, dtype=object), len(m))
            for i, c in enumerate("XYZ"):
                out[c] = z[:, :, i].ravel()
            yield out

    return wide.mapInPandas(solve, _schema(wide, keys, [T.StructField("keypoint", T.StringType()), *XYZ_FIELDS]))
