"""Projection, undistortion and triangulation.

Points seen without noise must come back as the true points, so most results have an exact SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import r
from trackloom.catalog.space import GROUP, digest, digest_sql
from trackloom.operators import ensemble as E, geometry as G, rig as R
from trackloom.session import many_rows

BENT = (-0.05, 0.01)
PT = ["session", "frame", "keypoint"]
DISTORTED = """ab AS (SELECT *, (u - 320) / 400 AS a, (w - 240) / 400 AS b FROM fx_seen),
rr AS (SELECT *, 1 - 0.05::DOUBLE * (a * a + b * b) + 0.01::DOUBLE * (a * a + b * b) * (a * a + b * b) AS rad FROM ab),
di AS (SELECT *, 400 * a * rad + 320 AS px, 400 * b * rad + 240 AS py FROM rr)"""


def near(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) + F.lit(0.0) for n in names})


def distorted(spark: SparkSession, sf: str) -> DataFrame:
    """The true points as every bent camera sees them: x, y."""
    seen = G.project(X.world(spark, sf), X.cameras(spark, sf, BENT))
    return seen.drop("X", "Y", "Z").withColumnsRenamed({"px": "x", "py": "y"})


def noise_free(spark: SparkSession, sf: str) -> DataFrame:
    """Exact observations with the gaps of the prediction table."""
    gap = F.expr("(ok + kp + vi) % 53 = 0")
    return X.seen(spark, sf).select("session", "view", "frame", "keypoint", F.when(~gap, F.col("u")).alias("x"),
                                    F.when(~gap, F.col("w")).alias("y"))


TRUE_POINTS = """g AS (SELECT session, frame, keypoint, any_value(X) AS X, any_value(Y) AS Y, any_value(Z) AS Z,
 count_if((ok + kp + vi) % 53 <> 0)::BIGINT AS n_views FROM fx_seen GROUP BY 1, 2, 3 HAVING count_if((ok + kp + vi) % 53 <> 0) >= 2)
SELECT session, frame, keypoint, n_views, round(X, 4) + 0.0::DOUBLE AS X, round(Y, 4) + 0.0::DOUBLE AS Y,
 round(Z, 4) + 0.0::DOUBLE AS Z FROM g"""


@register("project_points", "M3", with_tables("fx_seen", DISTORTED + " " + digest_sql("di", GROUP, ["px", "py"])))
def project_points(spark: SparkSession, sf: str) -> DataFrame:
    return digest(G.project(X.world(spark, sf), X.cameras(spark, sf, BENT)), GROUP, ["px", "py"])


@register("undistort_points", "M4", with_tables("fx_seen", "ab AS (SELECT *, (u - 320) / 400 AS ux, (w - 240) / 400 AS uy FROM fx_seen) "
                                                + digest_sql("ab", GROUP, ["ux", "uy"])))
def undistort_points(spark: SparkSession, sf: str) -> DataFrame:
    return digest(G.undistort(distorted(spark, sf), X.cameras(spark, sf, BENT)), GROUP, ["ux", "uy"])


@register("triangulate", "M1 M6", with_tables("fx_seen", TRUE_POINTS))
def triangulate(spark: SparkSession, sf: str) -> DataFrame:
    return near(G.triangulate(noise_free(spark, sf), X.cameras(spark, sf)), "X", "Y", "Z")


@register("triangulate_valid", "M6 M1", with_tables("fx_seen", """o AS (SELECT *, (ok + kp + vi) % 53 = 0 OR ((frame * 7 + substr(view, 2)::BIGINT) % 5 = 0 AND keypoint = 'nose') AS hole
 FROM fx_seen), w AS (SELECT *, count_if(NOT hole) OVER (PARTITION BY session, frame, view) AS n FROM o), f AS (SELECT *, min(n) OVER (PARTITION BY session, frame) AS nf FROM w),
m AS (SELECT 'frame' AS mode, * FROM f WHERE nf = 3 UNION ALL SELECT 'all', * FROM f WHERE n = 3
 UNION ALL SELECT 'most', * FROM f WHERE n > 1.5 AND NOT hole)
SELECT mode, session, frame, keypoint, count(*) AS n_views FROM m GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"""))
def triangulate_valid(spark: SparkSession, sf: str) -> DataFrame:
    """How many views are left to each point where one keypoint is missing in some views."""
    hole = ((F.col("frame") * 7 + F.substring("view", 2, 9).cast("long")) % 5 == 0) & (F.col("keypoint") == "nose")
    seen = noise_free(spark, sf).withColumns({c: F.when(~hole, F.col(c)) for c in "xy"})
    modes = [G.triangulate(seen, X.cameras(spark, sf), validity=m, n_keypoints=len(X.KEYPOINTS)).withColumn("mode", F.lit(m))
             for m in ("frame", "all", "most")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).select("mode", "session", "frame", "keypoint", "n_views")


@register("triangulate_bent", "M1 M4", with_tables("fx_world", """SELECT session, frame, keypoint, 4::BIGINT AS n_views,
 round(X, 4) + 0.0::DOUBLE AS X, round(Y, 4) + 0.0::DOUBLE AS Y, round(Z, 4) + 0.0::DOUBLE AS Z FROM fx_world"""))
def triangulate_bent(spark: SparkSession, sf: str) -> DataFrame:
    return near(G.triangulate(distorted(spark, sf), X.cameras(spark, sf, BENT)), "X", "Y", "Z")


@register("triangulate_pairs", "M2", with_tables("fx_seen", TRUE_POINTS))
def triangulate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return near(G.triangulate_pairs(noise_free(spark, sf), X.cameras(spark, sf)), "X", "Y", "Z")


@register("triangulation_error", "M1 A26")
def triangulation_error(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of the points found from noisy predictions to the true points."""
    from trackloom.operators.behaviour import error_3d

    found = G.triangulate(X.predictions(spark, sf), X.cameras(spark, sf), ["model", "seed", *PT])
    return error_3d(found, X.world(spark, sf), ["nose"])


def confident(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    obs = X.predictions(spark, sf).select("seed", *PT, "view", F.col("u").alias("x"), F.col("w").alias("y"), "likelihood")
    return G.triangulate_confident(obs, X.cameras(spark, sf), 0.5, 2, ["seed", *PT])


CONFIDENT = """c AS (SELECT seed, session, frame, keypoint FROM fx_pred WHERE likelihood > 0.5 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)"""


@register("reproject_confident", "M5", with_tables("fx_pred", CONFIDENT + """, q AS (SELECT p.session, p.view, p.keypoint,
 u AS px, w AS py FROM fx_pred p JOIN c USING (seed, session, frame, keypoint)) """
                                                   + digest_sql("q", GROUP, ["px", "py"], 4)))
def reproject_confident(spark: SparkSession, sf: str) -> DataFrame:
    return digest(confident(spark, sf)[0], GROUP, ["px", "py"], 4)


@register("confident_view_errors", "M5", with_tables("fx_pred", CONFIDENT + """ SELECT p.session, p.view, count(*) AS n,
 0.0::DOUBLE AS worst FROM fx_pred p JOIN c USING (seed, session, frame, keypoint) WHERE likelihood > 0.5 GROUP BY 1, 2"""))
def confident_view_errors(spark: SparkSession, sf: str) -> DataFrame:
    return near(confident(spark, sf)[1].groupBy("session", "view").agg(
        F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst")), "worst")


@register("leave_one_view_out", "A28", with_tables("fx_seen", """h AS (SELECT * FROM fx_seen WHERE (ok + kp + vi) % 53 <> 0),
g AS (SELECT session, frame, keypoint FROM h GROUP BY 1, 2, 3 HAVING count(*) >= 3),
q AS (SELECT session, view, keypoint, u AS px, w AS py FROM h SEMI JOIN g USING (session, frame, keypoint)) """
                                               + digest_sql("q", GROUP, ["px", "py"], 4)))
def leave_one_view_out(spark: SparkSession, sf: str) -> DataFrame:
    return digest(G.leave_one_out(noise_free(spark, sf), X.cameras(spark, sf)), GROUP, ["px", "py"], 4)


@register("leave_one_view_out_error", "A28")
def leave_one_view_out_error(spark: SparkSession, sf: str) -> DataFrame:
    """Error of held-out noisy views per seed."""
    errors = G.leave_one_out(X.predictions(spark, sf), X.cameras(spark, sf), ["seed", *PT])
    return G.leave_one_out_summary(errors, ["nose"], ["seed"])


@register("reprojection_error", "A36", with_tables("fx_holes", """q AS (SELECT session, view, keypoint, abs(x - u) AS dx, abs(y - w) AS dy,
 sqrt(power(x - u, 2) + power(y - w, 2)) AS distance, (abs(x - u) + abs(y - w)) / 2 AS mean_xy FROM fx_holes) """
                                               + digest_sql("q", GROUP, ["dx", "dy", "distance", "mean_xy"])))
def reprojection_error(spark: SparkSession, sf: str) -> DataFrame:
    out = G.reprojection_error(X.world(spark, sf), X.holes(spark, sf), X.cameras(spark, sf))
    return digest(out, GROUP, ["dx", "dy", "distance", "mean_xy"])


@register("camera_scale", "M20", with_tables("fx_world fx_view", """c AS (SELECT session, frame, avg(X) AS X, avg(Z) AS Z FROM fx_world
 GROUP BY 1, 2) SELECT session, frame, view, round(400 / (-n * X + c * Z + 6), 6) AS scale FROM c, fx_view""".replace(
    "FROM c, fx_view", "FROM c AS k, fx_view").replace("-n * X + c * Z", "-fx_view.n * k.X + fx_view.c * k.Z")))
def camera_scale(spark: SparkSession, sf: str) -> DataFrame:
    return r(G.camera_scale(X.world(spark, sf), X.cameras(spark, sf)), "scale")


# Three keypoints span a plane, so their distances in the components equal those in all views together.
@register("pose_from_views", "M7", with_tables("fx_holes", """h AS (SELECT *, count(x) OVER (PARTITION BY seed, session, frame, view) AS c
 FROM fx_holes), g AS (SELECT * FROM h WHERE c = 3),
d AS (SELECT seed, session, frame, sqrt(sum(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d, count(*) AS n FROM
 (SELECT * FROM g WHERE keypoint = 'pawL') a JOIN (SELECT * FROM g WHERE keypoint = 'nose') b USING (seed, session, frame, view)
 GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT seed, session, frame, round(d, 4) AS d FROM d"""))
def pose_from_views(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.behaviour import rigid_distances

    z = G.pose_from_views(X.holes(spark, sf), X.KEYPOINTS, X.VIEWS, ("seed", "session", "frame"))
    d = rigid_distances(z, [("pawL", "nose", "d")], ["seed", "session", "frame"])
    return d.select("seed", "session", "frame", F.round(F.col("distance_mm") / 1000, 4).alias("d"))


@register("smooth_camera_points", "M22 M3", with_tables("fx_seen", DISTORTED + """ SELECT session, view, keypoint, count(*) AS n,
 count_if((ok + kp + vi) % 53 <> 0)::BIGINT AS n_seen, """ + ", ".join(
    f"round(avg({v}), 2) + 0.0::DOUBLE AS {n}_mean, round(avg({v} * (frame % 97)), 2) + 0.0::DOUBLE AS {n}_by_frame"
    for n, v in (("x", "px"), ("y", "py"), ("at_x", "X"), ("at_y", "Y"), ("at_z", "Z"))) + " FROM di GROUP BY 1, 2, 3"))
def smooth_camera_points(spark: SparkSession, sf: str) -> DataFrame:
    """Exact observations of bent cameras with gaps: smoothing through the cameras gives the true points and all pixels back."""
    gap = F.expr("(ok + kp + cast(substr(view, 2) as long)) % 53 = 0")
    ens = distorted(spark, sf).withColumns({**{c: F.when(~gap, F.col(c)) for c in "xy"}, "x_ens_var": F.lit(1e-4), "y_ens_var": F.lit(1e-4)})
    out = R.smooth_through_cameras(ens, X.cameras(spark, sf, BENT), X.VIEWS, 1.0)
    made = []
    for c in ("x", "y", "at_x", "at_y", "at_z"):
        made += [(F.round(F.avg(c), 2) + 0.0).alias(f"{c}_mean"), (F.round(F.avg(F.col(c) * (F.col("frame") % 97)), 2) + 0.0).alias(f"{c}_by_frame")]
    return out.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.count("x_ens_median").alias("n_seen"), *made)


@register("smooth_through_cameras", "M22")
def smooth_through_cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy ensembles smoothed in space with the likeliest process variance of each keypoint, and how far from the true pixels they are."""
    cams = X.cameras(spark, sf)
    ens = E.ensemble(X.holes(spark, sf), "mean", ("session", "view", "frame", "keypoint"))
    out = R.smooth_through_cameras(R.tuned_through_cameras(ens, cams, X.VIEWS, (0.01, 0.1, 1.0)), cams, X.VIEWS, "process_variance")
    true = X.seen(spark, sf).select("session", "view", "frame", "keypoint", "u", "w")
    far = lambda a, b: F.round(F.avg(F.hypot(F.col(a) - F.col("u"), F.col(b) - F.col("w"))), 3)
    return out.join(many_rows(true), ["session", "view", "frame", "keypoint"]).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), far("x", "y").alias("smoothed_error"), far("x_ens_median", "y_ens_median").alias("ensemble_error"),
        F.round(F.avg("x_posterior_var"), 3).alias("x_posterior_var"), F.round(F.max("step"), 1).alias("step"))
