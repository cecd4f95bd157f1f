"""Clusters of features and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import FEATURES, with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import r
from trackloom.operators import cluster as C
from trackloom.operators import hierarchy as H
from trackloom.operators import latent as M

LONG = "lo AS (" + " UNION ALL ".join(f"SELECT cluster, '{f}' AS feature, {f} AS value FROM fx_feature" for f in FEATURES) + ")"
DEVIATION = LONG + """, wh AS (SELECT feature, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
 quantile_cont(value, 0.75) AS q75 FROM lo GROUP BY 1),
ow AS (SELECT cluster, feature, quantile_cont(value, 0.5) AS m FROM lo GROUP BY 1, 2),
de AS (SELECT cluster, feature, round((m - q50) / CASE WHEN q75 - q25 = 0 THEN 1e-6 ELSE q75 - q25 END, 9) AS d FROM ow JOIN wh USING (feature))"""


@register("cluster_sizes", "A15", with_tables("fx_feature", """SELECT cluster, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6)
 AS pct FROM fx_feature GROUP BY 1"""))
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return r(C.cluster_sizes(X.features(spark, sf)), "pct")


@register("cluster_deviations", "A16", with_tables("fx_feature", DEVIATION + " SELECT cluster, feature, round(d, 6) + 0.0::DOUBLE AS deviation FROM de"))
def cluster_deviations(spark: SparkSession, sf: str) -> DataFrame:
    return r(C.robust_deviations(X.features(spark, sf), FEATURES), "deviation")


@register("name_clusters", "A16", with_tables("fx_feature", DEVIATION + """, t AS (SELECT cluster,
 max(CASE WHEN contains(feature, 'speed') OR contains(feature, 'acc') THEN d END) AS moving, max(CASE WHEN contains(feature, 'acc') THEN d END) AS acc,
 round(avg(CASE WHEN contains(feature, 'vy') THEN d END), 9) AS vy, round(avg(CASE WHEN contains(feature, 'vz') THEN d END), 9) AS vz,
 max(CASE WHEN feature = 'pawL_speed' THEN d END) AS l, max(CASE WHEN feature = 'pawR_speed' THEN d END) AS r FROM de GROUP BY 1),
n AS (SELECT cluster, moving, concat_ws('+', CASE WHEN acc > 3 THEN 'High_Acceleration' END,
 CASE WHEN vz > 2 AND vz > vy THEN 'Vertical_Movement' WHEN vy > 2 THEN 'Running' END,
 CASE WHEN l > r + 1.5 THEN 'Left_Paw_Dominant' WHEN r > l + 1.5 THEN 'Right_Paw_Dominant'
 WHEN l > 1.5 AND r > 1.5 AND NOT (vy > 2) AND NOT (vz > 2 AND vz > vy) THEN 'Bilateral_Active' END) AS traits FROM t)
SELECT cluster, 'C' || cluster || '_' || CASE WHEN moving < 1 THEN 'Stationary' WHEN traits <> '' THEN traits
 ELSE 'Unclassified_Active' END AS name FROM n"""))
def name_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.name_clusters(X.features(spark, sf), FEATURES)


@register("paw_moving_clusters", "A17", with_tables("fx_feature", """m AS (SELECT cluster, avg(pawL_speed) AS l, avg(pawR_speed) AS r FROM fx_feature
 GROUP BY 1) SELECT cluster FROM m WHERE round(l - (SELECT quantile_cont(pawL_speed, 0.75) FROM fx_feature), 9) > 0
 OR round(r - (SELECT quantile_cont(pawR_speed, 0.75) FROM fx_feature), 9) > 0"""))
def paw_moving_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.paw_moving_clusters(X.features(spark, sf))


@register("cluster_profiles", "A18 W11", with_tables("fx_feature", LONG + """, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-8::DOUBLE AS s
 FROM lo GROUP BY 1)
SELECT cluster, feature, round(avg((value - m) / s), 6) + 0.0::DOUBLE AS mean, round(stddev_pop((value - m) / s), 6) AS std,
 count(*) AS n FROM lo JOIN s USING (feature) GROUP BY 1, 2"""))
def cluster_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return r(C.cluster_profiles(X.features(spark, sf), FEATURES), "mean", "std")


@register("cluster_centroids", "M24", with_tables("fx_feature", "SELECT cluster, " + ", ".join(
    f"round(avg({f}), 6) + 0.0::DOUBLE AS {f}" for f in FEATURES) + " FROM fx_feature GROUP BY 1"))
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return r(C.cluster_centroids(X.features(spark, sf), FEATURES), *FEATURES)


def _as_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.array(*FEATURES))


_SQUARES = " + ".join(f"power(f.{f} - c.{f}, 2)" for f in FEATURES)


@register("nearest_to_center", "T5", with_tables("fx_feature", "c AS (SELECT cluster, " + ", ".join(
    f"avg({f}) AS {f}" for f in FEATURES) + f""" FROM fx_feature GROUP BY 1),
d AS (SELECT f.cluster, f.frame, sqrt({_SQUARES}) AS d FROM fx_feature f JOIN c ON f.cluster = c.cluster),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(d, 9), frame) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM d)
SELECT cluster, frame, round(d, 6) AS distance, n AS cluster_size FROM k WHERE rn = 1"""))
def nearest_to_center(spark: SparkSession, sf: str) -> DataFrame:
    f = X.features(spark, sf)
    centers = C.cluster_centroids(f, FEATURES).select("cluster", F.array(*FEATURES).alias("center"))
    return r(C.nearest_to_center(_as_vector(f), centers, ["frame"]), "distance")


def poses(spark: SparkSession, sf: str) -> DataFrame:
    return M.pose_vectors(X.world(spark, sf), X.KEYPOINTS, ["session", "frame"])


@register("kmeans_select", "M18 T5")
def kmeans_select(spark: SparkSession, sf: str) -> DataFrame:
    """One pose per cluster."""
    return C.kmeans_select(poses(spark, sf), 20, 7, ["session", "frame"])


@register("kmeans_per_session", "T6 M18")
def kmeans_per_session(spark: SparkSession, sf: str) -> DataFrame:
    """60 poses, evenly over the sessions."""
    return C.kmeans_per_session(poses(spark, sf), 60, 7)


@register("kmeans_session_counts", "T6", with_tables("fx_world", """f AS (SELECT session, frame FROM fx_world GROUP BY 1, 2
 HAVING count(X + Y + Z) = 3), s AS (SELECT session, count(*) AS n, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS k FROM f GROUP BY 1)
SELECT session, least(n, 60 // k + CASE WHEN i < 60 % k THEN 1 ELSE 0 END)::BIGINT AS frames FROM s"""))
def kmeans_session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many different frames each session gives."""
    picked = C.kmeans_per_session(poses(spark, sf), 60, 7)
    return picked.groupBy("session").agg(F.count_distinct("frame").alias("frames"))


@register("pose_hierarchy", "M23 M24")
def pose_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and centroids of clusters found by repeated splitting."""
    found = C.pose_hierarchy(_as_vector(X.features(spark, sf)).drop("cluster"), 6, 7)
    return C.cluster_centroids(found, FEATURES).join(C.cluster_sizes(found), "cluster")


@register("embed_2d", "M25")
def embed_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Two-dimensional view of the features."""
    return r(C.embed_2d(X.features(spark, sf), FEATURES).select("frame", "cluster", "e1", "e2"), "e1", "e2")


PLACES = [f"{k}_{a}" for k in X.KEYPOINTS for a in "XYZ"]
POSES = "po AS (SELECT session, frame, " + ", ".join(f"max(CASE WHEN keypoint = '{k}' THEN {a} END) AS {k}_{a}" for k in X.KEYPOINTS for a in "XYZ") + (
    " FROM fx_world GROUP BY 1, 2)")


def poses(spark: SparkSession, sf: str) -> DataFrame:
    return M.pose_vectors(X.world(spark, sf), X.KEYPOINTS, ["session", "frame"])


@register("ward_merges", "M23")
def ward_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Ward's merges of all poses, from the lowest."""
    return H.ward(poses(spark, sf), "v", 9).table(spark)


@register("ward_total", "M23", with_tables("fx_world", POSES + f""" SELECT (SELECT count(*) FROM (SELECT DISTINCT {", ".join(PLACES)} FROM po))::BIGINT - 1 AS merges,
 count(*) AS rows, true AS rising, round({" + ".join(f"var_pop({p})" for p in PLACES)}, 6) AS spread FROM po"""))
def ward_total(spark: SparkSession, sf: str) -> DataFrame:
    """Heights rise, the last merge holds all rows, and half the squared heights add up to the squared error of all rows."""
    from pyspark.sql import Window

    rows = ward_merges(spark, sf).withColumn("below", F.lag("height").over(Window.partitionBy(F.lit(0)).orderBy("step")))
    out = rows.agg(F.count(F.lit(1)).alias("merges"), F.max("n").alias("rows"), F.bool_and(F.coalesce(F.col("height") >= F.col("below") - 1e-9, F.lit(True))).alias("rising"),
                   (F.sum(F.col("height") * F.col("height")) / 2).alias("error"))
    return r(out.select("merges", "rows", "rising", (F.col("error") / F.col("rows")).alias("spread")), "spread")


@register("ward_clusters", "M23 M24", None)
def ward_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size and spread of the clusters where the tree is cut into eight."""
    found = H.ward_clusters(poses(spark, sf), "v", 9, 8)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.get("v", i)), 6).alias(p) for i, p in enumerate(PLACES)])


@register("kmeans_total", "M18 T5", with_tables("fx_world", POSES + f""" SELECT 20::BIGINT AS clusters, 20::BIGINT AS frames, count(*) AS rows, true AS halved,
 round({" + ".join(f"var_pop({p})" for p in PLACES)}, 6) AS spread FROM po WHERE {" + ".join(PLACES)} IS NOT NULL"""))
def kmeans_total(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters, different frames chosen, rows of all clusters, and the spread of all rows: the squared distances to the
    centres and those of the centres to the middle add up to it, as centres are the means of their members."""
    found, centers, cost = C.kmeans(poses(spark, sf), 20, 7)
    chosen = C.nearest_to_center(found, centers, ["session", "frame"]).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_distinct("session", "frame").alias("frames"), F.sum("cluster_size").alias("rows"))
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(centers, "cluster")
    moments = [F.sum(F.col("n") * F.pow(F.get("center", i), 2)) - F.pow(F.sum(F.col("n") * F.get("center", i)), 2) / F.sum("n") for i in range(len(PLACES))]
    between = sizes.agg(sum(moments, F.lit(0.0)).alias("between")).select("between").scalar()
    total = F.lit(cost) + between
    return r(chosen.select("clusters", "frames", "rows", (F.lit(cost) < total / 2).alias("halved"), (total / F.col("rows")).alias("spread")), "spread")
