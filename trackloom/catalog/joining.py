"""Joins over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.space import GROUP, KEYS, digest, digest_sql
from trackloom.operators import joins as J
from trackloom.schema import rounded


@register("labels_with_predictions", "J1", with_tables("fx_label fx_pred", """q AS (SELECT seed, session, view, keypoint,
 x - lx AS dx, y - ly AS dy FROM fx_label JOIN fx_pred USING (session, view, frame, keypoint))"""
                                                       + digest_sql("q", ["seed", *GROUP], ["dx", "dy"])))
def labels_with_predictions(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf).select(*KEYS, "lx", "ly")
    both = J.labels_with_predictions(lab, J.labelled_only(X.predictions(spark, sf).select("seed", *KEYS, "x", "y"), lab))
    moved = both.withColumns({"dx": F.col("x") - F.col("lx"), "dy": F.col("y") - F.col("ly")})
    return digest(moved, ["seed", *GROUP], ["dx", "dy"])


@register("key_audit", "J1 J14", with_tables("fx_label fx_pred", """l AS (SELECT DISTINCT session, view, frame, keypoint
 FROM fx_label), p AS (SELECT DISTINCT session, view, frame, keypoint FROM fx_pred WHERE status <> 'P'),
f AS (SELECT l.session AS a, p.session AS b FROM l FULL JOIN p USING (session, view, frame, keypoint))
SELECT count_if(a IS NOT NULL AND b IS NOT NULL)::BIGINT AS in_both, count_if(b IS NULL)::BIGINT AS only_left,
 count_if(a IS NULL)::BIGINT AS only_right FROM f"""))
def key_audit(spark: SparkSession, sf: str) -> DataFrame:
    return J.key_audit(X.labels(spark, sf), X.predictions(spark, sf).where("status <> 'P'"), KEYS)


@register("points_with_cameras", "J3", with_tables("fx_pred", """cam AS (SELECT DISTINCT session, view, vi AS cam_idx
 FROM fx_pred WHERE sid <> 6)
SELECT session, view, cam_idx, count(*) AS n FROM fx_pred JOIN cam USING (session, view) GROUP BY ALL"""))
def points_with_cameras(spark: SparkSession, sf: str) -> DataFrame:
    cams = X.cameras(spark, sf).where("session <> 'S6'")
    return J.with_cameras(X.predictions(spark, sf), cams).groupBy("session", "view", "cam_idx").agg(
        F.count(F.lit(1)).alias("n"))


@register("common_frames", "J4", with_tables("fx_pred", """p AS (SELECT * FROM fx_pred WHERE NOT (view = 'v2' AND status = 'O')),
g AS (SELECT session, frame FROM p GROUP BY 1, 2 HAVING count(DISTINCT view) = 4)
SELECT session, frame, count(*) AS n FROM p SEMI JOIN g USING (session, frame) GROUP BY 1, 2"""))
def common_frames(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predictions(spark, sf).where("NOT (view = 'v2' AND status = 'O')")
    return J.common_frames(p, "view", 4).groupBy("session", "frame").agg(F.count(F.lit(1)).alias("n"))


@register("without_labelled", "J5", with_tables("fx_label fx_pred", """l AS (SELECT DISTINCT session, frame FROM fx_label)
SELECT session, view, frame, count(*) AS n FROM fx_pred ANTI JOIN l USING (session, frame) GROUP BY 1, 2, 3"""))
def without_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return J.without_labelled(X.predictions(spark, sf), X.labels(spark, sf)).groupBy("session", "view", "frame").agg(
        F.count(F.lit(1)).alias("n"))


@register("frames_for_labels", "J6", with_tables("fx_label fx_seen", """l AS (SELECT DISTINCT session, view, sid,
 CASE WHEN sid % 2 = 1 THEN frame + 1000000000 ELSE frame END AS f FROM fx_label),
p AS (SELECT session, view, frame, u FROM fx_seen WHERE keypoint = 'nose'),
d AS (SELECT l.session, l.view, l.f AS label_frame, p.frame, p.u FROM l JOIN p ON l.session = p.session AND l.view = p.view
 AND l.f = p.frame),
r AS (SELECT *, row_number() OVER (PARTITION BY session, view ORDER BY f) AS i FROM l
 ANTI JOIN (SELECT DISTINCT session, view FROM d) USING (session, view)),
q AS (SELECT *, row_number() OVER (PARTITION BY session, view ORDER BY frame) AS i FROM p)
SELECT session, view, label_frame, frame, round(u, 6) + 0.0::DOUBLE AS u FROM d UNION ALL
SELECT r.session, r.view, r.f, q.frame, round(q.u, 6) + 0.0::DOUBLE FROM r JOIN q ON r.session = q.session
 AND r.view = q.view AND r.i = q.i"""))
def frames_for_labels(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.when(F.col("sid") % 2 == 1, F.col("frame") + 1000000000).otherwise(F.col("frame"))
    lab = X.labels(spark, sf).select("session", "view", shifted.alias("frame")).distinct()
    nose = X.seen(spark, sf).where("keypoint = 'nose'").select("session", "view", "frame", "u")
    return J.frames_for_labels(lab, nose).withColumn("u", rounded(F.col("u")))


@register("camera_pairs", "J8", with_tables("fx_holes", """h AS (SELECT * FROM fx_holes WHERE x IS NOT NULL),
q AS (SELECT a.session, a.keypoint, a.view AS view_i, b.view AS view_j, a.x - b.x AS dx, a.y - b.y AS dy FROM h a JOIN h b
 ON a.seed = b.seed AND a.session = b.session AND a.frame = b.frame AND a.keypoint = b.keypoint AND a.view < b.view)"""
                                            + digest_sql("q", ["session", "keypoint", "view_i", "view_j"], ["dx", "dy"])))
def camera_pairs(spark: SparkSession, sf: str) -> DataFrame:
    h = X.holes(spark, sf).where("x is not null")
    pairs = J.camera_pairs(h, ["seed", "session", "frame", "keypoint"], ["x", "y"]).withColumns(
        {"dx": F.col("x_i") - F.col("x_j"), "dy": F.col("y_i") - F.col("y_j")})
    return digest(pairs, ["session", "keypoint", "view_i", "view_j"], ["dx", "dy"])


@register("masked_view_r2", "J13 A9", with_tables("fx_label fx_pred", """m AS (SELECT 'v' || mv AS masked_view, view AS target_view,
 session, lx, ly, CASE WHEN status = 'P' THEN NULL ELSE x + mv END AS x, y FROM fx_label JOIN
 (SELECT session, view, frame, keypoint, x, y, seed AS mv FROM fx_pred) USING (session, view, frame, keypoint)),
k AS (SELECT * FROM m WHERE masked_view = target_view AND x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT target_view, session, sum(power(lx - x, 2) + power(ly - y, 2)) AS res,
 (var_pop(lx) + var_pop(ly)) * count(*) AS tot, count(*) AS n_points FROM k GROUP BY 1, 2)
SELECT target_view, session, round(CASE WHEN tot > 1e-12 THEN 1 - res / tot END, 6) + 0.0::DOUBLE AS r2, n_points FROM s"""))
def masked_view_r2(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.evaluate import r2_pooled

    pred = X.predictions(spark, sf).select(*KEYS, "x", "y", F.col("seed").alias("mv"))
    rows = J.labels_with_predictions(X.labels(spark, sf).select(*KEYS, "lx", "ly", "status"), pred).select(
        F.concat(F.lit("v"), "mv").alias("masked_view"), F.col("view").alias("target_view"), "session", "lx", "ly",
        F.when(F.col("status") != "P", F.col("x") + F.col("mv")).alias("x"), "y")
    return r2_pooled(J.masked_matches(rows), ["target_view", "session"]).withColumn("r2", rounded(F.col("r2")))


@register("merge_splits", "J14", with_tables("fx_label", """c AS (SELECT DISTINCT session || '/' || frame AS k FROM fx_label
 WHERE status <> 'P'), i AS (SELECT DISTINCT view, image_path, session || '/' || frame AS k FROM fx_label),
v AS (SELECT view, count(*) AS images, count(c.k) AS calibrated, count(*) - count(c.k) AS uncalibrated
 FROM i LEFT JOIN c ON i.k = c.k GROUP BY 1)
SELECT *, (SELECT min(images) = max(images) FROM v) AS equal_counts FROM v"""))
def merge_splits(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf)
    parts = [lab.where(f"split = '{s}'").drop("split") for s in ("InD", "OOD")]
    key = F.concat("session", F.lit("/"), F.col("frame"))
    done = lab.where("status <> 'P'").select(key.alias("image_key")).distinct()
    return J.split_audit(J.merge_splits(*parts), done, key)
