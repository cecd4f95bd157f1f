"""Coordinate spaces, masks and frame filters over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.functions import space as S
from trackloom.operators import select as P
from trackloom.operators.joins import with_boxes
from trackloom.schema import rounded
from trackloom.session import many_rows, together

KEYS = ["session", "view", "frame", "keypoint"]


def digest(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """count, mean, min and max of each value per group, for results too long to list."""
    made = []
    for v in values:
        made += [F.count(v).alias(f"{v}_n"), *[rounded(f(v), digits).alias(f"{v}_{n}")
                                              for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *made)


def digest_sql(source: str, keys: list[str], values: list[str], digits: int = 6) -> str:
    made = ", ".join(f"count({v}) AS {v}_n, round(avg({v}), {digits}) + 0.0::DOUBLE AS {v}_mean, "
                     f"round(min({v}), {digits}) + 0.0::DOUBLE AS {v}_min, "
                     f"round(max({v}), {digits}) + 0.0::DOUBLE AS {v}_max" for v in values)
    k = ", ".join(keys)
    return f"SELECT {k}, count(*) AS n, {made} FROM {source} GROUP BY {k}"


GROUP = ["session", "view", "keypoint"]
BOXED = "b AS (SELECT p.*, box_x, box_y, box_w, box_h FROM fx_pred p LEFT JOIN fx_bbox USING (session, view, frame))"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return X.boxes(spark, sf).drop("prio", "status")


def some_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the frames that are not of low priority, so that others have none."""
    return X.boxes(spark, sf).where("prio <> 5").drop("prio", "status")


def boxed(spark: SparkSession, sf: str) -> DataFrame:
    return with_boxes(X.predictions(spark, sf), X.boxes(spark, sf))


@register("select_coords", "P1", with_tables("fx_pred", "q AS (SELECT * FROM fx_pred WHERE keypoint IN ('pawL', 'nose'))"
                                             + digest_sql("q", ["seed", *GROUP], ["x", "y"])))
def select_coords(spark: SparkSession, sf: str) -> DataFrame:
    return digest(P.select_coords(X.predictions(spark, sf), ["x", "y"], ["pawL", "nose"]), ["seed", *GROUP], ["x", "y"])


@register("crop_to_full", "P2 J2", with_tables("fx_pred fx_bbox", BOXED + """,
q AS (SELECT session, view, keypoint, x / 320 * box_w + box_x AS x, y / 320 * box_h + box_y AS y FROM b)""" + digest_sql("q", GROUP, ["x", "y"])))
def crop_to_full(spark: SparkSession, sf: str) -> DataFrame:
    return digest(S.crop_to_full(boxed(spark, sf)), GROUP, ["x", "y"])


@register("full_to_crop", "P2", with_tables("fx_pred fx_bbox", BOXED + """,
q AS (SELECT session, view, keypoint, (x - box_x) / nullif(box_w, 0) * 320 AS x, (y - box_y) / nullif(box_h, 0) * 320 AS y FROM b)"""
                                            + digest_sql("q", GROUP, ["x", "y"])))
def full_to_crop(spark: SparkSession, sf: str) -> DataFrame:
    return digest(S.full_to_crop(boxed(spark, sf)), GROUP, ["x", "y"])


HALF_BOXES = BOXED.replace("LEFT JOIN fx_bbox USING (session, view, frame)",
                           "LEFT JOIN (SELECT * FROM fx_bbox WHERE prio <> 5) USING (session, view, frame)")


@register("remap_guarded", "P3", with_tables("fx_pred fx_bbox", HALF_BOXES + """,
q AS (SELECT session, view, keypoint, CASE WHEN box_w > 0 AND box_h > 0 THEN x / 320 * box_w + box_x ELSE x END AS x,
 CASE WHEN box_w > 0 AND box_h > 0 THEN y / 320 * box_h + box_y ELSE y END AS y FROM b)""" + digest_sql("q", GROUP, ["x", "y"])))
def remap_guarded(spark: SparkSession, sf: str) -> DataFrame:
    part = with_boxes(X.predictions(spark, sf), some_boxes(spark, sf))
    return digest(S.remap_guarded(part), GROUP, ["x", "y"])


@register("crop_or_null", "P4", with_tables("fx_pred fx_bbox", HALF_BOXES + """,
q AS (SELECT session, view, keypoint, CASE WHEN box_w > 0 AND box_h > 0 THEN (x - box_x) / box_w * 320 END AS x,
 CASE WHEN box_w > 0 AND box_h > 0 THEN (y - box_y) / box_h * 320 END AS y FROM b)""" + digest_sql("q", GROUP, ["x", "y"])))
def crop_or_null(spark: SparkSession, sf: str) -> DataFrame:
    part = with_boxes(X.predictions(spark, sf), some_boxes(spark, sf))
    return digest(S.crop_or_null(part), GROUP, ["x", "y"])


@register("prefer_full_space", "P5", with_tables("fx_pred fx_bbox", """c AS (SELECT * FROM fx_pred),
u AS (SELECT seed, session, view, frame, keypoint, x + 1 AS ux, y + 2 AS uy FROM c WHERE prio <= 2),
b AS (SELECT * FROM fx_bbox WHERE prio <> 5),
q AS (SELECT session, view, keypoint, CASE WHEN ux IS NOT NULL AND box_x IS NOT NULL THEN ux WHEN box_w > 0 THEN x / 320 * box_w + box_x
 ELSE x END AS x, CASE WHEN ux IS NOT NULL AND box_x IS NOT NULL THEN uy WHEN box_w > 0 THEN y / 320 * box_h + box_y ELSE y END AS y
 FROM c LEFT JOIN u USING (seed, session, view, frame, keypoint) LEFT JOIN b USING (session, view, frame))"""
                                                 + digest_sql("q", GROUP, ["x", "y"])))
def prefer_full_space(spark: SparkSession, sf: str) -> DataFrame:
    c = X.predictions(spark, sf)
    u = c.where("prio <= 2").withColumns({"x": F.col("x") + 1, "y": F.col("y") + 2})
    out = S.prefer_full_space(c, u, some_boxes(spark, sf), ["seed", *KEYS])
    return digest(out, GROUP, ["x", "y"])


@register("prefer_median", "P6", with_tables("fx_pred", """m AS (SELECT session, view, frame, keypoint, ok, kp,
 quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, min(x) AS x, min(y) AS y FROM fx_pred GROUP BY ALL),
q AS (SELECT session, view, keypoint, CASE WHEN ok % 4 = 0 THEN x ELSE mx END AS x,
 CASE WHEN ok % 4 = 0 THEN y ELSE my END AS y FROM m)""" + digest_sql("q", GROUP, ["x", "y"])))
def prefer_median(spark: SparkSession, sf: str) -> DataFrame:
    m = X.predictions(spark, sf).groupBy(*KEYS, "ok").agg(
        F.percentile("x", 0.5).alias("x_ens_median"), F.percentile("y", 0.5).alias("y_ens_median"),
        F.min("x").alias("x"), F.min("y").alias("y"))
    gone = F.col("ok") % 4 != 0
    m = m.withColumns({c: F.when(gone, F.col(c)) for c in ("x_ens_median", "y_ens_median")})
    return digest(S.prefer_median(m), GROUP, ["x", "y"])


@register("exclude_matching", "P7", with_tables("fx_label", """q AS (SELECT * FROM fx_label
 WHERE NOT (contains(image_path, 'S2_v1') OR contains(image_path, 'img00000.') OR contains(image_path, '_v3/')))"""
                                                + digest_sql("q", GROUP, ["lx", "ly"])))
def exclude_matching(spark: SparkSession, sf: str) -> DataFrame:
    kept = P.exclude_matching(X.labels(spark, sf), "image_path", ["S2_v1", "img00000.", "_v3/"])
    return digest(kept, GROUP, ["lx", "ly"])


@register("slice_and_subsample", "P8", with_tables("fx_world", """s AS (SELECT *, row_number() OVER (PARTITION BY session,
 keypoint ORDER BY frame) - 1 AS i FROM fx_world WHERE frame >= 50 AND frame < 1500)
SELECT session, keypoint, frame, round(X, 6) AS X FROM s WHERE i % 7 = 0 AND i < 900"""))
def slice_and_subsample(spark: SparkSession, sf: str) -> DataFrame:
    cut = P.slice_frames(X.world(spark, sf), 50, 1500)
    track = ["session", "keypoint"]
    return P.every_kth(P.first_frames(cut, 900, track), 7, track).select(
        *track, "frame", rounded(F.col("X")).alias("X"))


@register("mask_low_likelihood", "P9", with_tables("fx_pred", """q AS (SELECT session, view, keypoint,
 CASE WHEN likelihood >= 0.6 THEN x END AS x, CASE WHEN likelihood >= 0.6 THEN y END AS y FROM fx_pred)"""
                                                   + digest_sql("q", GROUP, ["x", "y"])))
def mask_low_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return digest(P.mask_low_likelihood(X.predictions(spark, sf), 0.6), GROUP, ["x", "y"])


WITH_ERROR = """e AS (SELECT session, view, frame, keypoint, CASE WHEN ok % 29 = 0 THEN -1 ELSE x END AS x, y,
 sqrt(power(x - u, 2) + power(y - w, 2)) AS error, status FROM fx_pred)"""


def with_error(spark: SparkSession, sf: str) -> DataFrame:
    return X.predictions(spark, sf).withColumn("error", F.sqrt(
        F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("w"), 2))).withColumn(
        "x", F.when(F.col("ok") % 29 == 0, F.lit(-1.0)).otherwise(F.col("x")))


@register("mask_high_error", "P10", with_tables("fx_pred", WITH_ERROR + """, q AS (SELECT session, view, keypoint,
 CASE WHEN error <= 1 AND x <> -1 THEN x END AS x, CASE WHEN error <= 1 AND y <> -1 THEN y END AS y FROM e)"""
                                                + digest_sql("q", GROUP, ["x", "y"])))
def mask_high_error(spark: SparkSession, sf: str) -> DataFrame:
    return digest(P.mask_high_error(with_error(spark, sf), 1.0), GROUP, ["x", "y"])


@register("keep_low_error", "P11", with_tables("fx_pred", WITH_ERROR + """, h AS (SELECT *,
 CASE WHEN status <> 'P' OR keypoint <> 'nose' THEN error END AS e2 FROM e),
g AS (SELECT session, frame FROM h GROUP BY 1, 2 HAVING max(e2) < 1.4 AND count(e2) = count(*))
SELECT session, frame, count(*) AS n FROM h SEMI JOIN g USING (session, frame) GROUP BY 1, 2"""))
def keep_low_error(spark: SparkSession, sf: str) -> DataFrame:
    e = with_error(spark, sf).withColumn("error", F.when((F.col("status") != "P") | (F.col("keypoint") != "nose"), F.col("error")))
    return P.keep_low_error(e, 1.4).groupBy("session", "frame").agg(F.count(F.lit(1)).alias("n"))


@register("complete_rows", "P12", with_tables("fx_holes", """h AS (SELECT * FROM fx_holes),
g AS (SELECT session, frame FROM h GROUP BY 1, 2 HAVING count(x) = 36 AND count(y) = 36)
SELECT session, frame, count(*) AS n FROM h SEMI JOIN g USING (session, frame) GROUP BY 1, 2"""))
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return P.complete_rows(X.holes(spark, sf), ["x", "y"], 36).groupBy("session", "frame").agg(F.count(F.lit(1)).alias("n"))


@register("bad_and_blank_frames", "P13", with_tables("fx_label fx_view fx_kp", """bad AS (SELECT DISTINCT session, frame FROM
 fx_label WHERE status = 'P'), sess AS (SELECT DISTINCT session FROM fx_label),
q AS (SELECT session, view, frame, keypoint, lx FROM fx_label ANTI JOIN bad USING (session, frame)
 UNION ALL SELECT session, view, f, keypoint, NULL FROM sess, (SELECT unnest([5, 10]) AS f), fx_view, fx_kp)
SELECT session, frame, count(*) AS n, count(lx) AS valid FROM q GROUP BY 1, 2"""))
def bad_and_blank_frames(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf).select(*KEYS, "lx", "status")
    bad = lab.where("status = 'P'")
    lab = lab.drop("status")
    blanks = lab.select("session").distinct().select("session", F.explode(F.expr("array(5L, 10L)")).alias("frame"))
    out = P.add_blank_frames(P.drop_frames(lab, bad), blanks, X.KEYPOINTS, X.VIEWS)
    return out.groupBy("session", "frame").agg(F.count(F.lit(1)).alias("n"), F.count("lx").alias("valid"))


@register("context_frames", "P14", with_tables("fx_frame", """s AS (SELECT session, max(frame) + 1 AS n FROM fx_frame
 GROUP BY 1), p AS (SELECT session, frame FROM fx_frame WHERE prio = 1)
SELECT DISTINCT p.session, frame + d AS frame FROM p JOIN s ON p.session = s.session, (SELECT unnest(range(-2, 3)) AS d)
WHERE frame + d >= 0 AND frame + d < n"""))
def context_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = X.frames(spark, sf)
    sizes = f.groupBy("session").agg((F.max("frame") + 1).alias("n_frames"))
    return P.context_frames(f.where("prio = 1").select("session", "frame"), 2, sizes)


@register("boxes_from_keypoints", "P15", with_tables("fx_holes", """h AS (SELECT session, view, frame, status,
 CASE WHEN status <> 'P' THEN x END AS x, CASE WHEN status <> 'P' THEN y END AS y FROM fx_holes),
c AS (SELECT session, view, frame, status, avg(x) AS cx, avg(y) AS cy, 1 + CAST(frame % 3 AS DOUBLE) / 10 AS s FROM h GROUP BY 1, 2, 3, 4),
g AS (SELECT c.session, c.view, c.frame, CASE WHEN c.cx IS NULL THEN o.cx ELSE c.cx END AS cx,
 CASE WHEN c.cx IS NULL THEN o.cy ELSE c.cy END AS cy, CASE WHEN c.cx IS NULL THEN o.s ELSE c.s END AS s
 FROM c LEFT JOIN c o ON c.status = 'P' AND o.session = c.session AND o.view = c.view AND o.frame = c.frame + 1)
SELECT session, view, frame, trunc(cx - 60 * s) AS box_x, trunc(cy - 60 * s) AS box_y,
 trunc(cx + 60 * s) - trunc(cx - 60 * s) AS box_w, trunc(cy + 60 * s) - trunc(cy - 60 * s) AS box_h FROM g"""))
def boxes_from_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    h = X.holes(spark, sf)
    gone = F.col("status") != "P"
    h = h.withColumns({"x": F.when(gone, F.col("x")), "y": F.when(gone, F.col("y"))})
    scales = X.boxes(spark, sf).select("session", "view", "frame", (1 + (F.col("frame") % 3) / 10).alias("scale"))
    fallback = X.frames(spark, sf).where("status = 'P'").select(
        "session", "frame", (F.col("frame") + 1).alias("use_frame"))
    made = S.boxes_from_keypoints(h, scales, 60, fallback)
    return made.select("session", "view", "frame", *[F.col(f"box_{c}").cast("double").alias(f"box_{c}") for c in "xywh"])


@register("crop_labels", "P16", with_tables("fx_label fx_bbox", """
SELECT session, view, frame, keypoint, round((lx - box_x) / nullif(box_w, 0) * 256, 6) + 0.0::DOUBLE AS lx,
 round((ly - box_y) / nullif(box_h, 0) * 128, 6) + 0.0::DOUBLE AS ly FROM fx_label JOIN fx_bbox USING (session, view, frame)"""))
def crop_labels(spark: SparkSession, sf: str) -> DataFrame:
    both = X.labels(spark, sf).join(X.boxes(spark, sf), ["session", "view", "frame"])
    return S.crop_labels(both, (256, 128)).select(*KEYS, rounded(F.col("lx")).alias("lx"),
                                                  rounded(F.col("ly")).alias("ly"))


@register("ranked_set", "P17", with_tables("fx_label", """f AS (SELECT *, CASE WHEN sid = 3 THEN 'train' ELSE set END AS s2
 FROM fx_label), h AS (SELECT session, view, bool_or(s2 IN ('test', 'unused')) AS has FROM f GROUP BY 1, 2)
SELECT session, view, s2 AS set, count(*) AS n FROM f JOIN h USING (session, view)
WHERE NOT has OR s2 IN ('test', 'unused') GROUP BY ALL"""))
def ranked_set(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf).withColumn("set", F.when(F.col("sid") == 3, "train").otherwise(F.col("set")))
    return P.ranked_set(lab, ["session", "view"]).groupBy("session", "view", "set").agg(F.count(F.lit(1)).alias("n"))


@register("valid_observations", "M6", with_tables("fx_holes", """n AS (SELECT *, count(x) OVER (PARTITION BY seed, session, frame, view) AS c FROM fx_holes),
q AS (SELECT session, view, keypoint, CASE WHEN c = 3 THEN x END AS x, CASE WHEN c > 1.5 THEN y END AS y FROM n)"""
                                                  + digest_sql("q", GROUP, ["x", "y"])))
def valid_observations(spark: SparkSession, sf: str) -> DataFrame:
    h, key = together(X.holes(spark, sf).select("seed", *KEYS, "x", "y"), ["session", "frame"]), ("seed", "session", "frame", "view")
    strict = S.valid_observations(h, 3, "all", key).select("seed", *KEYS, "x")
    loose = S.valid_observations(h, 3, "most", key).select("seed", *KEYS, "y")
    return digest(strict.join(many_rows(loose), ["seed", *KEYS]), GROUP, ["x", "y"])
