"""Order-dependent work on tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import r
from trackloom.operators import tracks as K

DT = "(1.0::DOUBLE / 60)"
TRACK = ["session", "keypoint"]


@register("velocity", "W1", with_tables("fx_world", "SELECT session, keypoint, frame, " + ", ".join(
    f"round(coalesce(({c} - lag({c}) OVER w) / {DT}, 0), 6) + 0.0::DOUBLE AS v_{c}" for c in "XYZ") + """ FROM fx_world
 WINDOW w AS (PARTITION BY session, keypoint ORDER BY frame)"""))
def velocity(spark: SparkSession, sf: str) -> DataFrame:
    out = K.velocity(X.world(spark, sf), TRACK, list("XYZ"), 1 / 60)
    return r(out.select(*TRACK, "frame", "v_X", "v_Y", "v_Z"), "v_X", "v_Y", "v_Z")


@register("acceleration", "W2", with_tables("fx_world", "v AS (SELECT session, keypoint, frame, " + ", ".join(
    f"coalesce(({c} - lag({c}) OVER w) / {DT}, 0) AS {c}" for c in "XYZ") + """ FROM fx_world
 WINDOW w AS (PARTITION BY session, keypoint ORDER BY frame)) SELECT session, keypoint, frame, """ + ", ".join(
    f"round(coalesce(({c} - lag({c}) OVER w) / {DT}, 0), 6) + 0.0::DOUBLE AS a_{c}" for c in "XYZ") + """ FROM v
 WINDOW w AS (PARTITION BY session, keypoint ORDER BY frame)"""))
def acceleration(spark: SparkSession, sf: str) -> DataFrame:
    out = K.acceleration(X.world(spark, sf), TRACK, list("XYZ"), 1 / 60)
    return r(out.select(*TRACK, "frame", "a_X", "a_Y", "a_Z"), "a_X", "a_Y", "a_Z")


GRADIENT = """gr AS (SELECT *, CASE
 WHEN lag(yaw) OVER w IS NOT NULL AND lead(yaw) OVER w IS NOT NULL
  THEN ((lead(yaw) OVER w) - (lag(yaw) OVER w)) / (2 * 0.005::DOUBLE)
 WHEN lead(yaw) OVER w IS NOT NULL THEN ((lead(yaw) OVER w) - yaw) / 0.005::DOUBLE
 ELSE (yaw - (lag(yaw) OVER w)) / 0.005::DOUBLE END AS v FROM fx_angle
 WINDOW w AS (PARTITION BY model, session ORDER BY frame))"""


@register("gradient", "W3", with_tables("fx_angle", GRADIENT + """
SELECT model, session, frame, round(v, 6) + 0.0::DOUBLE AS v FROM gr"""))
def gradient(spark: SparkSession, sf: str) -> DataFrame:
    out = K.gradient(X.angles(spark, sf), ["model", "session"], "yaw", 0.005, "v")
    return r(out.select("model", "session", "frame", "v"), "v")


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks cut into snippets of 51 frames, each counting from zero."""
    w = X.world(spark, sf)
    return w.select(*TRACK, F.expr("frame div 51").alias("part"), F.expr("frame % 51").alias("frame"), "X")


SNIPPETS = "sn AS (SELECT session, keypoint, frame // 51 AS part, frame % 51 AS frame, X FROM fx_world)"


@register("center_frame", "W4", with_tables("fx_world", SNIPPETS + """, n AS (SELECT *, row_number() OVER (PARTITION BY session,
 keypoint, part ORDER BY frame) - 1 AS rn, count(*) OVER (PARTITION BY session, keypoint, part) AS n FROM sn)
SELECT session, keypoint, part, frame, round(X, 6) + 0.0::DOUBLE AS X FROM n WHERE n % 2 = 1 AND rn = n // 2"""))
def center_frame(spark: SparkSession, sf: str) -> DataFrame:
    return r(K.center_frame(snippets(spark, sf), [*TRACK, "part"]), "X")


@register("concat_offsets", "W5", with_tables("fx_world", SNIPPETS + """, z AS (SELECT session, keypoint, part, max(frame) + 1 AS n
 FROM sn GROUP BY 1, 2, 3), o AS (SELECT *, (sum(n) OVER (PARTITION BY session, keypoint ORDER BY part)) - n AS start FROM z)
SELECT session, keypoint, part, frame, CAST(start + frame AS BIGINT) AS index FROM sn JOIN o USING (session, keypoint, part)"""))
def concat_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return K.concat_offsets(snippets(spark, sf).drop("X"), TRACK)


@register("center_of_concat", "W6", with_tables("fx_world", """f AS (SELECT session, keypoint, max(frame) // 40 + 1 AS n_files,
 (max(frame) + 1) // (max(frame) // 40 + 1) AS len FROM fx_world GROUP BY 1, 2)
SELECT session, keypoint, frame AS index, frame // len AS part, round(X, 6) + 0.0::DOUBLE AS X FROM fx_world
 JOIN f USING (session, keypoint) WHERE frame = (frame // len) * len + len // 2 AND frame // len < n_files"""))
def center_of_concat(spark: SparkSession, sf: str) -> DataFrame:
    w = X.world(spark, sf).select(*TRACK, F.col("frame").alias("index"), "X")
    files = w.groupBy(*TRACK).agg((F.floor(F.max("index") / 40) + 1).alias("n_files"))
    return r(K.center_of_concat(w, files, TRACK), "X")


@register("motion_energy", "A21", with_tables("fx_pred", """m AS (SELECT seed, session, view, keypoint, frame,
 CASE WHEN likelihood >= 0.3 THEN x END AS x, CASE WHEN likelihood >= 0.3 THEN y END AS y FROM fx_pred),
d AS (SELECT seed, session, view, frame, sqrt(power(x - (lag(x) OVER w), 2) + power(y - (lag(y) OVER w), 2)) AS d,
 lag(frame) OVER w AS p FROM m WINDOW w AS (PARTITION BY seed, session, view, keypoint ORDER BY frame))
SELECT seed, session, view, frame, CASE WHEN max(p) IS NULL THEN 0 ELSE round(avg(d), 6) END AS motion_energy
FROM d GROUP BY 1, 2, 3, 4"""))
def motion_energy(spark: SparkSession, sf: str) -> DataFrame:
    return r(K.motion_energy(X.predictions(spark, sf), 0.3, ["seed", "session", "view"]), "motion_energy")


@register("minmax_normalise", "W10", with_tables("fx_world", """q AS (SELECT session, frame, keypoint, X, Y + sid AS Y,
 CASE WHEN sid = 2 THEN 5.0::DOUBLE ELSE Z END AS Z FROM fx_world),
s AS (SELECT session, min(X) AS lx, max(X) AS hx, min(Y) AS ly, max(Y) AS hy, min(Z) AS lz, max(Z) AS hz FROM q GROUP BY 1)
SELECT session, frame, keypoint, round(2 * (X - lx) / (hx - lx) - 1, 6) + 0.0::DOUBLE AS X,
 round(2 * (Y - ly) / (hy - ly) - 1, 6) + 0.0::DOUBLE AS Y,
 CASE WHEN hz - lz > 1e-8 THEN round(2 * (Z - lz) / nullif(hz - lz, 0) - 1, 6) + 0.0::DOUBLE ELSE 0 END AS Z
FROM q JOIN s USING (session)"""))
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    w = X.world(spark, sf).select(
        "session", "frame", "keypoint", "X", (F.col("Y") + F.col("sid")).alias("Y"),
        F.when(F.col("sid") == 2, F.lit(5.0)).otherwise(F.col("Z")).alias("Z"))
    return r(K.minmax_normalise(w, ["session"]), "X", "Y", "Z")


@register("zscore", "W11", with_tables("fx_feature", "SELECT frame, " + ", ".join(
    f"round(({n} - (SELECT avg({n}) FROM fx_feature)) / ((SELECT stddev_pop({n}) FROM fx_feature) + 1e-8::DOUBLE), 6)"
    f" + 0.0::DOUBLE AS {n}" for n in X.FEATURES) + " FROM fx_feature"))
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return r(K.zscore(X.features(spark, sf), X.FEATURES).select("frame", *X.FEATURES), *X.FEATURES)
