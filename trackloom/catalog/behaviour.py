"""Head angles, saccades, pose features and rigidity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import r
from trackloom.catalog.tracks import GRADIENT
from trackloom.operators import behaviour as B
from trackloom.session import materialised

DT = 1 / 200
WRAP = "(({0}) + 180 - 360 * floor((({0}) + 180) / 360) - 180)"


def _pivot(names: list[str]) -> str:
    return ", ".join(f"max(CASE WHEN keypoint = '{n}' THEN {a} END) AS {n}_{a}" for n in names for a in "XYZ")


VEC = "pv AS (SELECT model, session, frame, " + _pivot(["topBeak", "botBeak", "leftEye", "rightEye"]) + \
    " FROM fx_head GROUP BY 1, 2, 3),\nrv AS (SELECT model, session, frame, " + ", ".join(
        f"(topBeak_{a} + botBeak_{a}) / 2 - (leftEye_{a} + rightEye_{a}) / 2 AS f{a}0, rightEye_{a} - leftEye_{a} AS l{a}0"
        for a in "XYZ") + " FROM pv),\nve AS (SELECT model, session, frame, " + ", ".join(
        f"{p}{a}0 / (sqrt({p}X0 * {p}X0 + {p}Y0 * {p}Y0 + {p}Z0 * {p}Z0) + 1e-9::DOUBLE) AS {p}{a.lower()}"
        for p in "fl" for a in "XYZ") + " FROM rv)"
ANG = VEC + """,
pr AS (SELECT *, lx * fx + ly * fy + lz * fz AS dt FROM ve),
pp AS (SELECT *, lx - dt * fx AS px, ly - dt * fy AS py, lz - dt * fz AS pz, -fz * fx AS ux, -fz * fy AS uy, 1 - fz * fz AS uz FROM pr),
nn AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS pn, sqrt(ux * ux + uy * uy + uz * uz) AS un FROM pp),
an AS (SELECT model, session, frame, """ + WRAP.format("degrees(atan2(fy, fx))") + """ AS yaw,
 degrees(asin(greatest(least(fz, 1), -1))) AS pitch, CASE WHEN pn >= 1e-9 AND un >= 1e-9 THEN degrees(atan2(
 (px * ux + py * uy + pz * uz) / (pn * un),
 (px * (fy * uz - fz * uy) + py * (fz * ux - fx * uz) + pz * (fx * uy - fy * ux)) / (pn * un))) END AS roll FROM nn)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return B.head_vectors(X.heads(spark, sf))


@register("head_angles", "M12", with_tables("fx_head", ANG + """ SELECT model, session, frame, round(yaw, 6) + 0.0::DOUBLE AS yaw,
 round(pitch, 6) + 0.0::DOUBLE AS pitch, round(roll, 6) + 0.0::DOUBLE AS roll FROM an"""))
def head_angles(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.angles(vectors(spark, sf)), "yaw", "pitch", "roll")


# The models differ by a rotation only, so aligned vectors equal those of the reference model.
@register("align_to_reference", "M13", with_tables("fx_head", VEC + """ SELECT m.model, session, frame,
 round(fx, 6) + 0.0::DOUBLE AS fx, round(fy, 6) + 0.0::DOUBLE AS fy, round(fz, 6) + 0.0::DOUBLE AS fz,
 round(lx, 6) + 0.0::DOUBLE AS lx, round(ly, 6) + 0.0::DOUBLE AS ly, round(lz, 6) + 0.0::DOUBLE AS lz
FROM ve, (SELECT unnest(['m0', 'm1', 'm2']) AS model) m WHERE ve.model = 'm0'"""))
def align_to_reference(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.align_to_reference(vectors(spark, sf), "m0"), "fx", "fy", "fz", "lx", "ly", "lz")


@register("align_yaw", "W14 M14", with_tables("fx_angle", f"""rf AS (SELECT session, frame, yaw AS ref FROM fx_angle WHERE model = 'm0'),
o AS (SELECT model, avg({WRAP.format('ref - yaw')}) AS off FROM fx_angle JOIN rf USING (session, frame) GROUP BY 1),
al AS (SELECT model, session, frame, ref, CASE WHEN model = 'm0' THEN yaw ELSE {WRAP.format('yaw + off')} END AS yaw
 FROM fx_angle JOIN o USING (model) JOIN rf USING (session, frame))
SELECT model, session, frame, round(yaw, 6) + 0.0::DOUBLE AS yaw, round(abs({WRAP.format('ref - yaw')}), 6) AS error FROM al"""))
def align_yaw(spark: SparkSession, sf: str) -> DataFrame:
    a = X.angles(spark, sf).select("model", "session", "frame", "yaw")
    out = B.align_yaw(a, "m0")
    ref = a.where("model = 'm0'").select("session", "frame", F.col("yaw").alias("ref"))
    out = out.join(ref, ["session", "frame"])
    return r(out.withColumn("error", B.circular_error(F.col("ref"), F.col("yaw"))).drop("ref"), "yaw", "error")


@register("angular_error", "A27", with_tables("fx_head", ANG + """, t AS (SELECT session, frame, yaw AS ty, pitch AS tp, roll AS tr FROM an
 WHERE model = 'm0'), e AS (SELECT model, session, unnest([{'a': 'yaw', 'e': abs(""" + WRAP.format("ty - yaw") + """)},
 {'a': 'pitch', 'e': abs(""" + WRAP.format("tp - pitch") + """)}, {'a': 'roll', 'e': abs(""" + WRAP.format("tr - roll") + """)}]) AS s
 FROM an JOIN t USING (session, frame))
SELECT session, model, s.a AS angle, round(avg(s.e), 6) + 0.0::DOUBLE AS mae_deg, count(s.e) AS n_frames FROM e GROUP BY ALL"""))
def angular_error(spark: SparkSession, sf: str) -> DataFrame:
    a = B.angles(vectors(spark, sf))
    return r(B.angular_error(a, a.where("model = 'm0'").drop("model")), "mae_deg")


# Pitch and roll beside the yaw of the derived table, one row per angle, with its gradient.
GRADIENT3 = """l AS (SELECT model, session, frame, angle, CASE angle WHEN 'yaw' THEN yaw WHEN 'pitch' THEN yaw / 2 + frame % 7
 ELSE frame % 11 - yaw / 4 END AS yaw FROM fx_angle, (SELECT unnest(['yaw', 'pitch', 'roll']) AS angle)),
""" + GRADIENT.replace("gr AS", "g3 AS").replace("FROM fx_angle", "FROM l").replace("PARTITION BY model, session", "PARTITION BY model, session, angle")


def angles3(spark: SparkSession, sf: str) -> DataFrame:
    return X.angles(spark, sf).selectExpr("*", "yaw / 2 + frame % 7 AS pitch", "frame % 11 - yaw / 4 AS roll")


@register("angle_summary", "A31", with_tables("fx_angle", GRADIENT3 + """ SELECT model, angle, round(avg(yaw), 6) + 0.0::DOUBLE AS mean,
 round(stddev_pop(yaw), 6) AS std, round(min(yaw), 6) AS min, round(max(yaw), 6) AS max, round(avg(abs(v)), 6) AS mean_speed
FROM g3 GROUP BY 1, 2"""))
def angle_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.angle_summary(angles3(spark, sf), DT), "mean", "std", "min", "max", "mean_speed")


@register("yaw_histogram", "A32", with_tables("fx_angle", """b AS (SELECT model, least(floor(round((yaw + 180) / 10, 9)), 35)::BIGINT AS bin
 FROM fx_angle WHERE yaw BETWEEN -180 AND 180), c AS (SELECT model, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT m.model, i AS bin, round(coalesce(n, 0) / m.total, 6) AS share FROM (SELECT model, sum(n) AS total FROM c GROUP BY 1) m
CROSS JOIN range(36) t(i) LEFT JOIN c ON c.model = m.model AND c.bin = i"""))
def yaw_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.yaw_histogram(X.angles(spark, sf)).withColumn("bin", F.col("bin").cast("bigint")), "share")


@register("velocity_density", "A33", with_tables("fx_angle", GRADIENT + """, s AS (SELECT model, abs(v) AS v FROM gr WHERE abs(v) < 3000),
h AS (SELECT model, stddev_samp(v) * 0.08::DOUBLE AS h FROM s GROUP BY 1), g AS (SELECT i, 3000::DOUBLE * i / 499 AS x FROM range(500) t(i))
SELECT model, i, round(x, 6) AS speed, round(avg(exp(-power((x - v) / h, 2) / 2)) / (max(h) * sqrt(2 * pi())), 9) AS density
FROM s JOIN h USING (model), g GROUP BY 1, 2, 3"""))
def velocity_density(spark: SparkSession, sf: str) -> DataFrame:
    out = B.velocity_density(X.angles(spark, sf), DT, 3000.0)
    return out.withColumns({"speed": F.round("speed", 6), "density": F.round("density", 9)})


EVENTS = GRADIENT + """,
nx AS (SELECT *, coalesce(lead(yaw) OVER w, yaw) AS after FROM gr WINDOW w AS (PARTITION BY model, session ORDER BY frame)),
fa AS (SELECT *, lag(frame) OVER w AS p FROM nx WHERE round(abs(v), 9) >= 500
 WINDOW w AS (PARTITION BY model, session ORDER BY frame)),
ru AS (SELECT *, count_if(p IS NULL OR frame - p > 1) OVER (PARTITION BY model, session ORDER BY frame) AS run FROM fa),
r1 AS (SELECT model, session, run, min(frame) AS s, max(frame) + 1 AS e FROM ru GROUP BY 1, 2, 3),
m1 AS (SELECT *, lag(e) OVER (PARTITION BY model, session ORDER BY s) AS pe FROM r1),
m2 AS (SELECT *, count_if(pe IS NULL OR s - pe > 4) OVER (PARTITION BY model, session ORDER BY s) AS grp FROM m1),
m3 AS (SELECT model, session, grp, min(s) AS onset, max(e) AS offset_ FROM m2 GROUP BY 1, 2, 3 HAVING max(e) - min(s) >= 2),
ev AS (SELECT m3.model, m3.session, onset, offset_ AS "offset", any_value(la.after) - any_value(fi.yaw) AS amplitude_deg,
 arg_max(ru.v, round(abs(ru.v), 9) * 1000000000000 - ru.frame) AS peak, (offset_ - onset) * 5.0::DOUBLE AS duration_ms
 FROM m3 JOIN nx fi ON fi.model = m3.model AND fi.session = m3.session AND fi.frame = onset
 JOIN nx la ON la.model = m3.model AND la.session = m3.session AND la.frame = offset_ - 1
 JOIN ru ON ru.model = m3.model AND ru.session = m3.session AND ru.frame >= onset AND ru.frame < offset_ GROUP BY ALL)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return materialised(B.detect_saccades(X.angles(spark, sf), DT), "saccades")


@register("detect_saccades", "W7", with_tables("fx_angle", EVENTS + """
SELECT model, session, onset, "offset", round(amplitude_deg, 6) + 0.0::DOUBLE AS amplitude_deg,
 round(abs(peak), 6) AS peak_speed, duration_ms, CASE WHEN peak > 0 THEN 'CW' ELSE 'CCW' END AS direction FROM ev"""))
def detect_saccades(spark: SparkSession, sf: str) -> DataFrame:
    out = B.detect_saccades(X.angles(spark, sf), DT).withColumn("peak_speed", F.abs("peak_velocity_deg_s")).drop("peak_velocity_deg_s")
    return r(out, "amplitude_deg", "peak_speed", "duration_ms")


@register("saccade_summary", "A30", with_tables("fx_angle", EVENTS + """, n AS (SELECT model, count(*) AS n FROM fx_angle GROUP BY 1)
SELECT model, count(*) AS count, round(avg(abs(amplitude_deg)), 6) AS mean_amplitude, round(avg(duration_ms), 6) AS mean_duration,
 round(avg(abs(peak)), 6) AS mean_peak, round(100 * (1 - sum("offset" - onset) / any_value(n)), 6) AS fixation_pct
FROM ev JOIN n USING (model) GROUP BY 1"""))
def saccade_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = B.saccade_summary(events(spark, sf), X.angles(spark, sf))
    return r(out, "mean_amplitude", "mean_duration", "mean_peak", "fixation_pct")


@register("fixation_stability", "A29", with_tables("fx_angle", EVENTS + ", " + GRADIENT3 + """, c AS (SELECT g3.model, angle, yaw, v FROM g3
 LEFT JOIN ev ON g3.model = ev.model AND g3.session = ev.session AND g3.frame >= onset AND g3.frame < "offset" WHERE onset IS NULL),
n AS (SELECT model, count(*) AS n FROM fx_angle GROUP BY 1)
SELECT model, angle, round(stddev_pop(yaw), 6) AS std_deg, round(avg(abs(v)), 6) AS mean_speed,
 round(quantile_cont(abs(v), 0.5), 6) AS median_speed, round(count(*) / any_value(n) * 100, 6) AS pct_fixation
FROM c JOIN n USING (model) GROUP BY 1, 2"""))
def fixation_stability(spark: SparkSession, sf: str) -> DataFrame:
    out = B.fixation_stability(angles3(spark, sf), events(spark, sf), DT, ["yaw", "pitch", "roll"])
    return r(out, "std_deg", "mean_speed", "median_speed", "pct_fixation")


@register("saccade_agreement", "J7", with_tables("fx_angle", EVENTS + """, a AS (SELECT DISTINCT a.model, b.model AS other, a.session, a.onset
 FROM ev a JOIN ev b ON a.session = b.session AND abs(a.onset - b.onset) <= 3)
SELECT p.model, q.model AS other, count(a.onset) AS matched FROM (SELECT DISTINCT model FROM ev) p CROSS JOIN (SELECT DISTINCT model FROM ev) q
LEFT JOIN a ON a.model = p.model AND a.other = q.model GROUP BY 1, 2"""))
def saccade_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return B.saccade_agreement(events(spark, sf))


CONSENSUS = EVENTS + """, co AS (SELECT a.session, a.onset, count(DISTINCT b.model) AS n_agree FROM (SELECT DISTINCT session, onset FROM ev) a
 JOIN ev b ON a.session = b.session AND abs(a.onset - b.onset) <= 3 GROUP BY 1, 2 HAVING count(DISTINCT b.model) >= 2)"""


@register("saccade_consensus", "W8", with_tables("fx_angle", CONSENSUS + " SELECT session, onset, n_agree FROM co"))
def saccade_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return B.saccade_consensus(events(spark, sf), 3)


@register("consensus_share", "W8", with_tables("fx_angle", CONSENSUS + """, f AS (SELECT model, EXISTS (SELECT 1 FROM co
 WHERE co.session = ev.session AND abs(co.onset - ev.onset) <= 3) AS i FROM ev)
SELECT m.model, count(f.i) AS total, coalesce(count_if(f.i), 0)::BIGINT AS in_consensus, (count(f.i) - coalesce(count_if(f.i), 0))::BIGINT AS "unique",
 round(coalesce(100 * count_if(f.i) / nullif(count(f.i), 0), 0), 6) AS agreement_pct
FROM (SELECT DISTINCT model FROM fx_angle UNION SELECT 'still') m LEFT JOIN f ON f.model = m.model GROUP BY 1"""))
def consensus_share(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    models = [m.model for m in X.angles(spark, sf).select("model").distinct().collect()]
    return r(B.consensus_share(e, B.saccade_consensus(e, 3), models=[*models, "still"]), "agreement_pct")


@register("saccade_average", "W9 J10", with_tables("fx_angle", EVENTS + """, ends AS (SELECT model, session, min(frame) AS a, max(frame) AS z
 FROM fx_angle GROUP BY 1, 2),
w AS (SELECT ev.model, o AS "offset", CASE WHEN peak > 0 THEN t.yaw - s.yaw ELSE s.yaw - t.yaw END AS d FROM ev
 JOIN ends USING (model, session) JOIN fx_angle s ON s.model = ev.model AND s.session = ev.session AND s.frame = ev.onset,
 range(-10, 30) r(o) JOIN fx_angle t ON t.model = ev.model AND t.session = ev.session AND t.frame = ev.onset + o
 WHERE ev.onset - 10 >= a AND ev.onset + 29 <= z)
SELECT model, "offset", round(avg(d), 6) + 0.0::DOUBLE AS mean, round(stddev_pop(d) / sqrt(count(*)), 6) AS sem, count(*) AS n
FROM w GROUP BY 1, 2"""))
def saccade_average(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.saccade_average(events(spark, sf), X.angles(spark, sf), 10, 30), "mean", "sem")


def _with_model(df: DataFrame) -> DataFrame:
    return df.withColumn("model", F.lit("m0"))


@register("egocentric", "M15", with_tables("fx_world", "pv AS (SELECT session, frame, " + _pivot(X.KEYPOINTS) + """
 FROM fx_world GROUP BY 1, 2), q AS (SELECT w.session, w.frame, keypoint, X - nose_X AS cx, Y - nose_Y AS cy, Z - nose_Z AS cz,
 pawL_X - pawR_X AS fx, pawL_Y - pawR_Y AS fy FROM fx_world w JOIN pv ON w.session = pv.session AND w.frame = pv.frame),
n AS (SELECT *, sqrt(fx * fx + fy * fy) AS nn FROM q)
SELECT session, frame, keypoint,
 round(CASE WHEN nn < 1e-8 THEN cx ELSE fx / nullif(nn, 0) * cx + fy / nullif(nn, 0) * cy END, 6) + 0.0::DOUBLE AS X,
 round(CASE WHEN nn < 1e-8 THEN cy ELSE fx / nullif(nn, 0) * cy - fy / nullif(nn, 0) * cx END, 6) + 0.0::DOUBLE AS Y,
 round(cz, 6) + 0.0::DOUBLE AS Z FROM n"""))
def egocentric(spark: SparkSession, sf: str) -> DataFrame:
    out = B.egocentric(X.world(spark, sf), "nose", "pawL", "pawR", ("session", "frame"))
    return r(out.select("session", "frame", "keypoint", "X", "Y", "Z"), "X", "Y", "Z")


_PAWS = [f"{p}_{a}" for p in ("pawL", "pawR") for a in "XYZ"]
_STEP = "(1.0::DOUBLE / 60)"


@register("pose_features", "M16", with_tables("fx_world", "pv AS (SELECT session, frame, " + _pivot(["pawL", "pawR"]) +
          " FROM fx_world GROUP BY 1, 2), v AS (SELECT *, " + ", ".join(
              f"coalesce(({c} - lag({c}) OVER w) / {_STEP}, 0) AS v_{c}" for c in _PAWS) +
          " FROM pv WINDOW w AS (PARTITION BY session ORDER BY frame)), a AS (SELECT *, " + ", ".join(
              f"coalesce((v_{c} - lag(v_{c}) OVER w) / {_STEP}, 0) AS a_{c}" for c in _PAWS) +
          " FROM v WINDOW w AS (PARTITION BY session ORDER BY frame)) SELECT session, frame, " + ", ".join(
              f"round(v_{p}_{a}, 6) + 0.0::DOUBLE AS {p}_v{a.lower()}" for p in ("pawL", "pawR") for a in "XYZ") + ", " +
          ", ".join(f"round(sqrt(v_{p}_X*v_{p}_X + v_{p}_Y*v_{p}_Y + v_{p}_Z*v_{p}_Z), 6) AS {p}_speed, "
                    f"round(sqrt(a_{p}_X*a_{p}_X + a_{p}_Y*a_{p}_Y + a_{p}_Z*a_{p}_Z), 6) AS {p}_acc_mag"
                    for p in ("pawL", "pawR")) +
          ", round(sqrt(power(pawL_X - pawR_X, 2) + power(pawL_Y - pawR_Y, 2) + power(pawL_Z - pawR_Z, 2)), 6) AS paw_dist FROM a"))
def pose_features(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.pose_features(X.world(spark, sf), keys=["session"]), *B.FEATURES)


_RIGID = "pv AS (SELECT model, session, frame, " + _pivot(X.HEAD) + " FROM fx_head GROUP BY 1, 2, 3),\nrd AS (" + \
    " UNION ALL ".join(
        f"SELECT model, session, frame, '{label}' AS pair, 1000 * sqrt(" + " + ".join(
            f"power({a}_{c} - {b}_{c}, 2)" for c in "XYZ") + ") AS d FROM pv" for a, b, label in B.RIGID_PAIRS) + ")"


@register("rigid_distances", "A24", with_tables("fx_head", _RIGID + """
SELECT model, session, pair, count(d) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS min, round(max(d), 6) AS max
FROM rd GROUP BY 1, 2, 3"""))
def rigid_distances(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("distance_mm")
    return r(B.rigid_distances(X.heads(spark, sf)).groupBy("model", "session", "pair").agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max")), "mean", "min", "max")


@register("rigid_variation", "A25", with_tables("fx_head", _RIGID + """
SELECT model, pair, session, count(d) AS n, round(avg(d), 6) AS mean_mm, round(stddev_samp(d), 6) AS std_mm,
 round(stddev_samp(d) / nullif(avg(d), 0) * 100, 6) AS cv FROM rd GROUP BY GROUPING SETS ((model, pair), (model, pair, session))
HAVING session IS NULL OR count(d) > 1"""))
def rigid_variation(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.rigid_variation(B.rigid_distances(X.heads(spark, sf))), "mean_mm", "std_mm", "cv")


@register("mean_rigid_variation", "A25", with_tables("fx_head", _RIGID + """, c AS (SELECT model, pair, session,
 stddev_samp(d) / nullif(avg(d), 0) * 100 AS cv FROM rd GROUP BY GROUPING SETS ((model, pair), (model, pair, session))
 HAVING session IS NULL OR count(d) > 1)
SELECT model, session, round(avg(cv), 6) AS mean_cv FROM c GROUP BY 1, 2"""))
def mean_rigid_variation(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.mean_variation(B.rigid_variation(B.rigid_distances(X.heads(spark, sf)))), "mean_cv")


def seeded_points(spark: SparkSession, sf: str) -> DataFrame:
    """The true points with a small shift per seed; seed 2 lacks pending orders."""
    w = X.world(spark, sf).selectExpr("*", "explode(array(0L, 1L, 2L)) AS seed")
    shift = ((F.col("ok") * 7 + F.col("kp") * 3 + F.col("seed") * 11) % 19 - 9) / 1000
    there = (F.col("seed") != 2) | (F.col("status") != "P")
    return w.select(F.lit("m0").alias("model"), "seed", "session", "frame", "keypoint", *[
        F.when(there, F.col(a) + shift * (i + 1)).alias(a) for i, a in enumerate("XYZ")])


SEEDED = """sp AS (SELECT 'm0' AS model, seed, session, frame, keypoint, X AS tX, Y AS tY, Z AS tZ,
 CASE WHEN seed <> 2 OR status <> 'P' THEN X + sh END AS X, CASE WHEN seed <> 2 OR status <> 'P' THEN Y + sh * 2 END AS Y,
 CASE WHEN seed <> 2 OR status <> 'P' THEN Z + sh * 3 END AS Z FROM
 (SELECT *, CAST((ok * 7 + kp * 3 + seed * 11) % 19 - 9 AS DOUBLE) / 1000 AS sh FROM fx_world,
  (SELECT unnest([0, 1, 2])::BIGINT AS seed)))"""


@register("error_3d", "A26", with_tables("fx_world", SEEDED + """, e AS (SELECT *, 1000 * sqrt(power(X - tX, 2) + power(Y - tY, 2) +
 power(Z - tZ, 2)) AS e FROM sp)
SELECT session, model, seed, round(avg(CASE WHEN keypoint = 'nose' THEN e END), 6) AS head_mm, round(avg(e), 6) AS all_mm,
 count(e) AS n_points FROM e GROUP BY 1, 2, 3"""))
def error_3d(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.error_3d(seeded_points(spark, sf), X.world(spark, sf), ["nose"]), "head_mm", "all_mm")


@register("seed_median_3d", "A35", with_tables("fx_world", SEEDED + """ SELECT model, session, frame, keypoint,
 round(quantile_cont(X, 0.5), 6) + 0.0::DOUBLE AS X, round(quantile_cont(Y, 0.5), 6) + 0.0::DOUBLE AS Y,
 round(quantile_cont(Z, 0.5), 6) + 0.0::DOUBLE AS Z FROM sp GROUP BY 1, 2, 3, 4 HAVING count(X) = 3"""))
def seed_median_3d(spark: SparkSession, sf: str) -> DataFrame:
    return r(B.seed_median_3d(seeded_points(spark, sf), 3, seeds=X.SEEDS), "X", "Y", "Z")
