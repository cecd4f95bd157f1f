"""Latent models and smoothing.

Queries with an SQL twin use a model given as numbers; those that fit a model have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import r
from trackloom.catalog.space import digest, digest_sql
from trackloom.operators import ensemble as E
from trackloom.operators import latent as M
from trackloom.operators import smooth as S
from trackloom.session import materialised

WX, WY = (0.5, 0.4, 0.3, 0.2), (0.1, 0.2, 0.3, 0.4)
ONE = M.LatentModel((tuple(v for p in zip(WX, WY) for v in p),), (320.0, 240.0) * 4, (4.0,))
AXES = M.LatentModel(tuple(tuple(1.0 if d == i else 0.0 for d in range(9)) for i in (0, 3, 7)), (0.4, 0.5, 0.6) * 3)
KEYS = ["seed", "session", "frame", "keypoint"]
_W = "CASE view WHEN 'v0' THEN {0} WHEN 'v1' THEN {1} WHEN 'v2' THEN {2} ELSE {3} END::DOUBLE"
WEIGHTED = f"wt AS (SELECT *, {_W.format(*WX)} AS wx, {_W.format(*WY)} AS wy FROM fx_holes)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return M.view_vectors(X.holes(spark, sf), X.VIEWS, KEYS)


@register("latent_transform", "M8", with_tables("fx_holes", WEIGHTED + """, z AS (SELECT seed, session, frame, keypoint,
 CASE WHEN count(x) = 4 THEN sum(wx * (x - 320) + wy * (y - 240)) END AS z FROM wt GROUP BY 1, 2, 3, 4),
e AS (SELECT t.session, t.view, t.keypoint, sqrt(power(x - (z * wx + 320), 2) + power(y - (z * wy + 240), 2)) AS error, z
 FROM wt t JOIN z USING (seed, session, frame, keypoint)) """ + digest_sql("e", ["session", "view", "keypoint"], ["error", "z"])))
def latent_transform(spark: SparkSession, sf: str) -> DataFrame:
    made = M.latent_inverse(M.latent_transform(vectors(spark, sf), "v", ONE), "z", ONE, "b")
    errors = M.view_errors(made.withColumn("zz", F.get("z", 0)), "v", "b", X.VIEWS, [*KEYS, "zz"])
    return digest(errors.withColumnRenamed("zz", "z"), ["session", "view", "keypoint"], ["error", "z"])


@register("nan_latent_transform", "M9", with_tables("fx_holes", WEIGHTED + """ SELECT seed, session, frame, keypoint,
 round(coalesce(sum(wx * (x - 320) + wy * (y - 240)) / nullif(sum(CASE WHEN x IS NOT NULL THEN wx * wx + wy * wy END), 0), 0) / 2, 6)
 + 0.0::DOUBLE AS z FROM wt GROUP BY 1, 2, 3, 4"""))
def nan_latent_transform(spark: SparkSession, sf: str) -> DataFrame:
    out = M.nan_latent_transform(vectors(spark, sf), "v", ONE, whiten=True)
    return r(out.select(*KEYS, F.get("z", 0).alias("z")), "z")


def ensembles(spark: SparkSession, sf: str) -> DataFrame:
    return E.ensemble(X.holes(spark, sf), "mean", ("session", "view", "frame", "keypoint"))


TRACK = ["session", "view", "keypoint"]


def ensemble_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """``ensembles`` with the rows of a track's time range in one place, for what smooths them."""
    rows = X.holes(spark, sf).select(*TRACK, "frame", "x", "y", "likelihood")
    return E.ensemble(S.ranged(rows, TRACK), "mean", (*TRACK, "frame", "_part"))


def written_ensembles(spark: SparkSession, sf: str) -> DataFrame:
    """For what reads the ensembles more than once: seeds are combined in one shuffle."""
    return materialised(ensembles(spark, sf).drop("n_seeds"), "ensemble")


def weighed(spark: SparkSession, sf: str) -> DataFrame:
    return M.view_vectors(ensembles(spark, sf), X.VIEWS, ["session", "frame", "keypoint"], v=("x", "y"),
                          var=("x_ens_var", "y_ens_var"))


FA = f"""en AS (SELECT session, view, frame, keypoint, avg(x) AS x, avg(y) AS y, var_pop(x) / avg(likelihood) + 1e-6::DOUBLE AS vx,
 var_pop(y) / avg(likelihood) + 1e-6::DOUBLE AS vy, {_W.format(*WX)} AS wx, {_W.format(*WY)} AS wy FROM fx_holes GROUP BY 1, 2, 3, 4),
la AS (SELECT session, frame, keypoint, CASE WHEN count(x) = 4 THEN 1 / sum(wx * wx / vx + wy * wy / vy) END AS b,
 CASE WHEN count(x) = 4 THEN sum(wx * (x - 320) / vx + wy * (y - 240) / vy) / sum(wx * wx / vx + wy * wy / vy) END AS z
 FROM en GROUP BY 1, 2, 3)"""


@register("fa_transform", "M10", with_tables("fx_holes", FA + """ SELECT session, frame, keypoint, round(z, 6) + 0.0::DOUBLE AS z,
 round(b, 6) AS b, round(z * 0.4 + 320, 6) AS x1, round(0.4::DOUBLE * 0.2::DOUBLE * b, 6) AS c23 FROM la"""))
def fa_transform(spark: SparkSession, sf: str) -> DataFrame:
    out = M.fa_transform(weighed(spark, sf), "v", "var", ONE)
    return r(out.select("session", "frame", "keypoint", F.get("z", 0).alias("z"), F.get("zcov", 0).alias("b"),
                        F.get("rebuilt", 2).alias("x1"), F.get("cov", 2 * 8 + 3).alias("c23")), "z", "b", "x1", "c23")


@register("mahalanobis", "M11", with_tables("fx_holes", FA + """, q AS (SELECT e.session, e.view, e.keypoint, z * wx + 320 AS x, z * wy + 240 AS y,
 wx * wx * b AS x_posterior_var, wy * wy * b AS y_posterior_var, wx * wy * b AS xy, e.x - (z * wx + 320) AS dx,
 e.y - (z * wy + 240) AS dy, wx * wx * b + vx AS sa, wy * wy * b + vy AS sb FROM en e JOIN la USING (session, frame, keypoint)),
m AS (SELECT *, CASE WHEN dx IS NOT NULL THEN sqrt(greatest((sb * dx * dx - 2 * xy * dx * dy + sa * dy * dy) / (sa * sb - xy * xy), 0)) END AS mahalanobis FROM q) """
          + digest_sql("m", ["session", "view", "keypoint"], ["mahalanobis", "x", "y", "x_posterior_var", "y_posterior_var"], 5)))
def mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    out = M.mahalanobis(weighed(spark, sf), "v", "var", ONE, X.VIEWS, ["session", "frame", "keypoint"])
    return digest(out, ["session", "view", "keypoint"], ["mahalanobis", "x", "y", "x_posterior_var", "y_posterior_var"], 5)


POSE = "pz AS (SELECT session, frame, " + ", ".join(
    f"max(CASE WHEN keypoint = '{k}' THEN {a} END) - {m}::DOUBLE AS {k}_{a}" for k in X.KEYPOINTS
    for a, m in zip("XYZ", (0.4, 0.5, 0.6))) + " FROM fx_world GROUP BY 1, 2), tt AS (SELECT *, " + " + ".join(
    f"{k}_{a} * {k}_{a}" for k in X.KEYPOINTS for a in "XYZ") + """ AS t FROM pz),
va AS (SELECT session, frame, 1 - (t - pawL_X * pawL_X) / (t + 1e-12::DOUBLE) AS vaf_1,
 1 - (t - (pawL_X * pawL_X + pawR_X * pawR_X)) / (t + 1e-12::DOUBLE) AS vaf_2,
 1 - (t - (pawL_X * pawL_X + pawR_X * pawR_X + nose_Y * nose_Y)) / (t + 1e-12::DOUBLE) AS vaf_3 FROM tt)"""


def vaf(spark: SparkSession, sf: str) -> DataFrame:
    poses = M.pose_vectors(X.world(spark, sf), X.KEYPOINTS, ["session", "frame"])
    return M.frame_vaf(poses, "v", AXES, (1, 2, 3))


@register("frame_vaf", "M17", with_tables("fx_world", POSE + """ SELECT session, frame, round(vaf_1, 6) + 0.0::DOUBLE AS vaf_1,
 round(vaf_2, 6) + 0.0::DOUBLE AS vaf_2, round(vaf_3, 6) + 0.0::DOUBLE AS vaf_3 FROM va"""))
def frame_vaf(spark: SparkSession, sf: str) -> DataFrame:
    return r(vaf(spark, sf).drop("v"), "vaf_1", "vaf_2", "vaf_3")


@register("worst_rebuilt", "T3", with_tables("fx_world", POSE + """ SELECT session, frame, round(1 - vaf_3, 6) + 0.0::DOUBLE AS score FROM va
 ORDER BY round(1 - vaf_3, 9) DESC, session, frame LIMIT 50"""))
def worst_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    return r(M.worst_rebuilt(vaf(spark, sf), 3, 50), "score")


@register("singular_spectrum", "A34 W13")
def singular_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return M.singular_spectrum(M.pose_vectors(X.world(spark, sf), X.KEYPOINTS, ["session", "frame"]), "v", 9)


@register("spectrum_total", "A34", with_tables("fx_world", "pz AS (SELECT session, frame, " + ", ".join(
    f"max(CASE WHEN keypoint = '{k}' THEN {a} END) AS {k}_{a}" for k in X.KEYPOINTS for a in "XYZ")
    + " FROM fx_world GROUP BY 1, 2) SELECT 9::BIGINT AS components, round((" + " + ".join(
    f"var_pop({k}_{a})" for k in X.KEYPOINTS for a in "XYZ") + ") * count(*), 4) AS total, 100.0::DOUBLE AS share FROM pz"))
def spectrum_total(spark: SparkSession, sf: str) -> DataFrame:
    """The squared singular values add up to the total sum of squares."""
    return singular_spectrum(spark, sf).agg(
        F.count(F.lit(1)).alias("components"), F.round(F.sum(F.pow("singular_value", 2)), 4).alias("total"),
        F.round(F.max("cumulative"), 6).alias("share"))


@register("cumulative_share", "W13", with_tables("fx_timing", """c AS (SELECT batch_size // 8 AS component, count(*) AS n FROM fx_timing GROUP BY 1),
s AS (SELECT component, 100 * n / sum(n) OVER () AS share FROM c)
SELECT component, round(share, 6) AS share, round(sum(share) OVER (ORDER BY component), 6) AS cumulative FROM s"""))
def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.tracks import cumulative_share as running

    c = X.timings(spark, sf).groupBy(F.expr("batch_size div 8").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return r(running(c.select("component", (100 * F.col("n") / total).alias("share")), []), "share", "cumulative")


@register("pca_denoise", "M19 M8")
def pca_denoise(spark: SparkSession, sf: str) -> DataFrame:
    out = M.pca_denoise(X.holes(spark, sf), X.VIEWS, KEYS, 3)
    return digest(out, ["session", "view", "keypoint"], ["x", "y", "error"], 3)


@register("smooth_static", "M21", with_tables("fx_holes", """en AS (SELECT session, view, frame, keypoint, avg(x) AS x, avg(y) AS y,
 greatest(var_pop(x) / avg(likelihood), 1e-6) AS vx, greatest(var_pop(y) / avg(likelihood), 1e-6) AS vy FROM fx_holes GROUP BY 1, 2, 3, 4),
t AS (SELECT session, view, keypoint, sum(x / vx) / sum(CASE WHEN x IS NOT NULL THEN 1 / vx END) AS x,
 sum(y / vy) / sum(CASE WHEN y IS NOT NULL THEN 1 / vy END) AS y, 1 / sum(CASE WHEN x IS NOT NULL THEN 1 / vx END) AS px,
 1 / sum(CASE WHEN y IS NOT NULL THEN 1 / vy END) AS py FROM en GROUP BY 1, 2, 3)
SELECT session, view, keypoint, (SELECT count(*) FROM en e WHERE e.session = t.session AND e.view = t.view AND
 e.keypoint = t.keypoint) AS n, round(x, 5) AS x_low, round(x, 5) AS x_high, round(y, 5) AS y_low, round(y, 5) AS y_high,
 round(px, 8) AS px, round(py, 8) AS py FROM t"""))
def smooth_static(spark: SparkSession, sf: str) -> DataFrame:
    """Without process noise every frame gets the variance-weighted mean of its track."""
    out = S.smooth_single_view(ensemble_tracks(spark, sf), 0.0)
    return out.groupBy("session", "view", "keypoint").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 5).alias("x_low"), F.round(F.max("x"), 5).alias("x_high"),
        F.round(F.min("y"), 5).alias("y_low"), F.round(F.max("y"), 5).alias("y_high"),
        F.round(F.max("x_posterior_var"), 8).alias("px"), F.round(F.max("y_posterior_var"), 8).alias("py"))


@register("smooth_single_view", "M21")
def smooth_single_view(spark: SparkSession, sf: str) -> DataFrame:
    out = S.smooth_single_view(ensemble_tracks(spark, sf), 25.0)
    return digest(out, ["session", "view", "keypoint"], ["x", "y", "x_posterior_var", "y_posterior_var"], 3)


@register("smooth_multi_view", "M22 M19")
def smooth_multi_view(spark: SparkSession, sf: str) -> DataFrame:
    e = written_ensembles(spark, sf)
    model = M.fit_pca(M.view_vectors(e, X.VIEWS, ["session", "frame", "keypoint"]), "v", 8, 3, missing=True)
    out = S.smooth_multi_view(e, model, X.VIEWS, 100.0)
    return digest(out, ["session", "view", "keypoint"], ["x", "y", "x_posterior_var", "y_posterior_var", "x_ens_median", "y_ens_median",
                                                         "x_ens_var", "y_ens_var", "likelihood"], 3)


CANDIDATES = (0.25, 4.0, 64.0)
#: A filter that goes through each track frame by frame, x and y by themselves: state and observation share a struct.
FILTER = """en AS (SELECT session, view, frame, keypoint, avg(x) AS x, avg(y) AS y, greatest(var_pop(x) / avg(likelihood), 1e-6) AS vx,
 greatest(var_pop(y) / avg(likelihood), 1e-6) AS vy FROM fx_holes GROUP BY 1, 2, 3, 4),
ax AS (SELECT session, view, keypoint, frame, 'x' AS axis, x AS v, vx AS r FROM en UNION ALL SELECT session, view, keypoint, frame, 'y', y, vy FROM en),
tr AS (SELECT session, view, keypoint, axis, list({'v': v, 'r': r, 'm': 0.0::DOUBLE, 'p': 1e12::DOUBLE, 'l': 0.0::DOUBLE} ORDER BY frame) AS o
 FROM ax GROUP BY 1, 2, 3, 4),
sc AS (SELECT session, view, keypoint, q AS process_variance, len(o) AS n,
 list_reduce(list_prepend({'v': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'p': 1e12::DOUBLE, 'l': 0.0::DOUBLE}, o), lambda s, t:
  CASE WHEN t.v IS NULL OR t.r IS NULL THEN {'v': t.v, 'r': t.r, 'm': s.m, 'p': s.p + q, 'l': s.l}
  ELSE {'v': t.v, 'r': t.r, 'm': s.m + (s.p + q) / (s.p + q + t.r) * (t.v - s.m), 'p': (s.p + q) * t.r / (s.p + q + t.r),
   'l': s.l - (ln(2 * pi() * (s.p + q + t.r)) + (t.v - s.m) * (t.v - s.m) / (s.p + q + t.r)) / 2} END).l AS l
 FROM tr, (VALUES """ + ", ".join(f"({c}::DOUBLE)" for c in CANDIDATES) + """) c(q)),
ll AS (SELECT session, view, keypoint, process_variance, n::BIGINT AS n, sum(l) AS log_likelihood FROM sc GROUP BY 1, 2, 3, 4, 5)"""


@register("smoothing_likelihood", "M21", with_tables("fx_holes", FILTER + """ SELECT session, view, keypoint, process_variance,
 round(log_likelihood, 3) AS log_likelihood, n FROM ll"""))
def smoothing_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """How likely each track is under each process variance, all candidates in one pass."""
    out = S.track_likelihood(S.single_view_information(ensemble_tracks(spark, sf), TRACK), TRACK, 2, CANDIDATES)
    return out.withColumn("log_likelihood", F.round("log_likelihood", 3))


@register("smoothing_choice", "M21", with_tables("fx_holes", FILTER + """, su AS (SELECT keypoint, process_variance, sum(log_likelihood) AS s FROM ll GROUP BY 1, 2)
 SELECT keypoint, arg_max(process_variance, round(s, 6)) AS process_variance, round(max(s), 2) AS log_likelihood FROM su GROUP BY 1"""))
def smoothing_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The most likely process variance of each keypoint over all its tracks."""
    out = S.track_likelihood(S.single_view_information(ensemble_tracks(spark, sf), TRACK), TRACK, 2, CANDIDATES)
    return S.best_variance(out, ["keypoint"]).withColumn("log_likelihood", F.round("log_likelihood", 2))


@register("smooth_tuned_single_view", "M21")
def smooth_tuned_single_view(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks smoothed with the process variance most likely for their keypoint."""
    out = S.smooth_single_view(S.tuned(written_ensembles(spark, sf)), "process_variance")
    return digest(out, ["session", "view", "keypoint"], ["x", "y", "x_posterior_var", "y_posterior_var"], 3)


@register("smooth_tuned_multi_view", "M22")
def smooth_tuned_multi_view(spark: SparkSession, sf: str) -> DataFrame:
    e = written_ensembles(spark, sf)
    model = M.fit_pca(M.view_vectors(e, X.VIEWS, ["session", "frame", "keypoint"]), "v", 8, 3, missing=True)
    out = S.smooth_multi_view(S.tuned_multi_view(e, model, X.VIEWS), model, X.VIEWS, "process_variance")
    return digest(out, ["session", "view", "keypoint"], ["x", "y", "x_posterior_var", "y_posterior_var"], 3)


LIMIT = 40.0


def _inflation_sql() -> str:
    """Frames solved again and again: of the view farthest off, the first of equals, both variances are doubled."""
    views = range(4)
    one = lambda k, c, t: f"max(CASE WHEN view = 'v{k}' THEN {c} END) AS {t}{k}"
    start = ", ".join(f"{one(k, 'x - 320', 'x')}, {one(k, 'y - 240', 'y')}, {one(k, 'vx', 'a')}, {one(k, 'vy', 'b')}" for k in views)
    info = " + ".join(f"power({WX[k]}::DOUBLE, 2) / (a{k} + 1e-6) + power({WY[k]}::DOUBLE, 2) / (b{k} + 1e-6)" for k in views)
    told = " + ".join(f"{WX[k]}::DOUBLE * x{k} / (a{k} + 1e-6) + {WY[k]}::DOUBLE * y{k} / (b{k} + 1e-6)" for k in views)
    solved = f"SELECT *, 1 / ({info}) AS b, ({told}) / ({info}) AS z"

    def far(k: int) -> str:
        p, q = f"{WX[k]}::DOUBLE", f"{WY[k]}::DOUBLE"
        dx, dy, sa, sb, xy = f"(x{k} - z * {p})", f"(y{k} - z * {q})", f"({p} * {p} * b + a{k} + 1e-6)", f"({q} * {q} * b + b{k} + 1e-6)", f"({p} * {q} * b)"
        return f"sqrt(greatest(({sb} * {dx} * {dx} - 2 * {xy} * {dx} * {dy} + {sa} * {dy} * {dy}) / ({sa} * {sb} - {xy} * {xy}), 0))"

    dist = ", ".join(f"{far(k)} AS d{k}" for k in views)
    top = "greatest(d0, d1, d2, d3)"
    worst = f"CASE {top} WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END"
    grown = ", ".join(f"x{k}, y{k}, CASE WHEN worst = {k} THEN 2 * a{k} ELSE a{k} END, CASE WHEN worst = {k} THEN 2 * b{k} ELSE b{k} END" for k in views)
    grown += "".join(f", CASE WHEN worst = {k} THEN t{k} + 1 ELSE t{k} END" for k in views)
    return f"""en AS (SELECT session, view, frame, keypoint, avg(x) AS x, avg(y) AS y, var_pop(x) / avg(likelihood) AS vx, var_pop(y) / avg(likelihood) AS vy
 FROM fx_holes GROUP BY 1, 2, 3, 4),
st AS (SELECT session, frame, keypoint, {start}, {", ".join(f"0 AS t{k}" for k in views)} FROM en GROUP BY 1, 2, 3 HAVING count(x) = 4),
rc AS (WITH RECURSIVE go AS (SELECT * FROM st UNION ALL
 SELECT session, frame, keypoint, {grown} FROM (SELECT *, {worst} AS worst FROM (SELECT *, {dist} FROM ({solved} FROM go)) WHERE {top} > {LIMIT}))
 SELECT * FROM go),
la AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY session, frame, keypoint ORDER BY t0 + t1 + t2 + t3 DESC) = 1)"""


@register("inflated_variances", "M22 M11", with_tables("fx_holes", _inflation_sql() + """ SELECT session, keypoint, count(*) AS n,
 count(*) FILTER (t0 + t1 + t2 + t3 > 0) AS inflated, sum(t0)::BIGINT AS t0, sum(t1)::BIGINT AS t1, sum(t2)::BIGINT AS t2, sum(t3)::BIGINT AS t3,
 round(sum(ln(a0 * b3)), 4) AS logs FROM la GROUP BY 1, 2"""))
def inflated_variances(spark: SparkSession, sf: str) -> DataFrame:
    """How often each view's variance was doubled until no view contradicted the others, over the frames that all views have."""
    whole = weighed(spark, sf).where(M.complete("v") & M.complete("var"))
    out = M.inflate_variances(whole, "v", "var", ONE, LIMIT)
    sums = [F.sum(F.get("times", k)).cast("long").alias(f"t{k}") for k in range(4)]
    return out.groupBy("session", "keypoint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.exists("times", lambda t: t > 0)).alias("inflated"), *sums,
        F.round(F.sum(F.log(F.get("var", 0) * F.get("var", 7))), 4).alias("logs"))


@register("factor_fit", "M10", with_tables("fx_holes", """w AS (SELECT seed, session, frame, keypoint, count(x) AS n FROM fx_holes GROUP BY 1, 2, 3, 4)
SELECT 8::BIGINT AS entries, 3::BIGINT AS factors, true AS rising, true AS beats_start, count(*) FILTER (n > 0) AS rows FROM w"""))
def factor_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A factor model of the views fitted with missing entries: the likelihood never falls."""
    vec = materialised(vectors(spark, sf).select("v"), "vectors")  # without keys, which no step asks for
    model, history = M.fit_factors(vec, "v", 8, 3, rounds=15)
    rising = all(b >= a - 1e-9 * abs(a) for a, b in zip(history, history[1:]))
    return vec.where(F.exists("v", lambda x: x.isNotNull())).agg(
        F.lit(len(model.mean)).cast("long").alias("entries"), F.lit(len(model.components)).cast("long").alias("factors"),
        F.lit(rising).alias("rising"), F.lit(history[-1] > history[0]).alias("beats_start"), F.count(F.lit(1)).alias("rows"))
