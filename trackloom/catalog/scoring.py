"""Error tables, sweeps and comparisons of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.space import KEYS
from trackloom.operators import ensemble as E
from trackloom.operators import evaluate as V
from trackloom.operators.joins import labelled_only
from trackloom.session import many_rows
from trackloom.schema import rounded

GRID = [0.5 * i for i in range(16)]
SESSIONS = [f"bird.S{i}abcdefgh" for i in range(7)]  # the seven sessions of the derived tables


def r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


_PIXEL = """SELECT seed, session, view, frame, keypoint, sqrt(power(lx - x, 2) + power(ly - y, 2)) AS error FROM fx_label JOIN
 (SELECT seed, session, view, frame, keypoint, CASE WHEN status <> 'F' THEN x END AS x, y FROM fx_pred)
 USING (session, view, frame, keypoint)"""


def by_frame(*names: str) -> list[Column]:
    """Means of the columns, and means weighted by the frame, which a swap of frames changes."""
    return [f for n in names for f in (F.avg(n).alias(n), F.avg(F.col(n) * (F.col("frame") % 97)).alias(f"{n}_by_frame"))]


def by_frame_sql(*names: str) -> str:
    return ", ".join(f"round(avg({n}), 6) + 0.0::DOUBLE AS {n}, round(avg({n} * (frame % 97)), 6) + 0.0::DOUBLE AS {n}_by_frame" for n in names)


def with_by_frame(*names: str) -> list[str]:
    return [f"{n}{end}" for n in names for end in ("", "_by_frame")]


def pixel_errors(spark: SparkSession, sf: str) -> DataFrame:
    pred = X.predictions(spark, sf).withColumn("x", F.when(F.col("status") != "F", F.col("x")))
    lab = X.labels(spark, sf).select(*KEYS, "lx", "ly")
    out = V.pixel_error(lab, labelled_only(pred.select("seed", *KEYS, "x", "y"), lab))
    return out.select("seed", *KEYS, "error")


@register("pixel_error", "A3", with_tables("fx_label fx_pred", f"SELECT * REPLACE (round(error, 6) AS error) FROM ({_PIXEL})"))
def pixel_error(spark: SparkSession, sf: str) -> DataFrame:
    return r(pixel_errors(spark, sf), "error")


@register("pixel_error_totals", "A3", with_tables("fx_label fx_pred", f"""SELECT seed, session, view, keypoint, count(*) AS n, count(error) AS n_valid,
 {by_frame_sql("error")} FROM ({_PIXEL}) GROUP BY 1, 2, 3, 4"""))
def pixel_error_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and errors of each seed, session, view and keypoint."""
    out = pixel_errors(spark, sf).groupBy("seed", "session", "view", "keypoint").agg(
        F.count(F.lit(1)).alias("n"), F.count("error").alias("n_valid"), *by_frame("error"))
    return r(out, *with_by_frame("error"))


_TABLE = """s AS (SELECT session, view, frame, keypoint,
 (stddev_pop(x) + stddev_pop(y)) / 2 AS ens_std FROM fx_pred JOIN (SELECT DISTINCT session, view, frame, keypoint FROM fx_label)
 USING (session, view, frame, keypoint) GROUP BY ALL),
k AS (SELECT *, round(ens_std, 9) AS q FROM s),
p AS (SELECT session, view, frame, keypoint, ens_std,
 CAST(rank() OVER (PARTITION BY view ORDER BY q) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY view) AS std_rank,
 CAST(rank() OVER (PARTITION BY view, keypoint ORDER BY q) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY view, keypoint)
 AS std_rank_keypoint FROM k),
t AS (SELECT seed, session, view, frame, keypoint, sqrt(power(lx - x, 2) + power(ly - y, 2)) AS error, ens_std, std_rank, std_rank_keypoint,
 likelihood FROM fx_label JOIN fx_pred USING (session, view, frame, keypoint) JOIN p USING (session, view, frame, keypoint))
"""
_MEASURES = ("error", "ens_std", "std_rank", "std_rank_keypoint", "likelihood")


def measured(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf).select(*KEYS, "lx", "ly")
    pred = labelled_only(X.predictions(spark, sf).select("seed", *KEYS, "x", "y", "likelihood"), lab)
    errors = V.pixel_error(lab, pred)
    stds = E.ensemble_std(pred.join(many_rows(lab.select(*KEYS).distinct()), KEYS, "left_semi"))
    return V.error_table(errors.select("seed", *KEYS, "error", "likelihood"), stds)


@register("error_table", "A4 W12 A2", with_tables("fx_label fx_pred", _TABLE + "SELECT * REPLACE (" + ", ".join(
    f"round({m}, 6) AS {m}" for m in _MEASURES) + ") FROM t"))
def error_table(spark: SparkSession, sf: str) -> DataFrame:
    return r(measured(spark, sf), *_MEASURES)


@register("error_table_totals", "A4 W12 A2", with_tables("fx_label fx_pred", _TABLE + f"""SELECT seed, session, view, keypoint, count(*) AS n,
 {by_frame_sql(*_MEASURES)} FROM t GROUP BY 1, 2, 3, 4"""))
def error_table_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, errors, deviations and ranks of each seed, session, view and keypoint."""
    out = measured(spark, sf).groupBy("seed", "session", "view", "keypoint").agg(F.count(F.lit(1)).alias("n"), *by_frame(*_MEASURES))
    return r(out, *with_by_frame(*_MEASURES))


_GRID_SQL = "g AS (SELECT CAST(i AS BIGINT) AS i, i * CAST(0.5 AS DOUBLE) AS threshold FROM range(16) t(i))"


@register("threshold_sweep", "A5", with_tables("fx_sweep", _GRID_SQL + """, k AS (SELECT DISTINCT view, model FROM fx_sweep)
SELECT k.view, k.model, threshold, count(error) AS n_points, round(avg(error), 6) AS mean_error
FROM k CROSS JOIN g LEFT JOIN fx_sweep f ON f.view = k.view AND f.model = k.model AND ens_std > threshold
GROUP BY k.view, k.model, threshold"""))
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.threshold_sweep(X.sweep_rows(spark, sf), GRID), "mean_error")


@register("sweep_percentiles", "A6", with_tables("fx_sweep", _GRID_SQL + """, k AS (SELECT DISTINCT model FROM fx_sweep),
c AS (SELECT k.model, i, threshold, count(error) AS n
 FROM k CROSS JOIN g LEFT JOIN fx_sweep f ON f.model = k.model AND ens_std > threshold GROUP BY 1, 2, 3),
f AS (SELECT model, n AS n0 FROM c WHERE i = 0), s AS (SELECT unnest([95, 50, 5])::DOUBLE AS share),
q AS (SELECT *, row_number() OVER (PARTITION BY model, share ORDER BY round(abs(n - n0 * share / 100), 9), i) AS rn
 FROM c JOIN f USING (model), s)
SELECT model, share, threshold, CASE WHEN i = 15 THEN round(n / n0 * 100, 2) ELSE share END AS reported
FROM q WHERE rn = 1"""))
def sweep_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return V.sweep_percentiles(X.sweep_rows(spark, sf), GRID, [95, 50, 5])


@register("mean_se_curve", "A7", with_tables("fx_sweep", _GRID_SQL + """ SELECT model, threshold, count(error) AS n_points,
 round(avg(error), 6) AS mean_error, round(stddev_samp(error) / sqrt(count(error)), 6) AS se FROM fx_sweep, g
 WHERE ens_std > threshold GROUP BY 1, 2"""))
def mean_se_curve(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.mean_se_curve(X.sweep_rows(spark, sf), GRID), "mean_error", "se")


_ERR = """e AS (SELECT session, view, frame, keypoint, likelihood, seed, x, y, u, w, status,
 sqrt(power(x - u, 2) + power(y - w, 2)) AS error FROM fx_holes)"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return X.holes(spark, sf).withColumn("error", V.distance(F.col("x"), F.col("y"), F.col("u"), F.col("w")))


@register("error_stats", "A10", with_tables("fx_holes", _ERR + """, b AS (SELECT session, error FROM e WHERE error IS NOT NULL
 UNION ALL SELECT 'ALL', error FROM e WHERE error IS NOT NULL)
SELECT session, count(*) AS n, round(avg(error), 6) AS mean, round(stddev_pop(error), 6) AS std, round(max(error), 6) AS max,
 round(quantile_cont(error, 0.5), 6) AS median, round(quantile_cont(error, 0.75), 6) AS p75,
 round(quantile_cont(error, 0.9), 6) AS p90, round(quantile_cont(error, 0.95), 6) AS p95 FROM b GROUP BY 1"""))
def error_stats(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.error_stats(errors(spark, sf)), "mean", "std", "max", "median", "p75", "p90", "p95")


@register("error_by_cluster", "A11 J12", with_tables("fx_holes", _ERR + """, f AS (SELECT seed, session, frame, keypoint,
 avg(error) AS error, any_value(status) AS cluster FROM e GROUP BY 1, 2, 3, 4 HAVING avg(error) IS NOT NULL),
p AS (SELECT seed, keypoint, cluster, count(*) AS n_frames, quantile_cont(error, 0.5) AS median,
 quantile_cont(error, 0.25) AS q25, quantile_cont(error, 0.75) AS q75 FROM f GROUP BY 1, 2, 3),
m AS (SELECT seed, keypoint, cluster, session, quantile_cont(error, 0.5) AS m FROM f GROUP BY 1, 2, 3, 4),
s AS (SELECT seed, keypoint, cluster, avg(m) AS mean_session_median, stddev_samp(m) / sqrt(count(m)) AS sem,
 count(m) AS n_sessions FROM m GROUP BY 1, 2, 3)
SELECT 'm' || seed AS model, keypoint, cluster, n_frames, round(median, 6) AS median, round(q25, 6) AS q25,
 round(q75, 6) AS q75, round(mean_session_median, 6) AS mean_session_median, round(sem, 6) AS sem, n_sessions
FROM p JOIN s USING (seed, keypoint, cluster)"""))
def error_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    e = errors(spark, sf).withColumn("model", F.concat(F.lit("m"), "seed"))
    clusters = X.frames(spark, sf).select(
        F.explode(F.array(*[F.lit(f"m{i}") for i in range(3)])).alias("model"), "session", "frame",
        F.col("status").alias("cluster"))
    return r(V.error_by_cluster(e, clusters), "median", "q25", "q75", "mean_session_median", "sem")


@register("session_statistics", "A12", with_tables("fx_world", """a AS (SELECT session, keypoint, 'x' AS axis, X AS v FROM fx_world
 UNION ALL SELECT session, keypoint, 'y', Y FROM fx_world UNION ALL SELECT session, keypoint, 'z', Z FROM fx_world)
SELECT session, keypoint, axis, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
 round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS range, count(v) AS n_valid FROM a GROUP BY 1, 2, 3"""))
def session_statistics(spark: SparkSession, sf: str) -> DataFrame:
    long = V.melt_axes(X.world(spark, sf), ["session", "keypoint"])
    return r(V.session_statistics(long), "min", "max", "mean", "std", "range")


_KS = """st AS (SELECT session, keypoint, axis, count(value) AS n, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM fx_value
 GROUP BY 1, 2, 3 HAVING count(value) >= 100),
pr AS (SELECT a.keypoint, a.axis, a.session AS s1, b.session AS s2, a.n AS n1, b.n AS n2, abs(a.mean - b.mean) AS mean_diff,
 greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) AS ov, greatest(a.hi, b.hi) - least(a.lo, b.lo) AS tot
 FROM st a JOIN st b ON a.keypoint = b.keypoint AND a.axis = b.axis AND a.session < b.session),
vv AS (SELECT pr.keypoint, pr.axis, pr.s1, pr.s2, pr.n1, pr.n2, round(value, 9) AS v, session = pr.s1 AS first FROM pr JOIN fx_value f
 ON f.keypoint = pr.keypoint AND f.axis = pr.axis AND (session = pr.s1 OR session = pr.s2)),
cu AS (SELECT keypoint, axis, s1, s2, abs(CAST(count_if(first) OVER w AS DOUBLE) / n1 - CAST(count_if(NOT first) OVER w AS DOUBLE) / n2) AS d
 FROM vv WINDOW w AS (PARTITION BY keypoint, axis, s1, s2 ORDER BY v RANGE UNBOUNDED PRECEDING)),
ks AS (SELECT keypoint, axis, s1, s2, max(d) AS ks FROM cu GROUP BY 1, 2, 3, 4),
sd AS (SELECT keypoint, axis, s1 AS session1, s2 AS session2, ks, mean_diff,
 CASE WHEN tot > 0 THEN 100 * ov / tot ELSE 0 END AS overlap_pct,
 least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END *
  exp(-2.0::DOUBLE * k * k * ks * ks * n1 * n2 / (n1 + n2)))), 0), 1) AS p_value FROM ks JOIN pr USING (keypoint, axis, s1, s2))"""


@register("session_difference", "A13 J9", with_tables("fx_value", _KS + """
SELECT keypoint, axis, session1, session2, round(ks, 6) AS ks, round(p_value, 6) + 0.0::DOUBLE AS p_value,
 round(mean_diff, 6) AS mean_diff, round(overlap_pct, 6) AS overlap_pct FROM sd"""))
def session_difference(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.session_difference(X.values(spark, sf), SESSIONS), "ks", "p_value", "mean_diff", "overlap_pct")


@register("session_pairs", "J9", with_tables("fx_value", """st AS (SELECT session, keypoint, axis, count(value) AS n, avg(value) AS mean FROM fx_value
 GROUP BY 1, 2, 3 HAVING count(value) >= 100)
SELECT a.keypoint, a.axis, a.session AS session1, b.session AS session2, a.n AS n_valid1, b.n AS n_valid2,
 round(a.mean - b.mean, 6) AS diff FROM st a JOIN st b ON a.keypoint = b.keypoint AND a.axis = b.axis AND a.session < b.session"""))
def session_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = V.session_pairs(V.session_statistics(X.values(spark, sf)), SESSIONS)
    return pairs.select("keypoint", "axis", "session1", "session2", "n_valid1", "n_valid2",
                        rounded(F.col("mean1") - F.col("mean2")).alias("diff"))


@register("consistency_verdict", "A14", with_tables("fx_value", _KS + """
SELECT round(avg(ks), 6) AS mean_ks, round(avg(overlap_pct), 6) AS mean_overlap, count_if(ks > 0.3)::BIGINT AS n_high,
 CASE WHEN avg(ks) < 0.1 AND avg(overlap_pct) > 80 THEN 'CONSISTENT' WHEN avg(ks) < 0.2 AND avg(overlap_pct) > 60
 THEN 'MODERATE' ELSE 'LARGE' END AS verdict FROM sd"""))
def consistency_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.consistency_verdict(V.session_difference(X.values(spark, sf), SESSIONS)), "mean_ks", "mean_overlap")


@register("axis_consistency", "A14", with_tables("fx_value", _KS + """
SELECT axis, round(avg(ks), 6) AS mean_ks, round(avg(overlap_pct), 6) AS mean_overlap FROM sd GROUP BY 1"""))
def axis_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.axis_consistency(V.session_difference(X.values(spark, sf), SESSIONS)), "mean_ks", "mean_overlap")


@register("most_different_sessions", "A14", with_tables("fx_value", _KS + """
SELECT session1, session2, keypoint, axis, round(ks, 6) AS ks FROM sd WHERE ks > 0.3
ORDER BY round(ks, 9) DESC, session1, session2, keypoint, axis LIMIT 5"""))
def most_different_sessions(spark: SparkSession, sf: str) -> DataFrame:
    top = V.most_different(V.session_difference(X.values(spark, sf), SESSIONS))
    return r(top.select("session1", "session2", "keypoint", "axis", "ks"), "ks")


@register("range_ratio", "A14", with_tables("fx_value", """st AS (SELECT session, keypoint, axis, max(value) - min(value) AS rg FROM fx_value GROUP BY 1, 2, 3)
SELECT keypoint, axis, round(min(rg), 6) AS min_range, round(max(rg), 6) AS max_range,
 round(max(rg) / min(rg), 6) AS ratio FROM st GROUP BY 1, 2"""))
def range_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return r(V.range_ratio(V.session_statistics(X.values(spark, sf))), "min_range", "max_range", "ratio")


@register("reprojection_score", "A22", with_tables("fx_label fx_pred", """d AS (SELECT session, frame,
 CASE WHEN likelihood > 0.5 THEN sqrt(power(lx - x, 2) + power(ly - y, 2)) END AS d
 FROM fx_label JOIN fx_pred USING (session, view, frame, keypoint))
SELECT session, frame, round(avg(d), 6) AS score FROM d GROUP BY 1, 2"""))
def reprojection_score(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf).select(*KEYS, "lx", "ly")
    return r(V.reprojection_score(X.predictions(spark, sf), lab, 0.5), "score")


@register("global_reprojection_error", "A23", with_tables("fx_holes", """k AS (SELECT seed, session, frame, view, keypoint,
 (abs(x - u) + abs(y - w)) / 2 AS e FROM fx_holes), v AS (SELECT seed, session, frame, view, avg(e) AS e FROM k GROUP BY 1, 2, 3, 4)
SELECT seed, session, frame, round(avg(e), 9) AS error FROM v GROUP BY 1, 2, 3"""))
def global_reprojection_error(spark: SparkSession, sf: str) -> DataFrame:
    e = X.holes(spark, sf).withColumns({"dx": F.abs(F.col("x") - F.col("u")), "dy": F.abs(F.col("y") - F.col("w"))})
    return V.global_reprojection_error(e, ["seed", "session", "frame"]).withColumn("error", F.round("error", 9))


@register("throughput", "A37", with_tables("fx_timing", """t AS (SELECT *, CASE WHEN mode = 'train' THEN 1 / time_per_batch
 ELSE batch_size / time_per_batch END AS rate FROM fx_timing)
SELECT scenario, batch_size, count(*) AS n, round(avg(time_per_batch), 9) AS mean_time,
 round(stddev_samp(time_per_batch), 6) AS std_time, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate), 6) AS std_rate
FROM t GROUP BY 1, 2"""))
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    out = V.throughput(X.timings(spark, sf), ["scenario", "batch_size"])
    return r(out, "std_time", "mean_rate", "std_rate").withColumn("mean_time", F.round("mean_time", 9))
