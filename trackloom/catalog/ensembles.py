"""Seed ensembles and variance scores over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.space import KEYS
from trackloom.operators import ensemble as E
from trackloom.operators import select as P
from trackloom.operators.joins import labelled_only
from trackloom.schema import rounded


def _ensemble_sql(table: str, middle: str) -> str:
    return with_tables(table, f"""SELECT session, view, frame, keypoint, round({middle.format('x')}, 6) AS x,
 round({middle.format('y')}, 6) AS y, round({middle.format('likelihood')}, 6) AS likelihood,
 round(var_pop(x) / avg(likelihood), 6) AS x_ens_var, round(var_pop(y) / avg(likelihood), 6) AS y_ens_var,
 count(x) AS n_seeds FROM {table} GROUP BY ALL""")


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


ENS = ["x", "y", "likelihood", "x_ens_var", "y_ens_var"]


@register("ensemble_median", "A1", _ensemble_sql("fx_holes", "quantile_cont({}, 0.5)"))
def ensemble_median(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.ensemble(X.holes(spark, sf), "median", seeds=X.SEEDS), ENS).drop("model")


@register("ensemble_mean", "A1", _ensemble_sql("fx_pred", "avg({})"))
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.ensemble(X.predictions(spark, sf), "mean"), ENS).drop("model")


@register("ensemble_std", "A2", with_tables("fx_pred", """SELECT session, view, frame, keypoint,
 round((stddev_pop(x) + stddev_pop(y)) / 2, 6) AS ens_std FROM fx_pred GROUP BY ALL"""))
def ensemble_std(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.ensemble_std(X.predictions(spark, sf)), ["ens_std"])


VARS = """e AS (SELECT session, view, frame, keypoint, var_pop(x) / avg(likelihood) AS vx, var_pop(y) / avg(likelihood) AS vy,
 any_value(status) AS status FROM fx_holes GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN status = 'P' THEN vx / 2 ELSE vx END AS px, CASE WHEN status = 'P' THEN vy / 2 ELSE vy END AS py FROM e)"""
SCORE = ", sc AS (SELECT session, frame, CASE WHEN count(px + py) = count(*) THEN max(greatest(px, py)) END AS score" \
        " FROM p GROUP BY 1, 2)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = E.ensemble(X.holes(spark, sf), "mean", [*KEYS, "status"])
    half = F.col("status") == "P"
    e = e.withColumns({f"{c}_posterior_var": F.when(half, F.col(f"{c}_ens_var") / 2) for c in "xy"})
    return E.frame_variance_score(e, posterior=True)


@register("frame_variance_score", "A19", with_tables("fx_holes", VARS + SCORE + """
SELECT session, frame, round(score, 6) AS score FROM sc"""))
def frame_variance_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scores(spark, sf), ["score"])


@register("likelihood_filter", "A20", with_tables("fx_pred", """f AS (SELECT session, view, frame, keypoint, seed,
 CASE WHEN keypoint = 'nose' AND view <> 'v0' THEN likelihood / 3 ELSE likelihood END AS lik FROM fx_pred),
ever AS (SELECT session, view, keypoint, max(lik) >= 0.5 AS e FROM f GROUP BY 1, 2, 3),
act AS (SELECT session, keypoint FROM ever GROUP BY 1, 2 HAVING count_if(e) >= 2),
c AS (SELECT session, frame, keypoint, count(DISTINCT CASE WHEN lik > 0.5 THEN view END) AS n FROM f GROUP BY 1, 2, 3)
SELECT session, frame FROM c JOIN act USING (session, keypoint) GROUP BY 1, 2 HAVING bool_and(n >= 2)"""))
def likelihood_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predictions(spark, sf)
    weak = (F.col("keypoint") == "nose") & (F.col("view") != "v0")
    p = p.withColumn("likelihood", F.when(weak, F.col("likelihood") / 3).otherwise(F.col("likelihood")))
    return E.likelihood_filter(p, 0.5, 2).select("session", "frame").distinct()


@register("top_low_variance", "T1", with_tables("fx_holes", VARS + SCORE + """, r AS (SELECT *, row_number() OVER
 (PARTITION BY session ORDER BY round(score, 9) ASC NULLS LAST, frame) AS rn FROM sc)
SELECT session, frame, round(score, 6) AS score FROM r WHERE rn <= 200"""))
def top_low_variance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(P.top_low_variance(scores(spark, sf), 200, 50), ["score"])


@register("remove_worst_share", "T2", with_tables("fx_holes", VARS + SCORE + """, z AS (SELECT session, frame,
 CASE WHEN score IS NULL THEN NULL ELSE round(score, 1) END AS score FROM sc),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, session, frame) AS rn, count(*) OVER () AS n FROM z)
SELECT session, frame, score FROM r WHERE rn > round_even(n * 0.15::DOUBLE, 0)"""))
def remove_worst_share(spark: SparkSession, sf: str) -> DataFrame:
    return P.remove_worst_share(scores(spark, sf).withColumn("score", F.round("score", 1)), 0.15)


@register("error_summary", "A8 A3", with_tables("fx_label fx_holes", """e AS (SELECT session, view, frame, keypoint,
 quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM fx_holes GROUP BY 1, 2, 3, 4),
d AS (SELECT view, keypoint, sqrt(power(lx - x, 2) + power(ly - y, 2)) AS error FROM fx_label JOIN e
 USING (session, view, frame, keypoint))
SELECT view, keypoint, count(error) AS n, round(avg(error), 6) AS mean, round(stddev_samp(error), 6) AS std,
 round(min(error), 6) AS min, round(max(error), 6) AS max,
 round(avg(error) - 1.96::DOUBLE * stddev_samp(error) / sqrt(count(error)), 6) AS ci_low,
 round(avg(error) + 1.96::DOUBLE * stddev_samp(error) / sqrt(count(error)), 6) AS ci_high FROM d GROUP BY 1, 2"""))
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators import evaluate as V

    lab = X.labels(spark, sf).select(*KEYS, "lx", "ly")
    # The label join comes first: only labelled frames are combined over seeds.
    pred = labelled_only(X.holes(spark, sf), lab)
    errors = V.pixel_error(lab, E.ensemble(pred, "median", seeds=X.SEEDS))
    out = V.error_summary(errors, ["view", "keypoint"])
    return _rounded(out, ["mean", "std", "min", "max", "ci_low", "ci_high"])


@register("error_by_model_seed", "A8", with_tables("fx_label fx_pred", """d AS (SELECT 'm0' AS model, seed,
 sqrt(power(lx - x, 2) + power(ly - y, 2)) AS error FROM fx_label JOIN fx_pred USING (session, view, frame, keypoint))
SELECT model, seed, count(error) AS n, round(avg(error), 6) AS mean, round(stddev_samp(error), 6) AS std,
 round(min(error), 6) AS min, round(max(error), 6) AS max,
 round(avg(error) - 1.96::DOUBLE * stddev_samp(error) / sqrt(count(error)), 6) AS ci_low,
 round(avg(error) + 1.96::DOUBLE * stddev_samp(error) / sqrt(count(error)), 6) AS ci_high FROM d GROUP BY 1, 2"""))
def error_by_model_seed(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators import evaluate as V

    lab = X.labels(spark, sf).select(*KEYS, "lx", "ly")
    out = V.error_summary(V.pixel_error(lab, labelled_only(X.predictions(spark, sf), lab)))
    return _rounded(out, ["mean", "std", "min", "max", "ci_low", "ci_high"])


@register("group_coverage", "A39", with_tables("fx_holes", """SELECT model, session, count(*) AS rows, count(x + y) AS valid,
 count(DISTINCT view) AS views FROM fx_holes GROUP BY GROUPING SETS ((model, session), (model), ())"""))
def group_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.evaluate import coverage

    return coverage(X.holes(spark, sf))
