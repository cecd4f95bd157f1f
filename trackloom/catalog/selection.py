"""Seeded draws, quotas, splits and unions.

Seeded draws depend on a hash that SQL engines do not share; their sizes have an SQL twin, the draws themselves do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import by_frame, by_frame_sql, r, with_by_frame
from trackloom.catalog.space import KEYS
from trackloom.operators import select as P
from trackloom.schema import rounded


@register("random_frames", "T4")
def random_frames(spark: SparkSession, sf: str) -> DataFrame:
    """100 frames per session."""
    return P.random_frames(X.frames(spark, sf).select("session", "frame"), 100, 3)


@register("random_frame_counts", "T4", with_tables("fx_frame", """SELECT session, least(count(*), 100) AS n, true AS inside FROM fx_frame GROUP BY 1"""))
def random_frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The draw has the asked size and only frames that exist, each once."""
    drawn = random_frames(spark, sf).withColumn("_d", F.lit(True))
    there = X.frames(spark, sf).select("session", "frame").join(drawn, ["session", "frame"], "right")
    return there.groupBy("session").agg(F.count_distinct("frame").alias("n"), F.bool_and("_d").alias("inside"))


@register("random_frames_overall", "T4")
def random_frames_overall(spark: SparkSession, sf: str) -> DataFrame:
    return P.random_frames(X.frames(spark, sf).select("session", "frame"), 500, 3, per_session=False)


@register("balanced_allocation", "T6", with_tables("fx_frame", """s AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n
 FROM (SELECT DISTINCT session FROM fx_frame)), q AS (SELECT session, 100 // n + CASE WHEN i < 100 % n THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY prio, frame DESC) AS rn FROM fx_frame)
SELECT session, frame FROM r JOIN q USING (session) WHERE rn <= quota"""))
def balanced_allocation(spark: SparkSession, sf: str) -> DataFrame:
    f = X.frames(spark, sf)
    return P.balanced(f, 100, [F.col("prio"), F.col("frame").desc()]).select("session", "frame")


@register("train_val_split", "T7")
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return P.train_val_split(X.labels(spark, sf), 0.95, 0)


@register("train_val_counts", "T7", with_tables("fx_label", """f AS (SELECT DISTINCT session, frame FROM fx_label),
n AS (SELECT count(*) AS n FROM f) SELECT 'train' AS part, CAST(round_even(n * 0.95::DOUBLE, 0) AS BIGINT) AS n FROM n
 UNION ALL SELECT 'validation', n - CAST(round_even(n * 0.95::DOUBLE, 0) AS BIGINT) FROM n"""))
def train_val_counts(spark: SparkSession, sf: str) -> DataFrame:
    return train_val_split(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register("train_limited_counts", "T7", with_tables("fx_label", """f AS (SELECT DISTINCT session, frame FROM fx_label),
n AS (SELECT count(*) AS n FROM f) SELECT 'train' AS part, least(200, CAST(round_even(n * 0.9::DOUBLE, 0) AS BIGINT)) AS n FROM n
 UNION ALL SELECT 'validation', n - CAST(round_even(n * 0.9::DOUBLE, 0) AS BIGINT) FROM n"""))
def train_limited_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.train_val_split(X.labels(spark, sf), 0.9, 0, 200).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


PSEUDO = """ex AS (SELECT session, view, frame, keypoint, lx AS x, 'existing' AS origin FROM fx_label WHERE status <> 'P'),
ps AS (SELECT session, view, frame, keypoint, avg(x) AS x, 'pseudo' AS origin FROM fx_pred WHERE prio <= 2 GROUP BY 1, 2, 3, 4)"""


def existing_and_pseudo(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labels of settled orders, and the seed means of urgent and high-priority orders; the session names of the
    latter carry a suffix."""
    ex = X.labels(spark, sf).where("status <> 'P'").select(*KEYS, F.col("lx").alias("x"), F.lit("existing").alias("origin"))
    ps = X.predictions(spark, sf).where("prio <= 2").groupBy(*KEYS).agg(F.avg("x").alias("x")).select(
        F.concat("session", F.lit(".short")).alias("session"), "view", "frame", "keypoint", "x",
        F.lit("pseudo").alias("origin"))
    return ex, ps


@register("union_existing_pseudo", "U1 A38", with_tables("fx_label fx_pred", PSEUDO + """ SELECT session, view, frame, keypoint,
 round(coalesce(ex.x, ps.x), 6) + 0.0::DOUBLE AS x, coalesce(ex.origin, ps.origin) AS origin FROM ex FULL JOIN ps USING (session, view, frame, keypoint)"""))
def union_existing_pseudo(spark: SparkSession, sf: str) -> DataFrame:
    return r(P.union_first(*existing_and_pseudo(spark, sf), KEYS), "x")


@register("union_pseudo_totals", "U1", with_tables("fx_label fx_pred", PSEUDO + f""", u AS (SELECT session, view, frame, keypoint,
 coalesce(ex.x, ps.x) AS x, coalesce(ex.origin, ps.origin) AS origin FROM ex FULL JOIN ps USING (session, view, frame, keypoint))
SELECT session, view, keypoint, origin, count(*) AS n, {by_frame_sql("x")} FROM u GROUP BY 1, 2, 3, 4"""))
def union_pseudo_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and places that each session, view and keypoint has from existing and from pseudo labels."""
    both = P.union_first(*existing_and_pseudo(spark, sf), KEYS)
    out = both.groupBy("session", "view", "keypoint", "origin").agg(F.count(F.lit(1)).alias("n"), *by_frame("x"))
    return r(out, *with_by_frame("x"))


@register("dedupe_first", "A38", with_tables("fx_pred", """k AS (SELECT *, row_number() OVER (PARTITION BY session, view, frame, keypoint
 ORDER BY round(likelihood, 9) DESC, seed) AS rn FROM fx_pred)
SELECT session, view, frame, keypoint, seed, round(x, 6) AS x FROM k WHERE rn = 1"""))
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predictions(spark, sf).select(*KEYS, "seed", "x", (-F.round("likelihood", 9)).alias("rank"))
    return r(P.dedupe_first(p, KEYS, ["rank", "seed"]).drop("rank"), "x")


@register("common_keypoints", "U2", with_tables("fx_pred", """e AS (SELECT DISTINCT session, view, seed, keypoint FROM fx_pred
 WHERE NOT (keypoint = 'pawR' AND view = 'v3')), f AS (SELECT count(*) AS n FROM (SELECT DISTINCT session, view, seed FROM e)),
k AS (SELECT keypoint, count(*) AS c FROM e GROUP BY 1)
SELECT keypoint, CASE keypoint WHEN 'nose' THEN 1 WHEN 'pawL' THEN 3 END::BIGINT AS position FROM k, f WHERE c = n AND keypoint IN ('nose', 'tail', 'pawL', 'pawR')"""))
def common_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    e = X.predictions(spark, sf).where("NOT (keypoint = 'pawR' AND view = 'v3')")
    return P.common_keypoints(e, ["nose", "tail", "pawL", "pawR"], ["session", "view", "seed"])


@register("pool_models", "U3", with_tables("fx_feature", """SELECT model, session, count(*) AS n, round(avg(paw_dist), 6) AS paw_dist FROM fx_feature GROUP BY 1, 2"""))
def pool_models(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the models pooled into one table and told apart again."""
    f = X.features(spark, sf)
    pool = P.pooled([f.where(f"model = '{m}'") for m in ("m0", "m1")])
    return pool.groupBy("model", "session").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("paw_dist")).alias("paw_dist"))


@register("multi_source_frames", "U4", with_tables("fx_label fx_frame", """a AS (SELECT DISTINCT 'existing' AS data_type, session, frame FROM fx_label
 UNION ALL SELECT 'new_csv', session, frame FROM fx_frame WHERE prio = 2 UNION ALL SELECT 'pseudo_labeled', session, frame FROM fx_frame WHERE prio <= 3)
SELECT data_type, session, count(*) AS n, sum(frame)::BIGINT AS total FROM a GROUP BY 1, 2"""))
def multi_source_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = X.frames(spark, sf)
    parts = {"existing": X.labels(spark, sf).select("session", "frame").distinct(),
             "new_csv": f.where("prio = 2").select("session", "frame"),
             "pseudo_labeled": f.where("prio <= 3").select("session", "frame")}
    return P.tagged_union(parts).groupBy("data_type", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))
