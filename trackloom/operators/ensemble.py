"""Combining the seeds (or models) that predict the same point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.session import lookup

POINT_KEYS = ("model", "session", "view", "frame", "keypoint")


def median_of(values: Sequence[Column]) -> Column:
    """Median of a few columns, missing ones left out."""
    held = F.array_sort(F.array_compact(F.array(*values)))
    return F.aggregate(F.array(held), F.lit(None).cast("double"), lambda _, a: (
        F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2)


def seed_medians(pred: DataFrame, keys: Sequence[str], values: Sequence[str], seeds: Sequence[int] | None,
                 others: Sequence[Column] = ()) -> DataFrame:
    """Median of each value over the seeds of a key, and ``others`` aggregated along.

    With the list of seeds the values are laid side by side, which Spark aggregates in generated code; without it the
    exact percentile aggregate is used. A key has one row per seed.
    """
    if seeds is None:
        return pred.groupBy(*keys).agg(*[F.percentile(v, 0.5).alias(v) for v in values], *others)
    side = [F.max(F.when(F.col("seed") == s, F.col(v))).alias(f"_{v}_{i}") for v in values for i, s in enumerate(seeds)]
    wide = pred.where(F.col("seed").isin(*seeds)).groupBy(*keys).agg(*side, *others)
    made = {v: median_of([F.col(f"_{v}_{i}") for i in range(len(seeds))]) for v in values}
    return wide.withColumns(made).drop(*[f"_{v}_{i}" for v in values for i in range(len(seeds))])


def ensemble(pred: DataFrame, mode: str = "median", keys: Sequence[str] = POINT_KEYS, seeds: Sequence[int] | None = None
             ) -> DataFrame:
    """x, y, likelihood over seeds (mean or exact median) with confidence-weighted variances.

    x_ens_var = population variance over seeds / mean likelihood (y alike). NULL where no seed has a value. ``seeds``
    names the seeds to combine; with it the median is much faster.
    """
    chosen = pred if seeds is None else pred.where(F.col("seed").isin(*seeds))
    weight = F.nullif(F.avg("likelihood"), F.lit(0.0))
    spread = [(F.var_pop("x") / weight).alias("x_ens_var"), (F.var_pop("y") / weight).alias("y_ens_var"),
              F.count(F.col("x") + F.col("y")).alias("n_seeds")]
    values = ("x", "y", "likelihood")
    if mode == "mean":
        return chosen.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], *spread)
    if mode == "median":
        return seed_medians(chosen, keys, values, seeds, spread).select(
            *keys, *values, "x_ens_var", "y_ens_var", "n_seeds")
    raise ValueError(f"unknown ensemble mode {mode}")


def ensemble_std(pred: DataFrame, keys: Sequence[str] = ("session", "view", "frame", "keypoint")) -> DataFrame:
    """Mean of the population deviations of x and y over models."""
    return pred.groupBy(*keys).agg(((F.stddev_pop("x") + F.stddev_pop("y")) / 2).alias("ens_std"))


def frame_variance_score(ens: DataFrame, posterior: bool = False, keys: Sequence[str] = ("session", "frame")) -> DataFrame:
    """Largest variance over views, keypoints and both axes per frame.

    With ``posterior`` the smoothed variance is taken where there is one. NULL if any variance is missing.
    """
    def var(axis: str) -> Column:
        ens_var = F.col(f"{axis}_ens_var")
        return F.coalesce(F.col(f"{axis}_posterior_var"), ens_var) if posterior else ens_var

    known = F.count(var("x") + var("y")) == F.count(F.lit(1))
    return ens.groupBy(*keys).agg(F.when(known, F.max(F.greatest(var("x"), var("y")))).alias("score"))


def confident_frames(pred: DataFrame, threshold: float, min_views: int) -> DataFrame:
    """(session, frame) pairs in which every active keypoint has ``min_views`` views above the threshold.

    A keypoint is active in a session if at least ``min_views`` views ever reach the threshold for it; without any
    active keypoint all of them count.
    """
    ever = pred.groupBy("session", "view", "keypoint").agg((F.max("likelihood") >= threshold).alias("_e"))
    active = ever.groupBy("session", "keypoint").agg((F.count_if("_e") >= min_views).alias("_a"))
    per_session = active.groupBy("session").agg(F.count_if("_a").alias("_n"), F.count(F.lit(1)).alias("_all"))
    active = active.join(per_session, "session").select(
        "session", "keypoint", (F.col("_a") | (F.col("_n") == 0)).alias("_a"),
        F.when(F.col("_n") == 0, F.col("_all")).otherwise(F.col("_n")).alias("_need"))
    active = lookup(active, "active")
    # a view counts once, however many seeds it has rows of
    per_view = pred.groupBy("session", "frame", "view", "keypoint").agg((F.max("likelihood") > threshold).alias("_v"))
    seen = per_view.groupBy("session", "frame", "keypoint").agg((F.count_if("_v") >= min_views).alias("_ok"))
    frames = seen.join(active, ["session", "keypoint"]).groupBy("session", "frame").agg(
        F.count_if(F.col("_a") & F.col("_ok")).alias("_got"), F.max("_need").alias("_need"))
    return frames.where(F.col("_got") == F.col("_need")).select("session", "frame")


def likelihood_filter(pred: DataFrame, threshold: float, min_views: int) -> DataFrame:
    """Predictions of the confident frames."""
    return pred.join(confident_frames(pred, threshold, min_views), ["session", "frame"], "left_semi")
