"""Scores of predictions against labels, and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.operators.joins import labelled_only, labels_with_predictions
from trackloom.operators.ordered import approx_percentiles, cumulative_counts, percentiles, strict_rank_shares
from trackloom.session import lookup, many_rows, materialised

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
ERROR_PROBS = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def _percentiles(approx: bool) -> Callable[..., DataFrame]:
    """Exact percentiles, or the one-pass variant."""
    return approx_percentiles if approx else percentiles


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def pixel_error(labels: DataFrame, pred: DataFrame, keys: Sequence[str] = ("session", "view", "frame", "keypoint")
                ) -> DataFrame:
    """Label and prediction columns with ``error`` in pixels; NULL where either side is missing."""
    both = labels_with_predictions(labels, pred, keys)
    return both.withColumn("error", distance(F.col("lx"), F.col("ly"), F.col("x"), F.col("y")))


def error_table(errors: DataFrame, stds: DataFrame) -> DataFrame:
    """Per model, view, frame and keypoint: error, ens_std, and the share of smaller ens_std in the view and in the
    view and keypoint, among all of ``stds``. Deviations are ranked at nine digits.

    Give the deviations of the labelled frames only, as ranks are among these. They are written to the shared folder
    once, as both ranks and the result read them.
    """
    key = ["session", "view", "frame", "keypoint"]
    base = materialised(stds.select(*key, "ens_std", F.round("ens_std", 9).alias("_k")), "deviations")
    ranked = base.join(strict_rank_shares(base, ["view"], "_k", "std_rank"), ["view", "_k"], "left")
    own = strict_rank_shares(base, ["view", "keypoint"], "_k", "std_rank_keypoint")
    ranked = ranked.join(own, ["view", "keypoint", "_k"], "left")
    return errors.join(many_rows(ranked.select(*key, "ens_std", "std_rank", "std_rank_keypoint")), key)


def _swept(rows: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Moments of ``error`` of the rows with ens_std above each grid value: keys, i, threshold, rows, n, s, ss.

    Every grid value has a row per key, with zeros where no row is above it. Rows are summed once per number of grid values
    below them; the short result is spread over the grid.
    """
    steps = F.array(*[F.lit(float(g)) for g in grid])
    level = F.size(F.filter(steps, lambda g: g < F.col("ens_std")))
    sums = rows.withColumn("_level", level).groupBy(*keys, "_level").agg(
        F.count(F.lit(1)).alias("_r"), F.count("error").alias("_n"), F.sum("error").alias("_s"),
        F.sum(F.col("error") * F.col("error")).alias("_ss"))
    spread = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("i"))
    above = F.col("_level") > F.col("i")
    return spread.groupBy(*keys, "i").agg(
        F.sum(F.when(above, F.col("_r")).otherwise(0)).alias("rows"), F.sum(F.when(above, F.col("_n")).otherwise(0)).alias("n_points"),
        F.sum(F.when(above, F.col("_s"))).alias("_s"), F.sum(F.when(above, F.col("_ss"))).alias("_ss")
    ).withColumn("threshold", F.get(steps, F.col("i")))


def threshold_sweep(rows: DataFrame, grid: Sequence[float], keys: Sequence[str] = ("view", "model")) -> DataFrame:
    """For each grid value: count and mean of the errors whose ens_std is above it; 0 and NULL where none is."""
    return _swept(rows, keys, grid).select(*keys, "threshold", "n_points",
                                           (F.col("_s") / F.nullif("n_points", F.lit(0))).alias("mean_error"))


def sweep_percentiles(rows: DataFrame, grid: Sequence[float], shares: Sequence[float], keys: Sequence[str] = ("model",)
                      ) -> DataFrame:
    """Per share p: the threshold that leaves the count nearest to p % of the first count, and the share reported.

    Grid values that leave nothing compete as well; the first of equals is taken. If that is the last grid value, the share
    that is really left is reported (two digits).
    """
    counts = _swept(rows, keys, grid)
    first = counts.where("i = 0").select(*keys, F.col("n_points").alias("_n0"))
    last = len(grid) - 1
    tried = counts.join(first, list(keys)).select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    far = F.round(F.abs(F.col("n_points") - F.col("_n0") * F.col("share") / 100), 9)
    best = tried.groupBy(*keys, "share").agg(
        F.min_by(F.struct("i", "threshold", "n_points", "_n0"), F.struct(far, F.col("i"))).alias("_b"))
    left = F.round(F.col("_b.n_points") / F.nullif(F.col("_b._n0"), F.lit(0)) * 100, 2)
    return best.select(*keys, "share", F.col("_b.threshold").alias("threshold"),
                       F.when(F.col("_b.i") == last, left).otherwise(F.col("share")).alias("reported"))


def mean_se_curve(rows: DataFrame, grid: Sequence[float], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean error and its standard error (sample deviation / sqrt(n)) above each grid value that leaves rows."""
    n = F.nullif("n_points", F.lit(0))
    spread = F.sqrt(F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    return _swept(rows, keys, grid).where("rows > 0").select(
        *keys, "threshold", "n_points", (F.col("_s") / n).alias("mean_error"), (spread / F.sqrt(n)).alias("se"))


def error_summary(errors: DataFrame, keys: Sequence[str] = ("model", "seed")) -> DataFrame:
    """count, mean, sample std, min, max and a normal 95 % interval of the mean."""
    half = F.lit(1.96) * F.col("std") / F.sqrt("n")
    return errors.groupBy(*keys).agg(
        F.count("error").alias("n"), F.avg("error").alias("mean"), F.stddev_samp("error").alias("std"),
        F.min("error").alias("min"), F.max("error").alias("max")).withColumns(
        {"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def r2_pooled(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - residual / total sum of squares, x and y pooled, over pairs with all four values; NULL if the total is
    no more than 1e-12."""
    full = pairs.dropna(subset=["lx", "ly", "x", "y"])
    sums = full.groupBy(*keys).agg(
        F.sum(F.pow(F.col("lx") - F.col("x"), 2) + F.pow(F.col("ly") - F.col("y"), 2)).alias("_res"),
        ((F.var_pop("lx") + F.var_pop("ly")) * F.count(F.lit(1))).alias("_tot"), F.count(F.lit(1)).alias("n_points"))
    return sums.select(*keys, F.when(F.col("_tot") > 1e-12, 1 - F.col("_res") / F.col("_tot")).alias("r2"), "n_points")


def error_stats(errors: DataFrame, probs: Mapping[str, float] = ERROR_PROBS, approx: bool = False) -> DataFrame:
    """n, mean, population std, percentiles and max of ``error`` per session and over all ("ALL").

    The errors are written once; each aggregate reads them with a second row for "ALL", combined before the shuffle.
    """
    base = materialised(errors.where("error is not null").select("session", "error"), "errors")
    both = base.select(F.explode(F.array("session", F.lit("ALL"))).alias("session"), "error")
    plain = both.groupBy("session").agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"),
                                        F.max("error").alias("max"))
    return plain.join(_percentiles(approx)(both, ["session"], "error", probs), "session")


def error_by_cluster(errors: DataFrame, clusters: DataFrame, approx: bool = False) -> DataFrame:
    """Per model, keypoint and cluster: median and quartiles of the per-frame mean over views, and mean and standard
    error of the session medians.

    ``errors`` has one row per model, session, frame, view and keypoint; ``clusters`` one per model, session, frame. The
    per-frame means are written to the shared folder, as both sets of percentiles read them.
    """
    per_frame = errors.groupBy("model", "session", "frame", "keypoint").agg(F.avg("error").alias("error"))
    key = ["model", "keypoint", "cluster"]
    per_frame = per_frame.where("error is not null").join(clusters, ["model", "session", "frame"])
    per_frame = materialised(per_frame.select(*key, "session", "error"), "frame-errors")
    find = _percentiles(approx)
    pooled = find(per_frame, key, "error", QUARTILES).withColumnRenamed("n", "n_frames")
    by_session = find(per_frame, [*key, "session"], "error", {"m": 0.5})
    spread = by_session.groupBy(*key).agg(
        F.avg("m").alias("mean_session_median"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"),
        F.count("m").alias("n_sessions"))
    return pooled.join(spread, key)


def reprojection_score(detections: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Per (session, frame): mean distance of label and detection over the views and keypoints above the threshold."""
    both = labels_with_predictions(labels, labelled_only(detections, labels))
    good = F.when(F.col("likelihood") > threshold, distance(F.col("lx"), F.col("ly"), F.col("x"), F.col("y")))
    return both.groupBy("session", "frame").agg(F.avg(good).alias("score"))


def global_reprojection_error(errors: DataFrame, keys: Sequence[str] = ("session", "frame")) -> DataFrame:
    """Per frame: mean over x and y, then keypoints, then views; missing values are skipped at each level."""
    axes = F.coalesce((F.col("dx") + F.col("dy")) / 2, F.col("dx"), F.col("dy"))
    views = errors.groupBy(*keys, "view").agg(F.avg(axes).alias("_e"))
    return views.groupBy(*keys).agg(F.avg("_e").alias("error"))


def throughput(timings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample std of the time per batch, mean and std of the rate (frames/s, or 1/s when training)."""
    rate = F.when(F.col("mode") == "train", 1 / F.col("time_per_batch")).otherwise(
        F.col("batch_size") / F.col("time_per_batch"))
    return timings.withColumn("_rate", rate).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("time_per_batch").alias("mean_time"),
        F.stddev_samp("time_per_batch").alias("std_time"), F.avg("_rate").alias("mean_rate"),
        F.stddev_samp("_rate").alias("std_rate"))


def coverage(pred: DataFrame) -> DataFrame:
    """Valid points, rows, views and frames per model, per session of a model, and over all."""
    per_frame = pred.groupBy("model", "session", "view", "frame").agg(
        F.count(F.lit(1)).alias("_r"), F.count(F.col("x") + F.col("y")).alias("_v"))
    sets = [["model", "session"], ["model"], []]
    return per_frame.groupingSets(sets, "model", "session").agg(
        F.sum("_r").alias("rows"), F.sum("_v").alias("valid"), F.count_distinct("view").alias("views"))


# Two-sample comparison of sessions.

def session_statistics(values: DataFrame, keys: Sequence[str] = ("session", "keypoint", "axis")) -> DataFrame:
    """min, max, mean, population std, range and count per session, keypoint and axis; empty groups are left out."""
    return values.where("value is not null").groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range"),
        F.count("value").alias("n_valid"))


def melt_axes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """3-D points as one row per axis (x, y, z) with ``value``."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("value")) for a, c in zip("xyz", "XYZ")])
    return points.select(*keys, F.explode(axes).alias("_a")).select(*keys, "_a.axis", "_a.value")


def session_pairs(stats: DataFrame, sessions: Sequence[str], min_count: int = 100) -> DataFrame:
    """Pairs (session1 before session2) of the named sessions per keypoint and axis, with the statistics of both.

    The statistics have one row per session; the number of pairs is set by the list the caller gives.
    """
    parts = ("min", "max", "mean", "n_valid")
    entry = F.struct("session", F.struct(*parts).alias("s"))
    held = stats.where(F.col("session").isin(*sessions) & (F.col("n_valid") >= min_count)).groupBy(
        "keypoint", "axis").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for i, a in enumerate(sessions) for b in sessions[i + 1:]])
    flat = held.select("keypoint", "axis", "_m", F.explode(named).alias("_p"))
    flat = flat.select("keypoint", "axis", F.col("_p.a").alias("session1"), F.col("_p.b").alias("session2"),
                       F.expr("_m[_p.a]").alias("_1"), F.expr("_m[_p.b]").alias("_2"))
    flat = flat.where("_1 is not null and _2 is not null")
    return flat.select("keypoint", "axis", "session1", "session2", *[F.col(f"_1.{p}").alias(f"{p}1") for p in parts],
                       *[F.col(f"_2.{p}").alias(f"{p}2") for p in parts])


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic, clipped to [0, 1]."""
    lam2 = F.pow(d, 2) * n1 * n2 / (n1 + n2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam2))
    return F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0))


def ks_statistics(values: DataFrame, sessions: Sequence[str], min_count: int = 100) -> DataFrame:
    """Largest gap of the cumulative distributions for each pair of ``sessions``, per keypoint and axis.

    The running count of each session is kept side by side over the distinct values (at nine digits); the gap of every
    pair is then one maximum in one pass, so no row is copied per pair.
    """
    key = ["keypoint", "axis"]
    rows = values.where(F.col("session").isin(*sessions)).withColumn("_v", F.round("value", 9))
    per = {f"_{i}": F.when(F.col("session") == s, 1).otherwise(0).cast("bigint") for i, s in enumerate(sessions)}
    run = cumulative_counts(rows, key, "_v", per).drop("total")
    sizes = rows.where("_v is not null").groupBy(*key).agg(*[F.sum(e).alias(f"n{c}") for c, e in per.items()])
    shares = run.join(lookup(sizes, "sizes"), key)
    names = list(per)
    gaps, pairs = [], []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            b = names[j]
            share = (F.try_divide(F.col(a), F.col(f"n{a}")) - F.try_divide(F.col(b), F.col(f"n{b}")))
            gaps.append(F.max(F.abs(share)).alias(f"d_{i}_{j}"))
            pairs.append(F.struct(F.lit(sessions[i]).alias("session1"), F.lit(sessions[j]).alias("session2"),
                                  F.col(f"d_{i}_{j}").alias("ks"), F.col(f"n{a}").alias("n1"), F.col(f"n{b}").alias("n2")))
    counts = [F.max(f"n{c}").alias(f"n{c}") for c in names]
    wide = shares.groupBy(*key).agg(*gaps, *counts)
    flat = wide.select(*key, F.explode(F.array(*pairs)).alias("_p")).select(*key, "_p.*")
    return flat.where((F.col("n1") >= min_count) & (F.col("n2") >= min_count))


def session_difference(values: DataFrame, sessions: Sequence[str], min_count: int = 100) -> DataFrame:
    """Per keypoint, axis and pair of sessions: distribution gap, its p-value, mean difference and range overlap (%)."""
    pairs = session_pairs(session_statistics(values), sessions, min_count).drop("n_valid1", "n_valid2")
    both = ks_statistics(values, sessions, min_count).join(pairs, ["keypoint", "axis", "session1", "session2"])
    overlap = F.greatest(F.least("max1", "max2") - F.greatest("min1", "min2"), F.lit(0.0))
    total = F.greatest("max1", "max2") - F.least("min1", "min2")
    return both.select(
        "keypoint", "axis", "session1", "session2", F.col("ks"),
        ks_pvalue(F.col("ks"), F.col("n1"), F.col("n2")).alias("p_value"),
        F.abs(F.col("mean1") - F.col("mean2")).alias("mean_diff"),
        F.when(total > 0, 100 * overlap / total).otherwise(F.lit(0.0)).alias("overlap_pct"))


def range_ratio(stats: DataFrame) -> DataFrame:
    """Per keypoint and axis: smallest and largest session range and their ratio."""
    return stats.groupBy("keypoint", "axis").agg(
        F.min("range").alias("min_range"), F.max("range").alias("max_range")).withColumn(
        "ratio", F.when(F.col("min_range") > 0, F.col("max_range") / F.col("min_range")))


def consistency_verdict(differences: DataFrame) -> DataFrame:
    """Mean gap and overlap over all pairs, pairs with a gap above 0.3, and the verdict."""
    sums = differences.agg(F.avg("ks").alias("mean_ks"), F.avg("overlap_pct").alias("mean_overlap"),
                           F.count_if(F.col("ks") > 0.3).alias("n_high"))
    return sums.withColumn("verdict", F.when((F.col("mean_ks") < 0.1) & (F.col("mean_overlap") > 80), "CONSISTENT")
                           .when((F.col("mean_ks") < 0.2) & (F.col("mean_overlap") > 60), "MODERATE").otherwise("LARGE"))


def axis_consistency(differences: DataFrame) -> DataFrame:
    return differences.groupBy("axis").agg(F.avg("ks").alias("mean_ks"), F.avg("overlap_pct").alias("mean_overlap"))


def most_different(differences: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pairs with the largest gap above 0.3."""
    return differences.where("ks > 0.3").orderBy(
        F.round("ks", 9).desc(), "session1", "session2", "keypoint", "axis").limit(n)
