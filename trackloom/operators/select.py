"""Choosing rows: filters, top-k, seeded draws, quotas, splits and unions.

Seeded draws order rows by a hash of (seed, key), so the outcome does not depend on how the data are partitioned.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.operators.ordered import first_n, order_statistics, row_index
from trackloom.schema import cols
from trackloom.session import lookup, materialised


def select_coords(pred: DataFrame, coords: Sequence[str], keypoints: Sequence[str] | None = None,
                  keys: Sequence[str] = ("model", "seed", "session", "view", "frame", "keypoint")) -> DataFrame:
    """The chosen coordinates and keypoints."""
    out = pred.select(*keys, *coords)
    return out.where(F.col("keypoint").isin(*keypoints)) if keypoints else out


def exclude_matching(df: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Drop rows whose ``column`` contains any of ``parts``; NULL is kept."""
    if not parts:
        return df
    hit = F.rlike(F.col(column), F.lit("|".join(re.escape(p) for p in parts)))
    return df.where(~F.coalesce(hit, F.lit(False)))


def slice_frames(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Frames in [start, end)."""
    if start is not None:
        df = df.where(F.col("frame") >= start)
    return df if end is None else df.where(F.col("frame") < end)


def every_kth(df: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Each k-th row of a group in frame order, beginning with the first."""
    return row_index(df, keys, "frame", "_rn").where((F.col("_rn") - 1) % k == 0).drop("_rn")


def first_frames(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of a group in frame order; tasks keep no more than that of their own rows."""
    return first_n(df, keys, [F.col("frame")], n)


def mask_low_likelihood(df: DataFrame, threshold: float) -> DataFrame:
    keep = F.col("likelihood") >= threshold
    return df.withColumns({"x": F.when(keep, F.col("x")), "y": F.when(keep, F.col("y"))})


def mask_high_error(df: DataFrame, threshold: float, error: str = "error", sentinel: float = -1.0) -> DataFrame:
    """x, y NULL where the error is above ``threshold``, and each coordinate NULL where it equals the sentinel."""
    bad = F.coalesce(F.col(error) > threshold, F.lit(False))
    return df.withColumns({c: F.when(~bad & (F.col(c) != sentinel), F.col(c)) for c in ("x", "y")})


def keep_low_error(df: DataFrame, threshold: float, error: str = "error") -> DataFrame:
    """Rows of the frames in which every keypoint has an error, the largest below ``threshold``."""
    good = df.groupBy("session", "frame").agg(
        F.max(error).alias("_m"), F.count(error).alias("_n"), F.count(F.lit(1)).alias("_all"))
    good = good.where((F.col("_m") < threshold) & (F.col("_n") == F.col("_all")))
    return df.join(good, ["session", "frame"], "left_semi")


def complete_rows(df: DataFrame, values: Sequence[str], n_rows: int, keys: Sequence[str] = ("session", "frame")
                  ) -> DataFrame:
    """Rows of the groups that have ``n_rows`` rows, all with all values."""
    full = F.lit(True)
    for v in values:
        full = full & F.col(v).isNotNull()
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count_if(full).over(w)).where(F.col("_n") == n_rows).drop("_n")


def drop_frames(df: DataFrame, bad: DataFrame) -> DataFrame:
    """Without the listed (session, frame) pairs."""
    return df.join(bad.select("session", "frame").distinct(), ["session", "frame"], "left_anti")


def add_blank_frames(df: DataFrame, blanks: DataFrame, keypoints: Sequence[str], views: Sequence[str]) -> DataFrame:
    """With rows of NULL coordinates for the listed (session, frame) pairs."""
    rows = blanks.select("session", "frame", F.explode(F.array(*[F.lit(v) for v in views])).alias("view"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(k) for k in keypoints])).alias("keypoint"))
    return df.unionByName(rows, allowMissingColumns=True)


def context_frames(frames: DataFrame, context: int, sizes: DataFrame) -> DataFrame:
    """Each (session, frame) with ``context`` neighbours on both sides, inside [0, n_frames), each once."""
    c = F.lit(context).cast("bigint")
    spread = frames.select("session", F.explode(F.sequence(F.col("frame") - c, F.col("frame") + c)).alias("frame"))
    kept = spread.where(F.col("frame") >= 0).distinct().join(sizes, "session")
    return kept.where(F.col("frame") < F.col("n_frames")).select("session", "frame")


def ranked_set(df: DataFrame, file_keys: Sequence[str], wanted: Sequence[str] = ("test", "unused")) -> DataFrame:
    """Rows of the wanted sets; a file that has none of them keeps all its rows."""
    flag = lookup(df.groupBy(*file_keys).agg(F.max(F.col("set").isin(*wanted)).alias("_has")), "flags")
    return df.join(flag, list(file_keys)).where(~F.coalesce("_has", F.lit(False)) | F.col("set").isin(*wanted)).drop("_has")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the order of ``order``; one hash aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*cols(rest)), F.struct(*cols(order)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def union_first(existing: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing and added rows; where a key occurs in both, the existing row stays.

    ".short" is removed from session names first.
    """
    both = existing.withColumn("_prio", F.lit(0)).unionByName(added.withColumn("_prio", F.lit(1)))
    both = both.withColumn("session", F.replace("session", F.lit(".short"), F.lit("")))
    return dedupe_first(both, keys, ["_prio"]).drop("_prio")


def common_keypoints(errors: DataFrame, requested: Sequence[str], file_keys: Sequence[str]) -> DataFrame:
    """keypoint, position of the requested keypoints that every file has."""
    n_files = errors.select(*file_keys).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    have = errors.select(*file_keys, "keypoint").distinct().groupBy("keypoint").agg(F.count(F.lit(1)).alias("_n"))
    order = F.array_position(F.array(*[F.lit(k) for k in requested]), F.col("keypoint"))
    return have.where((F.col("_n") == n_files) & (order > 0)).select("keypoint", order.alias("position"))


def pooled(parts: Sequence[DataFrame]) -> DataFrame:
    """One table from several of the same columns, e.g. the features of all models."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tagged_union(parts: dict[str, DataFrame], column: str = "data_type") -> DataFrame:
    """All parts with their name in ``column``; nothing is removed."""
    return pooled([df.withColumn(column, F.lit(name)) for name, df in parts.items()])


def top_low_variance(scores: DataFrame, frames_per_video: int, min_frames: int) -> DataFrame:
    """The frames with the lowest scores per session; unknown scores last, ties by frame.

    A session with fewer frames gives all of them.
    """
    n = max(min_frames, frames_per_video)
    return first_n(scores, ["session"], [F.round("score", 9).asc_nulls_last(), F.col("frame")], n)


def remove_worst_share(scores: DataFrame, share: float) -> DataFrame:
    """(session, frame, score) without the round-half-even(n * share) frames of the highest score over all sessions.

    Unknown scores count towards n and go last; without any known score all frames stay. Ties go in the order of
    (session, frame). Only the cut-off value is looked up, then rows are filtered; nothing is sorted as a whole. The
    scores are written to the shared folder first, as they are read several times.
    """
    known = scores.select("session", "frame", "score", F.coalesce(F.round("score", 9), F.lit(float("-inf"))).alias("_s"))
    known = materialised(known, "scores")

    def dropped(n: Column) -> Column:
        return F.bround(n * F.lit(share), 0).cast("bigint")

    def cut(n: Column) -> Column:
        return F.greatest(n - F.greatest(dropped(n), F.lit(1)), F.lit(0))

    limit = order_statistics(known, [], "_s", {"cut": (1.0 - share, cut)})
    whole = known.agg(F.count("score").alias("k")).scalar()
    rows = known.withColumn("_q", limit.select(F.struct("n", "cut")).scalar()).withColumn("_k", whole)
    rows = rows.withColumn("_drop", F.when(F.col("_k") == 0, F.lit(0)).otherwise(dropped(F.col("_q.n"))))
    clear = rows.where((F.col("_drop") == 0) | (F.col("_s") < F.col("_q.cut")))
    ties = rows.where((F.col("_drop") > 0) & (F.col("_s") == F.col("_q.cut")))
    per = rows.groupBy("session", "_drop").agg(F.count_if(F.col("_s") > F.col("_q.cut")).alias("_above"),
                                               F.count_if(F.col("_s") == F.col("_q.cut")).alias("_ties"))
    one = Window.partitionBy(F.lit(0))
    before = F.sum("_ties").over(one.orderBy("session").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("session", (F.col("_drop") - F.sum("_above").over(one) - F.coalesce(before, F.lit(0))).alias("_take"))
    late = row_index(ties.select("session", "frame", "score"), ["session"], "frame", "_rn").join(per, "session")
    keep = ["session", "frame", "score"]
    return clear.select(*keep).unionByName(late.where(F.col("_rn") > F.col("_take")).select(*keep))


def worst_frames(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` frames with the highest score over all sessions, worst first."""
    return scores.orderBy(F.round("score", 9).desc_nulls_last(), "session", "frame").limit(n)


def hash_order(seed: int, keys: Sequence[str]) -> Column:
    """A reproducible random order of rows: 53 bits, so that it is exact as a double."""
    return F.shiftright(F.xxhash64(F.lit(seed), *cols(keys)), 11)


def random_frames(frames: DataFrame, n: int, seed: int, per_session: bool = True) -> DataFrame:
    """A seeded draw of ``n`` frames per session, or over all sessions."""
    order = [hash_order(seed, ["session", "frame"]), F.col("session"), F.col("frame")]
    if per_session:
        return first_n(frames, ["session"], order, n)
    return frames.orderBy(*order).limit(n)


def quotas(sessions: DataFrame, total: int) -> DataFrame:
    """session, quota: ``total`` split evenly over the sorted sessions, the first ones get the remainder."""
    one = Window.partitionBy(F.lit(0))
    numbered = sessions.select("session").distinct().withColumn("_i", F.row_number().over(one.orderBy("session")) - 1)
    numbered = numbered.withColumn("_n", F.count(F.lit(1)).over(one))
    base = F.floor(F.lit(total) / F.col("_n"))
    extra = (F.col("_i") < F.lit(total) - base * F.col("_n")).cast("bigint")
    return numbered.select("session", (base + extra).cast("bigint").alias("quota"))


def balanced(frames: DataFrame, total: int, order: Sequence[Column]) -> DataFrame:
    """Frames up to the session's share of ``total``; a session with fewer frames gives all of them."""
    picked = first_n(frames, ["session"], order, total, "_rn")
    return picked.join(quotas(frames, total), "session").where(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def train_val_split(frames: DataFrame, train: float, seed: int, max_train: int | None = None) -> DataFrame:
    """(session, frame) pairs with ``part`` train or validation, by a seeded hash order.

    The first round(n * train) frames train, all others validate; ``max_train`` keeps only the first of the training
    frames. All views of a frame share its part, as the input has one row per (session, frame).
    """
    placed = frames.select("session", "frame").distinct().withColumn("_h", hash_order(seed, ["session", "frame"]))

    def cut(n: Column) -> Column:
        return F.least(F.greatest(F.bround(n * F.lit(train), 0) - 1, F.lit(0)), n - 1)

    limit = order_statistics(placed, [], "_h", {"_cut": (train, cut)}).select(
        F.when(F.bround(F.col("n") * F.lit(train), 0) >= 1, F.col("_cut")).otherwise(F.lit(float("-inf")))).scalar()
    named = placed.withColumn("part", F.when(F.col("_h").cast("double") <= limit, "train").otherwise("validation"))
    if max_train is not None:
        first = named.where("part = 'train'").orderBy("_h", "session", "frame").limit(max_train)
        named = first.unionByName(named.where("part = 'validation'"))
    return named.drop("_h")
