"""Joins between predictions, labels, boxes, cameras and calibration files.

No side is broadcast by hand: Spark broadcasts a side whose size it knows to be small, and splits skewed partitions of
the others. Joins with many rows per session use the frame as part of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.functions import names as N
from trackloom.operators.ordered import row_index
from trackloom.session import lookup, many_rows, materialised


def calibration_lookup(asked: DataFrame, available: DataFrame, views: Sequence[str]) -> DataFrame:
    """``asked`` (with ``name``) + session and toml; toml is NULL where no camera file exists."""
    return asked.withColumn("session", N.calibration_session(F.col("name"), views)).join(available, "session", "left")


def labelled_only(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions of labelled frames; the rest is left out before its rows are shuffled by view and keypoint.

    Which frames are labelled is written as one bit per frame number. As long as that is small (``lookup``) every task has it
    and no prediction is shuffled to ask for it.
    """
    frames = labels.select("session", F.col("frame").cast("long").alias("frame")).where("session is not null and frame is not null").distinct()
    marks = frames.groupBy("session", F.bitmap_bucket_number("frame").alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("frame")).alias("_marks"))
    at = F.bitmap_bit_position(F.col("frame").cast("long"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))) % 2 == 1
    both = pred.withColumn("_block", F.bitmap_bucket_number(F.col("frame").cast("long"))).join(lookup(marks, "labelled"), ["session", "_block"])
    return both.where(marked).select(*pred.columns)


def labels_with_predictions(labels: DataFrame, pred: DataFrame, keys: Sequence[str] = ("session", "view", "frame", "keypoint"),
                            checked: bool = False) -> DataFrame:
    """Inner join of labels and predictions on the image and keypoint.

    Few frames are labelled, so give the predictions of ``labelled_only`` where there are all.
    ``checked`` raises an error where either side has a key that the other lacks (one more job over the keys).
    """
    if checked:
        audit = key_audit(labels, pred, keys).first()
        if audit.only_left or audit.only_right:
            raise ValueError(f"{audit.only_left} labels without a prediction, {audit.only_right} predictions without a label")
    return labels.join(many_rows(pred), list(keys))


def key_audit(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys in both inputs, only left and only right; a checked join needs the last two to be zero."""
    both = left.select(*keys, F.lit(1).alias("_l")).distinct().join(
        right.select(*keys, F.lit(1).alias("_r")).distinct(), list(keys), "full")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("in_both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def with_boxes(pred: DataFrame, boxes: DataFrame) -> DataFrame:
    """Predictions with the box (bx, by, bw, bh) of their session, view and frame; NULL where there is none."""
    return pred.join(many_rows(boxes), ["session", "view", "frame"], "left")


def with_cameras(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Points with the camera of their session and view; points without a camera are dropped."""
    return points.join(cameras, ["session", "view"])


def common_frames(df: DataFrame, over: str, n: int, keys: Sequence[str] = ("session", "frame")) -> DataFrame:
    """Rows of the frames in which all ``n`` distinct values of ``over`` occur (views, or models)."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_seen", F.size(F.collect_set(over).over(w))).where(F.col("_seen") == n).drop("_seen")


def without_labelled(pred: DataFrame, labelled: DataFrame) -> DataFrame:
    """Predictions of the (session, frame) pairs that carry no label."""
    return pred.join(many_rows(labelled.select("session", "frame").distinct()), ["session", "frame"], "left_anti")


def frames_for_labels(labels: DataFrame, pred: DataFrame) -> DataFrame:
    """Predictions of labelled frames, as ``label_frame`` + the prediction columns.

    Both inputs have session, view, frame; labels one row per image. Frame numbers are matched; a (session, view) in
    which no number matches at all falls back to matching the sorted positions. The matched rows, no more than there
    are labels, are written to the shared folder.
    """
    key = ["session", "view"]
    lab = labels.select(*key, F.col("frame").alias("label_frame"))
    named = pred.withColumn("_f", F.col("frame"))
    direct = materialised(lab.withColumn("_f", F.col("label_frame")).join(named, [*key, "_f"]), "labelled")
    matched = direct.select(*key).distinct()
    rest = lookup(row_index(lab.join(matched, key, "left_anti"), key, "label_frame", "_pos"), "unmatched")
    open_tracks = lookup(rest.select(*key).distinct(), "tracks")
    frames = pred.join(open_tracks, key, "left_semi").select(*key, "frame").distinct()
    frames = row_index(frames, key, "frame", "_pos")
    by_place = rest.join(frames, [*key, "_pos"]).select(*key, "label_frame", "frame")
    fallback = by_place.join(pred, [*key, "frame"])
    columns = ["label_frame", *pred.columns]
    return direct.select(*columns).unionByName(fallback.select(*columns))


def near(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: int,
         other: str = "onset") -> DataFrame:
    """Left rows joined with the right rows of the same keys whose ``other`` is within ``tolerance`` of ``value``.

    The right side is bucketed in steps of tolerance + 1, the left side looks at its own bucket and the next on either
    side, so the join is an equi join.
    """
    step = tolerance + 1
    bucket = F.floor(F.col(value) / F.lit(step))
    probes = left.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    held = right.withColumn("_bucket", F.floor(F.col(other) / F.lit(step))).withColumnRenamed(other, "_other")
    hit = probes.join(held, [*keys, "_bucket"]).where(F.abs(F.col(value) - F.col("_other")) <= tolerance)
    return hit.withColumnRenamed("_other", f"near_{other}").drop("_bucket")


def event_windows(events: DataFrame, trace: DataFrame, keys: Sequence[str], onset: str, before: int, after: int
                  ) -> DataFrame:
    """Trace rows with ``offset`` in [-before, after) around each event whose whole window lies in the trace."""
    ends = trace.groupBy(*keys).agg(F.min("frame").alias("_from"), F.max("frame").alias("_to"))
    inside = events.join(ends, list(keys)).where(
        (F.col(onset) - before >= F.col("_from")) & (F.col(onset) + after - 1 <= F.col("_to"))).drop("_from", "_to")
    wanted = inside.withColumn("offset", F.explode(F.sequence(F.lit(-before).cast("bigint"), F.lit(after - 1).cast("bigint"))))
    return wanted.withColumn("frame", F.col(onset) + F.col("offset")).join(trace, [*keys, "frame"])


def camera_pairs(points: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each pair of views that sees a point, once: view_i < view_j with the values of both.

    A point is seen by a handful of cameras; its observations are gathered in one small array.
    """
    seen = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("view", *values))).alias("_o"))
    pairs = F.flatten(F.transform("_o", lambda a: F.transform(
        F.filter("_o", lambda b: a["view"] < b["view"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    flat = seen.select(*keys, F.explode(pairs).alias("_p"))
    return flat.select(*keys, F.col("_p.a.view").alias("view_i"), F.col("_p.b.view").alias("view_j"),
                       *[F.col(f"_p.a.{v}").alias(f"{v}_i") for v in values],
                       *[F.col(f"_p.b.{v}").alias(f"{v}_j") for v in values])


def masked_matches(rows: DataFrame) -> DataFrame:
    """Scores of the view that was masked out."""
    return rows.where(F.col("masked_view") == F.col("target_view"))


def merge_splits(in_dist: DataFrame, out_dist: DataFrame) -> DataFrame:
    """Both label splits as one table with a ``split`` column; the columns must be the same."""
    if set(in_dist.columns) != set(out_dist.columns):
        raise ValueError("the two splits have different columns")
    return in_dist.withColumn("split", F.lit("InD")).unionByName(out_dist.withColumn("split", F.lit("OOD")))


def split_audit(labels: DataFrame, calibrated: DataFrame, image_key: Column) -> DataFrame:
    """Per view: images, images with and without calibration, and whether all views have equally many."""
    images = labels.select("view", "image_path", image_key.alias("_key")).distinct()
    known = calibrated.select(F.col("image_key").alias("_key"), F.lit(1).alias("_c")).distinct()
    per_view = images.join(known, "_key", "left").groupBy("view").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("_c").isNotNull()).alias("calibrated"),
        F.count_if(F.col("_c").isNull()).alias("uncalibrated"))
    span = per_view.agg((F.min("images") == F.max("images")).alias("e")).scalar()
    return per_view.withColumn("equal_counts", span)
